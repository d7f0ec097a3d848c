"""Many patterns at once in texts, gates on what they match, and layers of aliases."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import kept
from .graphs import components

#: Bytes of patterns in one automaton; a larger list is taken in slices by the first letters of its patterns.
SLICE_BYTES = 16 << 20
#: Rows of a table that may be broadcast.
SMALL = 200_000
#: Matches that a task of ``matches`` or ``holding`` holds before it passes them on.
HELD = 1 << 13
_LETTERS = re.compile("[A-Za-z\u0080-\U0010ffff]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matches(docs: DataFrame, entries: DataFrame, window: int = 3, slice_bytes: int = SLICE_BYTES, whole: bool = False) -> DataFrame:
    """(doc_id, entry, start, end, bounded, near): every place where a text holds an entry, overlapping ones too; start and end
    are code points, end exclusive. ``bounded``: no letter stands beside it; ``near``: the ``window`` words before and
    after it, as far as there are any. ``whole``: bounded places only. A-Z are lower-cased in texts and entries.

    One automaton of all entries goes over each text once, and a task holds ``HELD`` matches at a time. It is made of at most ``slice_bytes`` of entries; a larger
    list is cut by the first two letters, which no match can cross, into slices with a pass of their own, and what a
    slice finds is written before the next. ``docs``: doc_id, text; ``entries``: entry. Null texts and null or empty
    entries match nothing; entries that are equal but for case are one (the lower-cased); repeated documents match each."""
    words = kept(entries.select(F.translate("entry", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("entry")).where("entry is not null and entry <> ''").distinct(), "entries")
    size = words.agg(F.sum(F.octet_length("entry"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    place = F.pmod(F.xxhash64(F.substring("entry", 1, 2)), F.lit(slices))
    base = docs.where("text is not null").select("doc_id", "text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, entry string, start int, end int, bounded boolean, near array<string>"

    def scan(some: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for entry in some:
                automaton.add_word(entry, entry)
            automaton.make_automaton()
            def made(ids: pa.Array, which: list[int], rows: list[tuple]) -> pa.RecordBatch:
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "entry", "start", "end", "bounded", "near"])

            for batch in batches:
                rows: list[tuple] = []
                which: list[int] = []
                for i, text in enumerate(batch.column(1)):
                    low = text.as_py().translate(_LOWER)
                    begins: list[int] | None = None
                    for at, entry in automaton.iter(low):
                        if begins is None:
                            spans = [m.span() for m in _LETTERS.finditer(low)]
                            begins, ends = [s for s, _ in spans], [e for _, e in spans]
                        start, end = at - len(entry) + 1, at + 1
                        bounded = not _LETTERS.match(low[start - 1 : start]) and not _LETTERS.match(low[end : end + 1])
                        if whole and not bounded:
                            continue
                        near = []
                        if window:
                            before, after = bisect_right(ends, start), bisect_left(begins, end)
                            near = [low[s:e] for s, e in spans[max(0, before - window) : before] + spans[after : after + window]]
                        which.append(i)
                        rows.append((entry, start, end, bounded, near))
                        if len(rows) >= HELD:
                            yield made(batch.column(0), which, rows)
                            rows, which = [], []
                yield made(batch.column(0), which, rows)

        return run

    out = None
    for s in range(slices):
        some = sorted(r[0] for r in words.where(place == s).collect())  # about slice_bytes
        if len(some) or out is None:
            part = base.mapInArrow(scan(some), schema)
            part = part if slices == 1 else kept(part, "matches")
            out = part if out is None else out.unionByName(part)
    return out


def holding(docs: DataFrame, entries: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, entry): which of ``entries`` (entry) stand anywhere in each text of ``docs`` (doc_id, text), as they are written: the
    automaton of ``matches`` without places, and a row once a text. Null texts and null or empty entries hold nothing."""
    words = kept(entries.where("entry is not null and entry <> ''").select("entry").distinct(), "entries")
    size = words.agg(F.sum(F.octet_length("entry"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    place = F.pmod(F.xxhash64(F.substring("entry", 1, 2)), F.lit(slices))
    base = docs.where("text is not null").select("doc_id", "text")

    def scan(some: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, entry in enumerate(some):
                automaton.add_word(entry, i)
            automaton.make_automaton()
            def made(ids: pa.Array, which: list[int], found: list[str]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), pa.array(found, pa.string())], names=["doc_id", "entry"])

            for batch in batches:
                which, found = [], []
                for row, text in enumerate(batch.column(1)):
                    own = {i for _, i in automaton.iter(text.as_py())} if some else set()
                    which += [row] * len(own)
                    found += [some[i] for i in own]
                    if len(found) >= HELD:
                        yield made(batch.column(0), which, found)
                        which, found = [], []
                yield made(batch.column(0), which, found)

        return run

    out = None
    for s in range(slices):
        some = sorted(r[0] for r in words.where(place == s).collect())  # about slice_bytes
        if some or out is None:
            part = base.mapInArrow(scan(some), f"doc_id {dict(docs.dtypes)['doc_id']}, entry string")
            part = part if slices == 1 else kept(part, "holding")
            out = part if out is None else out.unionByName(part)
    return out


def _swept(found: DataFrame, columns: list[str], run) -> DataFrame:
    """``run`` over the distinct (start, end, ...) of each text, sorted from the left, the longest first; it gives the places in
    the list of the rows that stay."""
    kinds = dict(found.dtypes)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), ("end", "descending"), *((c, "ascending") for c in columns)])
        return table.take(pa.array(run(*(table[c].to_pylist() for c in ("start", "end", *columns))), pa.int64()))

    some = found.select("doc_id", "start", "end", *columns).repartition("doc_id").distinct()  # one shuffle for both
    return some.groupBy("doc_id").applyInArrow(one, ", ".join(f"{c} {kinds[c]}" for c in some.columns))


def longest(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, entry): from the left, the longest of the matches that begin first, then of those that begin at its end or
    behind it, and so on. A task holds the matches of one text at a time."""

    def run(starts: list[int], ends: list[int], _: list[str]) -> list[int]:
        out, at = [], 0
        for i, (start, end) in enumerate(zip(starts, ends)):
            if start >= at:
                out.append(i)
                at = end
        return out

    return _swept(found, ["entry"], run)


def _covered(starts: list[int], ends: list[int], entities: list[str]) -> list[int]:
    """Rows that a row of another entity covers (the same place counts). Rows come by start, longest first."""
    out: list[int] = []
    best: list[tuple[int, str]] = []  # the furthest end so far, and the furthest of another entity
    i = 0
    while i < len(starts):
        j = i
        while j < len(starts) and starts[j] == starts[i] and ends[j] == ends[i]:
            j += 1
        for k in range(i, j):  # rows of one place see each other
            best = sorted({e: end for end, e in sorted([*best, (ends[k], entities[k])])}.items(), key=lambda x: (-x[1], x[0]))
            best = [(end, e) for e, end in best[:2]]
        out += [k for k in range(i, j) if any(e != entities[k] and end >= ends[k] for end, e in best)]
        i = j
    return out


def gated(found: DataFrame, rules: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Rows of ``found`` with entity and ``gate``: what keeps a match out, or ``accepted``; the first of: ``boundary`` (the rule asks for
    whole words and a letter stands beside), ``validity`` (the text's year is outside the rule's), ``blocked`` (a word of
    ``never`` is near), ``context`` (none of ``needs`` is near, where any are given), ``rival`` (a match of another entity that
    passed so far covers it or lies on the same place).

    ``rules``: entry, entity, whole, needs, never, first, last; a row for each entity that an entry may stand for; nulls ask
    for nothing. ``docs`` (doc_id, year), each doc_id once, brings the years; a text without one passes every year. Matches
    without a rule are left out. A task holds the matches of one text at a time."""
    some = rules.select(F.translate("entry", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("entry"), "entity", "whole", "needs", "never", "first", "last")
    some = kept(some.where("entity is not null").distinct(), "rules")
    met = found.join(F.broadcast(some) if some.count() <= SMALL else some, "entry")
    met = met.withColumn("year", F.lit(None).cast("int")) if docs is None else met.join(docs.select("doc_id", "year"), "doc_id", "left")
    gate = F.when(F.coalesce("whole", F.lit(False)) & ~F.col("bounded"), "boundary")
    gate = gate.when((F.col("year") < F.col("first")) | (F.col("year") > F.col("last")), "validity")
    gate = gate.when(F.arrays_overlap("near", "never"), "blocked")
    gate = gate.when((F.size("needs") > 0) & ~F.coalesce(F.arrays_overlap("near", "needs"), F.lit(False)), "context")
    met = kept(met.select(*found.columns, "entity", gate.alias("gate")), "gated")
    covered = _swept(met.where("gate is null"), ["entity"], _covered).withColumn("_rival", F.lit("rival"))
    both = met.join(covered, ["doc_id", "start", "end", "entity"], "left")
    return both.select(*found.columns, "entity", F.coalesce("gate", "_rival", F.lit("accepted")).alias("gate"))


def alias_layer(pairs: DataFrame, blockers: DataFrame) -> DataFrame:
    """(name, entity, names, weight): names that mean the same, as groups called by their smallest name, with the number of
    names and the sum of the weights of the pairs that hold the group together.

    ``pairs``: a, b, weight (witnesses that say so; repeated pairs add up, either way round; a pair without weight, or of a
    name with itself, says nothing); ``blockers``: a, b that must not be in one group. Pairs are taken from the
    heaviest down (of equal weight by a, then b, the smaller name as a), and one that would bring two blocked names together is left
    out. Groups without a blocked pair inside are plain components, found by rounds of joins; only components that hold a
    blocked pair are gone through pair by pair, each in one task. Names in blocked pairs alone are in no group."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    said = kept(pairs.where("a <> b and weight is not null").select(low, high, "weight").groupBy("a", "b").agg(F.sum("weight").cast("double").alias("weight")), "pairs")
    label = kept(components(said.select("a", "b")), "labels")
    at = label.select(F.col("id").alias("a"), "component")
    apart = blockers.where("a <> b").select(low, high).distinct().join(at, "a").join(label.select(F.col("id").alias("b"), F.col("component").alias("_c")), "b").where("component = _c").select("component", "a", "b")
    apart = kept(apart, "apart")
    inside = kept(said.join(at, "a"), "inside")
    mixed = apart.select("component").distinct()
    plain = inside.join(mixed, "component", "left_anti").select("component", "a", "b", "weight")
    hard = inside.join(mixed, "component", "left_semi").select("component", "a", "b", "weight")
    both = hard.unionByName(apart.withColumn("weight", F.lit(None).cast("double")))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-(r["weight"] or 0.0), r["a"], r["b"]))
        foes: dict[str, set[str]] = {}
        for r in rows:
            if r["weight"] is None:
                foes.setdefault(r["a"], set()).add(r["b"])
                foes.setdefault(r["b"], set()).add(r["a"])
        of = {n: n for r in rows for n in (r["a"], r["b"])}
        members = {n: [n] for n in of}
        used = []
        for r in rows:
            if r["weight"] is None:
                continue
            x, y = sorted((of[r["a"]], of[r["b"]]), key=lambda g: (-len(members[g]), g))
            if x != y:
                inner = set(members[x])
                if any(foes.get(n, set()) & inner for n in members[y]):
                    continue
                for n in members[y]:
                    of[n] = x
                members[x] += members.pop(y)
            used.append(r)
        first = {g: min(names) for g, names in members.items()}
        return pa.table({"component": [first[of[r["a"]]] for r in used], "a": [r["a"] for r in used], "b": [r["b"] for r in used], "weight": [r["weight"] for r in used]}, schema=pa.schema([("component", pa.string()), ("a", pa.string()), ("b", pa.string()), ("weight", pa.float64())]))

    parts = kept(plain.unionByName(both.groupBy("component").applyInArrow(run, "component string, a string, b string, weight double")), "parts")
    weights = parts.groupBy("component").agg(F.sum("weight").alias("weight"))
    names = parts.select("component", F.explode(F.array("a", "b")).alias("name")).distinct()
    size = names.groupBy("component").agg(F.count(F.lit(1)).alias("names"))
    return names.join(size, "component").join(weights, "component").select("name", F.col("component").alias("entity"), "names", "weight")
