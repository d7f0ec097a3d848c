"""Trees from distances: neighbour joining, average linkage, splits, tree distance, cuts, and witnesses of mixed descent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import kept

#: Leaves of one tree. A tree of n leaves takes n * n / 2 distances in one task, and about n * n * n steps.
LEAVES = 1000


def profile_distances(counts: DataFrame) -> DataFrame:
    """(tree, a, b, distance): one less what the shares of two leaves' features have in common, for leaves a < b of each tree.
    ``counts``: tree, leaf, feature, n, each feature once a leaf. Leaves of a tree are few (``LEAVES``); leaves without
    a feature in common have distance 1."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("tree", "leaf"))
    shares = kept(counts.where("n > 0").select("tree", "leaf", "feature", share.alias("p")), "shares")
    leaves = shares.select("tree", "leaf").distinct()
    x, y = (shares.select("tree", F.col("leaf").alias(n), "feature", F.col("p").alias(f"p{n}")) for n in "ab")
    common = x.join(y, ["tree", "feature"]).where("a < b").groupBy("tree", "a", "b").agg(F.sum(F.least("pa", "pb")).alias("common"))
    pairs = leaves.select("tree", F.col("leaf").alias("a")).join(leaves.select("tree", F.col("leaf").alias("b")), "tree").where("a < b")
    return pairs.join(common, ["tree", "a", "b"], "left").select("tree", "a", "b", (1 - F.coalesce("common", F.lit(0.0))).alias("distance"))


def _matrix(rows: pa.Table) -> tuple[list[str], np.ndarray]:
    """Sorted leaves and their distances (both ways, 0 to themselves). A pair that is missing, or given twice, is an error."""
    a, b, far = (rows[c].to_pylist() for c in ("a", "b", "distance"))
    names = sorted({*a, *b})
    if len(names) > LEAVES:
        raise ValueError(f"a tree of {len(names)} leaves; {LEAVES} at most")
    at = {n: i for i, n in enumerate(names)}
    d = np.full((len(names), len(names)), np.nan)
    for x, y, f in zip(a, b, far):
        if not np.isnan(d[at[x], at[y]]):
            raise ValueError(f"two distances of {x} and {y}")
        d[at[x], at[y]] = d[at[y], at[x]] = f
    np.fill_diagonal(d, 0)
    if np.isnan(d).any():
        raise ValueError("a distance is missing")
    return names, d


def neighbour_joining(names: list[str], d: np.ndarray) -> list[tuple[str, str | None, float]]:
    """(node, parent, length) of an unrooted tree, hung up at its last inner node (parent null). Inner nodes are #1, #2,
    ... in the order of joining; of equally good pairs the first in the order of nodes (leaves sorted, then inner ones) is
    joined; lengths under 0 become 0. Distances that lie on a tree give that tree."""
    if len(names) == 1:
        return [(names[0], None, 0.0)]
    if len(names) == 2:
        return [(names[0], "#1", d[0, 1] / 2), (names[1], "#1", d[0, 1] / 2), ("#1", None, 0.0)]
    nodes, d, out, inner = list(names), d.astype(float).copy(), [], 0
    while len(nodes) > 3:
        n = len(nodes)
        total = d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        q[np.tril_indices(n)] = np.inf
        best = np.round(q, 9)
        i, j = divmod(int(best.argmin()), n)
        own = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        inner += 1
        out += [(nodes[i], f"#{inner}", max(0.0, own)), (nodes[j], f"#{inner}", max(0.0, d[i, j] - own))]
        joined = (d[i] + d[j] - d[i, j]) / 2
        keep = [x for x in range(n) if x not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], joined[keep, None]], [joined[None, keep], np.zeros((1, 1))]])
        nodes = [*(nodes[x] for x in keep), f"#{inner}"]
    x, y, z = nodes
    root = f"#{inner + 1}"
    lengths = ((d[0, 1] + d[0, 2] - d[1, 2]) / 2, (d[0, 1] + d[1, 2] - d[0, 2]) / 2, (d[0, 2] + d[1, 2] - d[0, 1]) / 2)
    return [*out, *((node, root, max(0.0, length)) for node, length in zip((x, y, z), lengths)), (root, None, 0.0)]


def linkage(names: list[str], d: np.ndarray) -> list[tuple[int, str, str, float, int]]:
    """(step, a, b, height, size): merges by average distance, in order of height. A cluster goes by its smallest leaf, and a < b.

    Chains of nearest neighbours: from any cluster on to its nearest (of equally near ones the cluster before in the
    chain, else the one with the smallest leaf), until two are each other's nearest, which are merged. Without ties
    that is what merging the closest two again and again gives. Merges of equal height stand in the order they
    were made."""
    n = len(names)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            x = chain[-1]
            near = int(d[x].argmin())
            if len(chain) > 1 and d[x, chain[-2]] <= d[x, near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        chain.pop(), chain.pop()
        a, b = min(x, near), max(x, near)
        merges.append((d[a, b], names[a], names[b], int(size[a] + size[b])))
        joined = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = joined, joined
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
    order = sorted(range(len(merges)), key=lambda i: merges[i][0])
    return [(step, merges[i][1], merges[i][2], float(merges[i][0]), merges[i][3]) for step, i in enumerate(order)]


def _each(rows: DataFrame, schema: str, types: pa.Schema, run: Callable[[str, pa.Table], list[tuple]]) -> DataFrame:
    def one(key: tuple, group: pa.Table) -> pa.Table:
        found = [(key[0].as_py(), *r) for r in run(key[0].as_py(), group)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found), types)] if found else [pa.array([], f.type) for f in types], schema=types)

    return rows.withColumn("tree", F.col("tree").cast("string")).groupBy("tree").applyInArrow(one, schema)


_EDGES = pa.schema([("tree", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("length", pa.float64())])


def neighbour_trees(distances: DataFrame) -> DataFrame:
    """(tree, node, parent, length): the tree of each group of ``distances`` (tree, a, b, distance; every two leaves once),
    by neighbour joining. Spark works out the distances of all trees at once, and a task builds one tree of at most
    ``LEAVES`` leaves; larger ones, and missing or double distances, are errors. No rows give none."""
    return _each(distances, "tree string, node string, parent string, length double", _EDGES, lambda _, g: neighbour_joining(*_matrix(g)))


def average_linkage(distances: DataFrame) -> DataFrame:
    """(tree, step, a, b, height, size): merges of each group of ``distances``, as ``linkage`` makes them."""
    types = pa.schema([("tree", pa.string()), ("step", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("height", pa.float64()), ("size", pa.int32())])
    return _each(distances, "tree string, step int, a string, b string, height double, size int", types, lambda _, g: linkage(*_matrix(g)))


def linkage_edges(merges: DataFrame) -> DataFrame:
    """(tree, node, parent, length) of the trees that merges make; a merge is the node #step, as high as half its height."""

    def run(_: str, group: pa.Table) -> list[tuple]:
        at: dict[str, tuple[str, float]] = {}
        out = []
        for m in sorted(group.to_pylist(), key=lambda r: r["step"]):
            node, high = f"#{m['step'] + 1}", m["height"] / 2
            for leaf in (m["a"], m["b"]):
                child, low = at.get(leaf, (leaf, 0.0))
                out.append((child, node, high - low))
            at[m["a"]] = (node, high)
        return [*out, (node, None, 0.0)] if out else []

    return _each(merges, "tree string, node string, parent string, length double", _EDGES, run)


def _below(edges: list[dict]) -> tuple[dict[str | None, list[str]], list[str]]:
    """Children of every node, sorted, and all nodes with children before parents."""
    children: dict[str | None, list[str]] = {}
    for e in edges:
        children.setdefault(e["parent"], []).append(e["node"])
    order, todo = [], list(children.get(None, []))
    while todo:
        node = todo.pop()
        order.append(node)
        todo += children.get(node, [])
    return {k: sorted(v) for k, v in children.items()}, order[::-1]


def splits(edges: DataFrame) -> DataFrame:
    """(tree, split): every split of the leaves in two that an edge makes, with two leaves or more on either side. A split goes
    by the leaves on the side without the smallest leaf, sorted and joined by commas; leaf sets are bit sets."""

    def run(_: str, group: pa.Table) -> list[tuple]:
        children, order = _below(group.to_pylist())
        leaves = sorted(n for n in order if n not in children)
        bit = {leaf: 1 << i for i, leaf in enumerate(leaves)}
        full, under, found = (1 << len(leaves)) - 1, {}, set()
        for node in order:
            under[node] = bit[node] if node in bit else sum(under[c] for c in children[node])  # disjoint sets
            side = full ^ under[node] if under[node] & 1 else under[node]
            if 2 <= side.bit_count() <= len(leaves) - 2:
                found.add(side)
        return [(",".join(leaf for leaf in leaves if side & bit[leaf]),) for side in sorted(found)]

    return _each(edges, "tree string, split string", pa.schema([("tree", pa.string()), ("split", pa.string())]), run)


def split_distance(x: DataFrame, y: DataFrame) -> DataFrame:
    """(tree, shared, only_x, only_y, distance): splits that two trees of one name share and don't (``distance``: Robinson and
    Foulds). Trees without any split on either side are not there."""
    both = x.select("tree", "split", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(y.select("tree", "split", F.lit(0).alias("x"), F.lit(1).alias("y")))
    seen = both.groupBy("tree", "split").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    sums = seen.groupBy("tree").agg(F.sum(F.col("x") * F.col("y")).alias("shared"), F.sum(F.col("x") * (1 - F.col("y"))).alias("only_x"), F.sum(F.col("y") * (1 - F.col("x"))).alias("only_y"))
    return sums.withColumn("distance", F.col("only_x") + F.col("only_y"))


def rooted(edges: DataFrame, outgroup: str | None = None) -> DataFrame:
    """``edges`` (tree, node, parent, length) hung up anew at "root", in the middle of the edge to the leaf ``outgroup``, or, without
    one, half way along the longest path between two leaves (of equally long ones the first by name)."""

    def run(_: str, group: pa.Table) -> list[tuple]:
        rows = group.to_pylist()
        for e in rows:  # a root from before is an inner node now
            e["node"], e["parent"] = ("#root" if x == "root" else x for x in (e["node"], e["parent"]))
        near: dict[str, dict[str, float]] = {}
        for e in rows:
            if e["parent"] is not None:
                near.setdefault(e["node"], {})[e["parent"]] = near.setdefault(e["parent"], {})[e["node"]] = e["length"]
        if not near:
            return [(e["node"], None, 0.0) for e in rows]
        leaves = sorted(n for n in near if len(near[n]) == 1)

        def walk(start: str) -> tuple[dict[str, float], dict[str, str]]:
            far, back, todo = {start: 0.0}, {}, [start]
            while todo:
                at = todo.pop()
                for to, length in near[at].items():
                    if to not in far:
                        far[to], back[to] = far[at] + length, at
                        todo.append(to)
            return far, back

        if outgroup is not None:
            if outgroup not in leaves:
                raise ValueError(f"no leaf {outgroup}")
            (other,) = near[outgroup]
            one, two, part = outgroup, other, near[outgroup][other] / 2
        else:
            far, _back = walk(leaves[0])  # the end of a longest path is the leaf furthest from any leaf
            first = min(leaves, key=lambda n: (-round(far[n], 12), n))
            far, back = walk(first)
            two = min(leaves, key=lambda n: (-round(far[n], 12), n))
            half = far[two] / 2
            while far[back[two]] > half:
                two = back[two]
            one, part = back[two], half - far[back[two]]
        length = near[one].pop(two)
        near[two].pop(one)
        near["root"] = {one: part, two: length - part}
        near[one]["root"], near[two]["root"] = part, length - part
        far, back = walk("root")
        alone = {n for n in near if n != "root" and len(near[n]) == 2}  # the old root, if it joins but two edges now

        def above(node: str) -> str:
            while back[node] in alone:
                node = back[node]
            return back[node]

        kept_nodes = [n for n in far if n != "root" and n not in alone]
        return [*((n, above(n), far[n] - far[above(n)]) for n in sorted(kept_nodes)), ("root", None, 0.0)]

    return _each(edges, "tree string, node string, parent string, length double", _EDGES, run)


def written_trees(edges: DataFrame) -> DataFrame:
    """(tree, newick, drawing): each tree in Newick's form and as lines of text, children by their smallest leaf. Names with other
    signs than letters, digits and _.#- stand in single quotes, quotes in them doubled; lengths have six places."""

    def run(_: str, group: pa.Table) -> list[tuple]:
        rows = group.to_pylist()
        children, order = _below(rows)
        length = {e["node"]: e["length"] for e in rows}
        least: dict[str, str] = {}
        text: dict[str, str] = {}
        for node in order:
            inside = sorted(children.get(node, []), key=lambda c: least[c])
            least[node] = min((least[c] for c in inside), default=node)
            name = node if all(c.isalnum() or c in "_.#-" for c in node) else "'" + node.replace("'", "''") + "'"
            head = "(" + ",".join(f"{text[c]}:{length[c]:.6f}" for c in inside) + ")" if inside else name
            text[node] = head
        if not order:
            return []
        lines, todo = [], [(order[-1], 0)]
        while todo:
            node, deep = todo.pop()
            lines.append("  " * deep + (node if node not in children else "+"))
            todo += [(c, deep + 1) for c in sorted(children.get(node, []), key=lambda c: least[c], reverse=True)]
        return [(text[order[-1]] + ";", "\n".join(lines))]

    return _each(edges, "tree string, newick string, drawing string", pa.schema([("tree", pa.string()), ("newick", pa.string()), ("drawing", pa.string())]), run)


def cut_trees(merges: DataFrame, groups: int | None = None) -> DataFrame:
    """(tree, leaf, place, group, groups, height): leaves in the order of the drawn tree (the branch with the smallest leaf
    first) and the groups that are left below the widest gap between two heights (of equally wide ones the lowest; a tree
    with one height, or all the same, is one group), or ``groups`` groups if given. Groups are numbered in leaf order;
    ``height`` is the cut, half way up the gap."""
    types = pa.schema([("tree", pa.string()), ("leaf", pa.string()), ("place", pa.int32()), ("group", pa.int32()), ("groups", pa.int32()), ("height", pa.float64())])

    def run(_: str, table: pa.Table) -> list[tuple]:
        rows = sorted(table.to_pylist(), key=lambda r: r["step"])
        heights = [r["height"] for r in rows]
        n = len(rows) + 1
        if groups is not None:
            done = n - max(1, min(groups, n))
        else:
            gaps = [round(y - x, 9) for x, y in zip(heights, heights[1:])]
            done = gaps.index(max(gaps)) + 1 if gaps and max(gaps) > 0 else len(rows)
        high = heights[-1] if done == len(rows) else (heights[done] + (heights[done - 1] if done else 0.0)) / 2
        member: dict[str, list[str]] = {}
        cut: dict[str, list[str]] = {}
        for i, r in enumerate(rows):
            if i == done:
                cut = {k: list(v) for k, v in member.items()}
            a, b = member.pop(r["a"], [r["a"]]), member.pop(r["b"], [r["b"]])
            member[r["a"]] = a + b
        if done == len(rows):
            cut = dict(member)
        ((_, leaves),) = member.items()
        of = {leaf: first for first, all_of in cut.items() for leaf in all_of}
        number: dict[str, int] = {}
        out = []
        for place, leaf in enumerate(leaves):
            out.append((leaf, place, number.setdefault(of.get(leaf, leaf), len(number))))
        return [(leaf, place, group, len(number), high) for leaf, place, group in out]

    return _each(merges, "tree string, leaf string, place int, group int, groups int, height double", types, run)


def contamination(readings: DataFrame, least: float = 5, share: float = 0.2, margin: float = 2) -> DataFrame:
    """(witness, clade, other, chances, taken, support, back, mixed): how often a witness leaves its own clade for another's reading.

    ``readings``: unit, witness, clade, reading (one a unit and witness; null readings and clades are left out). A
    clade's reading in a unit is the one that over half of its witnesses there have. A chance is a unit where the witness's
    clade and the other have different readings; it is taken if the witness has the other's, which counts as one
    divided by the number of clades that have the same. ``back`` is the most that a witness of the other clade
    takes the other way: who copies leaves its own clade, while the clade it copies from does not, which tells the
    direction. ``mixed``: support of ``least`` or more, of ``share`` of the chances, and ``margin`` times what goes back."""
    read = kept(readings.where("reading is not null and clade is not null").select("unit", "witness", "clade", "reading"), "readings")
    counts = read.groupBy("unit", "clade", "reading").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("unit", "clade").agg(F.max(F.struct("n", "reading")).alias("m"), F.sum("n").alias("all")).where(2 * F.col("m.n") > F.col("all"))
    homes = kept(most.select("unit", "clade", F.col("m.reading").alias("home")), "homes")
    own = read.join(homes, ["unit", "clade"])
    foreign = homes.select("unit", F.col("clade").alias("other"), F.col("home").alias("theirs"))
    met = own.join(foreign, "unit").where("other <> clade and theirs <> home").withColumn("hit", F.col("theirs") == F.col("reading"))
    each = met.withColumn("rivals", F.sum(F.col("hit").cast("int")).over(Window.partitionBy("unit", "witness")))
    one = F.when(F.col("hit"), 1.0 / F.col("rivals")).otherwise(0.0)
    sums = kept(each.groupBy("witness", "clade", "other").agg(F.count(F.lit(1)).alias("chances"), F.count(F.when(F.col("hit"), 1)).alias("taken"), F.sum(one).alias("support")), "sums")
    back = sums.groupBy(F.col("other").alias("clade"), F.col("clade").alias("other")).agg(F.max("support").alias("back"))
    out = sums.join(back, ["clade", "other"], "left").withColumn("back", F.coalesce("back", F.lit(0.0)))
    mixed = (F.col("support") >= least) & (F.col("support") >= share * F.col("chances")) & (F.col("support") >= margin * F.col("back"))
    return out.select("witness", "clade", "other", "chances", "taken", "support", "back", mixed.alias("mixed"))
