"""Dumps of marked-up pages: records at the bounds of splits, and nested markup as layered segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Templates and elements that are layers of their own; what other templates say first is text.
LAYERS = frozenset(["note", "ref", "commentary", "gloss", "small", "variant", "title"])
_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\||<!--.*?(?:-->|\Z)|</?(?:note|ref|commentary|gloss|small|variant)(?:\s[^<>]*)?/?>|^=+[^\n=][^\n]*?=+[ \t]*$", re.S | re.M)


def read_records(spark: SparkSession, path: str, element: str = "page") -> DataFrame:
    """(file, record): what stands between <element> and </element>, for every file under ``path`` (compressed ones too).

    The end tag is the reader's line separator, so Spark cuts large files into splits and reads a record that lies across two
    in the split where it begins, once. What is outside of records is left out; a last record without an end goes to the end of
    its file."""
    lines = spark.read.option("lineSep", f"</{element}>").option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), F.col("value"))
    start = rf"(?s)^.*?<{element}(?:\s[^<>]*)?>(.*)$"
    return lines.where(F.col("value").rlike(start)).select("file", F.regexp_extract("value", start, 1).alias("record"))


def field(record: Column, name: str) -> Column:
    """The text of the first element of that name, character references decoded; null without one."""
    found = F.regexp_extract(record, rf"(?s)<{name}(?:\s[^<>]*)?>(.*?)</{name}>", 1)
    out = F.when(record.rlike(rf"<{name}[\s>]"), found)
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(sign))
    return out


def escaped(text: Column) -> Column:
    """``field`` taken back."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def segments_of(markup: str) -> list[tuple[str, str, str]]:
    """(path, layer, text) of a page in order. ``path``: headings above, by their level, joined by " / "; ``layer``: "text", or the
    layers around it, joined by "/". A template of a layer's name gives its parameters as that layer; another template's name
    and a link's target say nothing, and the last parameter of a link is its text. Comments are left out, layers end with the
    page at the latest, ends without a beginning are text. Text keeps its white space; empty segments are not there."""
    out: list[tuple[str, str, str]] = []
    path: list[tuple[int, str]] = []
    # open brackets: what closes it, its layer or None, the place in ``parts`` where it began, its name or None if not read yet
    stack: list[list] = []
    parts: list[str] = []

    def layer() -> str:
        return "/".join(["text", *(s[1] for s in stack if s[1])])

    def flush() -> None:
        text = "".join(parts)
        parts.clear()
        if text.strip():
            where, said = " / ".join(h for _, h in path), layer()
            if out and out[-1][:2] == (where, said):
                out[-1] = (where, said, out[-1][2] + text)
            else:
                out.append((where, said, text))

    at = 0
    for m in _TOKEN.finditer(markup):
        parts.append(markup[at : m.start()])
        at, token = m.end(), m.group()
        if token.startswith("<!--"):
            continue
        if token.startswith("="):
            if any(s[1] or s[0] in ("}}", "]]") for s in stack):
                parts.append(token)
                continue
            flush()
            level = len(token) - len(token.lstrip("="))
            path = [p for p in path if p[0] < level] + [(level, token.strip().strip("=").strip())]
        elif token in ("{{", "[["):
            stack.append(["}}" if token == "{{" else "]]", None, len(parts), None])
        elif token == "|":
            if not stack or stack[-1][0] not in ("}}", "]]"):
                parts.append(token)
            elif stack[-1][0] == "]]":
                del parts[stack[-1][2] :]
            elif stack[-1][3] is None:
                name = "".join(parts[stack[-1][2] :]).strip().lower()
                del parts[stack[-1][2] :]
                flush()
                stack[-1][3] = name
                stack[-1][1] = name if name in LAYERS else None
                stack[-1][2] = len(parts)
            else:
                parts.append(" ")
        elif token in ("}}", "]]"):
            if not any(s[0] == token for s in stack):
                parts.append(token)
                continue
            while True:
                top = stack[-1]
                if top[0] == "}}" and top[3] is None:
                    del parts[top[2] :]  # a template without parameters
                if top[1]:
                    flush()
                stack.pop()
                if top[0] == token:
                    break
        elif token.startswith("</"):
            name = token[2:-1].strip().lower()
            if not any(s[0] == f"</{name}" for s in stack):
                parts.append(token)
                continue
            flush()
            while stack.pop()[0] != f"</{name}":
                pass
        elif not token.endswith("/>"):
            flush()
            name = re.match(r"<(\w+)", token)[1].lower()
            stack.append([f"</{name}", name, 0, ""])
    parts.append(markup[at:])
    while stack:  # what is open ends with the page
        if stack[-1][0] == "}}" and stack[-1][3] is None:
            del parts[stack[-1][2] :]
        if stack[-1][1]:
            flush()
        stack.pop()
    flush()
    return out


def segments(pages: DataFrame) -> DataFrame:
    """(page, seq, path, layer, text) of ``pages`` (page, markup), seq from 0, as ``segments_of`` cuts them. Null and empty pages have
    none; repeated pages give theirs each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, markup in enumerate(batch.column(1)):
                found = segments_of(markup.as_py() or "")
                which += [i] * len(found)
                rows += [(seq, *s) for seq, s in enumerate(found)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["page", "seq", "path", "layer", "text"])

    return pages.select("page", "markup").mapInArrow(run, f"page {dict(pages.dtypes)['page']}, seq int, path string, layer string, text string")
