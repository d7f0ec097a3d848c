"""Reading order of boxes on pages: cuts at gutters and between bands."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A gutter is so many times as wide as the middle height of a page's boxes.
GUTTER = 1.5

Box = tuple[float, float, float, float, int]


def cover(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Spans from left to right put together where they meet."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def gaps(covered: list[tuple[float, float]], wide: float) -> list[float]:
    """Where gutters of at least that width begin."""
    return [a[1] for a, b in zip(covered, covered[1:]) if b[0] - a[1] >= wide]


def bands(boxes: list[Box]) -> list[list[Box]]:
    """Boxes as lines from the top: a box belongs to the line before if they share at least half of the lower one's height."""
    out: list[list[Box]] = []
    top = bottom = 0.0
    for box in sorted(boxes, key=lambda b: (b[1], b[0])):
        low = min(bottom, box[3]) - max(top, box[1])
        if out and low >= 0.5 * min(bottom - top, box[3] - box[1]) and low >= 0:
            out[-1].append(box)
            top, bottom = min(top, box[1]), max(bottom, box[3])
        else:
            out.append([box])
            top, bottom = box[1], box[3]
    return out


def ordered(boxes: list[Box], wide: float) -> list[tuple[int, int, int]]:
    """(box, block, line) in reading order.

    A set of boxes with a gutter from top to bottom is cut there, and its columns are read one after the other. Without one,
    lines are put together from the top for as long as they have a gutter in common, or none has any; where there are
    several such groups, each is read in turn, and a group without a gutter is read line by line. A column is a block, and
    so is what runs across."""
    out: list[tuple[int, int, int]] = []
    block = line = 0
    todo: list[list[Box]] = [boxes]
    while todo:
        some = todo.pop()
        edges = gaps(cover([(b[0], b[2]) for b in some]), wide)
        if edges:
            columns: list[list[Box]] = [[] for _ in range(len(edges) + 1)]
            for b in some:
                columns[sum(b[0] > e for e in edges)].append(b)
            todo += columns[::-1]
            continue
        groups: list[list[list[Box]]] = []
        across: list[tuple[float, float]] = []
        for band in bands(some):
            own = cover([(b[0], b[2]) for b in band])
            both = cover(across + own)
            # a gutter in common, none at all, or a line that begins a column beside the one before
            if groups and (gaps(both, wide) or not (gaps(across, wide) or gaps(own, wide))):
                groups[-1].append(band)
                across = both
            else:
                groups.append([band])
                across = own
        if len(groups) > 1:
            todo += [[b for x in g for b in x] for g in groups[::-1]]
            continue
        for band in groups[0] if groups else []:
            out += [(b[4], block, line) for b in sorted(band)]
            line += 1
        block += 1
    return out


def reading_order(boxes: DataFrame, gutter: float = GUTTER, vertical: bool = False) -> DataFrame:
    """(page, box, block, line, place): the boxes of every page in reading order, place from 0. ``boxes``: page, box, x0, y0, x1, y1,
    y downwards. ``vertical``: lines run from top to bottom and follow each other from right to left.

    Other columns of ``boxes`` go along, after place. Boxes with a null or reversed side are left out; boxes on one place go by their number; a task holds the boxes of one
    page. Pages without boxes are not there."""
    more = [c for c in boxes.columns if c not in ("page", "box", "x0", "y0", "x1", "y1")]
    some = boxes.where("x0 <= x1 and y0 <= y1")
    if vertical:  # turned by a quarter, lines run from left to right and downwards
        some = some.select("page", "box", F.col("y0").alias("x0"), (-F.col("x1")).alias("y0"), F.col("y1").alias("x1"), (-F.col("x0")).alias("y1"), *more)
    kinds = dict(boxes.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("box")
        rows = list(zip(*(table[c].to_pylist() for c in ("x0", "y0", "x1", "y1")), range(table.num_rows)))
        heights = sorted(r[3] - r[1] for r in rows)
        found = ordered(rows, gutter * max(heights[len(heights) // 2], 1e-9))
        at = pa.array([f[0] for f in found], pa.int64())
        return pa.table([table["page"].take(at), table["box"].take(at), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), pa.array(range(len(found)), pa.int32()), *(table[c].take(at) for c in more)], names=["page", "box", "block", "line", "place", *more])

    some = some.select("page", "box", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), *more)
    return some.groupBy("page").applyInArrow(run, f"page {kinds['page']}, box {kinds['box']}, block int, line int, place int" + "".join(f", `{c}` {kinds[c]}" for c in more))
