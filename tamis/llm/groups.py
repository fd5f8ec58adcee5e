"""Pairwise matches consolidated into groups, on a two-dimensional grid of edge blocks.

Vertices are hashed into `side` blocks, so every edge lies in one cell of a side x side grid; the edges of a hub spread
over a whole row of cells. Each round runs union-find on the edges of each cell on its own, which gives every vertex of
the cell a representative, the smallest vertex of its part. Then the representatives of a vertex from all cells of its row
and column are exchanged: the vertex takes the smallest, and the others are linked to it, as edges between
representatives for the next round. A vertex that has a smaller neighbour never comes back, so each round at least halves the
vertices. Rounds end when no edge is left: parents are stable.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import durable

#: Edges that one cell holds on average: the memory of one union-find.
CELL_EDGES = 200_000


def union_find(left: list[str], right: list[str]) -> dict[str, str]:
    """The smallest vertex of its part for each vertex of a list of edges."""
    parent: dict[str, str] = {}

    def root(v: str) -> str:
        top = v
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[v] != top:
            parent[v], v = top, parent[v]
        return top

    for a, b in zip(left, right):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in list(parent)}


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find on one task's cells: rows are sorted by cell, so one cell is held at a time."""
    cell, left, right = None, [], []
    for batch in batches:
        for c, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if c != cell and left:
                yield from _emit(left, right)
                left, right = [], []
            cell = c
            left.append(a)
            right.append(b)
    if left:
        yield from _emit(left, right)


def _emit(left: list[str], right: list[str]) -> Iterator[pa.RecordBatch]:
    found = union_find(left, right)
    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.string())], ["v", "r"])


def consolidate(edges: DataFrame, a: str = "a", b: str = "b", cell_edges: int = CELL_EDGES, max_rounds: int = 100) -> DataFrame:
    """(v, r): every vertex of an edge with two different non-null sides, with the smallest vertex that it reaches.

    Vertices compare as strings by code point (UTF-8 bytes). Repeated edges, either side first, count once; edges with
    a null side or two equal sides are no edges, and their vertices come out only where another edge has them. An empty table
    gives no rows. Other columns are ignored. Each round is written to the shared checkpoint folder.
    """
    e = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).filter("a <> b")
    e = durable(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = e.count()
    steps: list[DataFrame] = []
    while n > 0:
        if len(steps) == max_rounds:
            raise RuntimeError("groups didn't become stable")
        side = max(2, int((n / cell_edges) ** 0.5) + 1)
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        cells = e.select((block("a") * side + block("b")).cast("int").alias("cell"), "a", "b")
        local = cells.repartition(min(side * side, 4096), "cell").sortWithinPartitions("cell").mapInArrow(_cells, "v STRING, r STRING")
        # a vertex has a representative in each cell of one row and one column at most, so the set is bounded by 2 * side
        exchanged = durable(local.groupBy("v").agg(F.min("r").alias("p"), F.collect_set("r").alias("rs")))
        # what the cells disagree on becomes an edge between representatives; their number is known before equal ones are merged
        n = exchanged.agg(F.sum(F.size("rs") - 1)).first()[0] or 0
        e = exchanged.select(F.col("p").alias("a"), F.explode("rs").alias("b")).filter("a <> b").distinct()
        steps.append(exchanged.select("v", "p"))
    if not steps:
        return e.select(F.col("a").alias("v"), F.col("b").alias("r"))
    # each round's vertices are representatives of the round before, so the parents are followed round by round
    labels = steps[0].withColumnRenamed("p", "r")
    for step in steps[1:]:
        labels = labels.join(step.withColumnRenamed("v", "r"), "r", "left").select("v", F.coalesce("p", "r").alias("r"))
    return durable(labels)
