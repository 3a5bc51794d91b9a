"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Links that one task joins at once; a task gets about so many.
AT_ONCE = 500_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each ``AT_ONCE`` links their components: a link (node, least node) for every node but the least."""
    parent: dict[int, int] = {}
    held = 0

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pa.RecordBatch:
        nonlocal held
        links = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        held = 0
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        held += batch.num_rows
        if held >= AT_ONCE:
            yield flush()
    yield flush()


def connected_components(links: DataFrame, of: int | None = None) -> DataFrame:
    """For links (a, b): each node and its component, which is the smallest node in it: node, component.

    Each task first joins the links that it holds, a bounded number at once, so that each of these sets becomes a star about its least node. Where
    one set held all links, that is the result. Else large-star and small-star steps alternate until nothing changes: every node's larger neighbours, then its
    smaller ones and itself, are linked to its smallest neighbour. The number of rounds grows with the
    logarithm of the longest chain, and there are never more links than at first. Minima are taken before
    the shuffle; a step is written to the shared folder, so a lost executor doesn't undo earlier ones.
    Null ends and links of a node to itself are left out. ``of`` is the number of documents that the links are about (``materialise``).
    """
    given = materialise(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", of=of)
    n = given.count()
    tasks = max(1, -(-n // AT_ONCE))
    edges = materialise(given.coalesce(tasks).mapInArrow(_forests, "a long,b long"), "forests")
    discard(given)
    whole, before = tasks == 1 and n < AT_ONCE, None
    while not whole:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large-star", of=n)
        discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialise(small, "small-star", of=n)
        discard(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        whole = now == before
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
