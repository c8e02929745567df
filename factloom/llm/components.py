"""Connected groups out of pairwise links (problem 5).

Each level merges the spanning forests of several partitions in one bounded partition, runs union-find there and keeps
only a spanning forest again (stars). Centres are chosen by a priority that is drawn anew for each level, and every
vertex is then contracted into the best of its centres, so that about half of the vertices remain after each level, on
chains with rising ids too. No task ever holds more than ``block`` edges and their vertices. What is left at the end fits
one task; the pointers of the levels are followed back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.tables import cut

EDGE, STAR = "a long, b long", "a long, b long, r long"


def priority(ids: np.ndarray, level: int) -> np.ndarray:
    """A random order of all 64-bit ids: a bijection, so that no two are equal."""
    x = ids.astype(np.uint64) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) ^ np.uint64(1 << 63)).view(np.int64)


def stars(a: np.ndarray, b: np.ndarray, level: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union-find over the edges: (vertex, centre, centre's priority) for each vertex but the centres.

    A centre is the vertex of least priority in its component, of the smallest id where ``level`` is None.
    """
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    rank_of = ids if level is None else priority(ids, level)
    order = np.argsort(rank_of)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    u, v = rank[inverse[: len(a)]], rank[inverse[len(a) :]]
    parent = np.arange(len(ids))
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    child = np.flatnonzero(parent != np.arange(len(ids)))
    centre = order[parent[child]]
    return ids[order[child]], ids[centre], rank_of[centre]


def _forest(block: int, level: int | None):
    def run(batches):
        a = b = r = np.empty(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
            b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(a) >= block:
                a, b, r = stars(a, b, level)
                if len(a) > block // 2:  # mostly forest: let it go, so that the task stays bounded
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, r)], ["a", "b", "r"])
                    a = b = np.empty(0, np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b, level)], ["a", "b", "r"])

    return run


def contract(edges: DataFrame, block: int, fan_in: int) -> tuple[DataFrame, list[DataFrame]]:
    """(edges that are left, pointers (id, p) of every level's vertices to the ones of the next)."""
    levels: list[DataFrame] = []
    forest = cut(edges.mapInArrow(_forest(block, 0), STAR))
    count, width = forest.count(), forest.rdd.getNumPartitions()
    while count > block:
        level = len(levels) + 1
        width = max(-(-count // block), -(-width // fan_in))
        # forests of `fan_in` partitions meet in one, where union-find joins them again
        merged = cut(forest.select("a", "b").repartition(width).mapInArrow(_forest(block, level), STAR))
        own = merged.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("r")).distinct()
        # a vertex has at most one centre per partition, so the set is bounded by their number
        seen = merged.union(own).groupBy("a").agg(F.coalesce(F.min_by("b", "r"), "a").alias("p"), F.collect_set("b").alias("centres"))
        seen = cut(seen)
        levels.append(seen.select(F.col("a").alias("id"), "p"))
        # an edge between a vertex and a centre joins what the two are contracted into
        rest = seen.select(F.col("p").alias("a"), F.explode("centres").alias("b")).distinct()
        rest = rest.join(seen.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b")).where("a <> b")
        forest = cut(rest.mapInArrow(_forest(block, level), STAR))
        count = forest.count()
    return forest.select("a", "b"), levels


def connected_groups(links: DataFrame, a: str, b: str, block: int = 100_000, fan_in: int = 8) -> DataFrame:
    """(id, group_id) for every record that a link joins to another one; ``group_id`` is the smallest id of its group.

    ``links`` needs two long columns ``a`` and ``b``; others are not read, whatever their names. Rows with a null on
    either side and links of a record with itself are not counted; repeated links and both directions are one link. An
    empty table gives an empty result. ``block``: edges that a task holds at once; ``fan_in``: forests merged into one
    partition at each level, of which there are about log2(links / block).
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    left, levels = contract(edges, block, fan_in)
    last = left.coalesce(1).mapInArrow(_forest(4 * block, None), STAR)  # at most `block` edges: within one task's bound
    groups = last.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    groups = groups.union(groups.select("group_id", "group_id").distinct())
    if not levels:
        return groups
    for pointers in reversed(levels):
        known = groups.withColumnRenamed("id", "p")
        groups = pointers.join(known, "p", "left").select("id", F.coalesce("group_id", "p").alias("group_id"))
    groups = cut(groups)
    # contraction names a group after any of its records
    least = groups.groupBy("group_id").agg(F.min("id").alias("least"))
    return groups.join(least, "group_id").select("id", F.col("least").alias("group_id"))
