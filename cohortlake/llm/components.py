"""Consolidating pairwise matches into groups: hierarchical union-find over bounded edge partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.session import Scratch, table

_STAR = "part int, vertex long, root long"


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and, for each, the smallest vertex of its component; both ends of each edge given.

    Roots hook onto smaller roots and paths are halved until no edge joins two trees.
    """
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(ids))
    while len(a):
        a, b = parent[a], parent[b]
        keep = a != b
        a, b = a[keep], b[keep]
        if not len(a):
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((low, high))
        first = np.r_[True, high[order][1:] != high[order][:-1]]
        parent[high[order][first]] = low[order][first]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return ids, ids[parent]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's edges, batch by batch: only the spanning forest so far is kept between batches."""
    trees: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        for part, g in pdf.groupby("part", sort=False):
            u, v = g["u"].to_numpy(), g["v"].to_numpy()
            if part in trees:
                u, v = np.concatenate([trees[part][0], u]), np.concatenate([trees[part][1], v])
            trees[part] = union_find(u, v)
    for part, (vertex, root) in trees.items():
        yield pd.DataFrame({"part": np.int32(part), "vertex": vertex, "root": root})


def connected_components(edges: DataFrame, near: str | None = None, bound: int = 200_000, scratch: Scratch | None = None) -> DataFrame:
    """Groups of vertices that ``edges`` (u BIGINT, v BIGINT[, near]) link directly or indirectly.

    Returns (vertex, root), one row for each vertex on an edge between two different vertices; root is
    the smallest vertex of the group. Null ends and self pairs link nothing; repeated and reversed
    pairs count once; other columns are ignored; no edges give an empty table.

    Level by level: edges go to partitions of about ``bound`` edges (by ``near`` at first, then by the
    smaller end, hot keys spread by the pair), each partition keeps only its spanning forest as stars,
    a vertex that lies in one partition only is settled onto its star's root, and the stars of shared
    vertices are the edges of the next, smaller level. A task thus never holds more than its share of
    the edges. Settled vertices are then unwound from the last level to the first.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "components")
    key = F.col(near).cast("string") if near else F.lit(None).cast("string")
    e = edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), key.alias("near")).where("u is not null and v is not null and u <> v")
    e = scratch.save(e, "edges")
    levels: list[DataFrame] = []
    n, stalled = e.count(), 0
    while n:
        parts = max(1, math.ceil(n / bound))
        # by the smaller and the larger end in turns, under a hash of the level's own, so that no placing that stalls comes back
        salt = F.lit(len(levels))
        place = F.coalesce(F.xxhash64("near"), F.xxhash64("v" if len(levels) % 2 else "u", salt))
        if parts > 1:
            # keys that would fill more than half of a partition are spread by the pair itself
            hot = e.withColumn("_k", place).groupBy("_k").count().where(F.col("count") > bound // 2).select("_k", F.lit(True).alias("_hot"))
            e = e.withColumn("_k", place).join(hot, "_k", "left")
            place = F.when(F.col("_hot"), F.xxhash64("u", "v", salt)).otherwise(F.col("_k"))
        placed = e.select(F.pmod(place, F.lit(parts)).cast("int").alias("part"), "u", "v")
        stars = scratch.save(placed.repartition(parts, "part").mapInPandas(_forest, _STAR), "stars")
        if parts == 1:
            levels.append(scratch.save(stars.select("vertex", "root"), "level"))
            scratch.drop(stars, e)
            break
        seen = stars.groupBy("vertex").agg(F.count("*").alias("k"), F.min("root").alias("root"), F.max("root").alias("most"))
        settled = seen.where("k = 1 and vertex <> root").select("vertex", "root")
        shared = seen.where("k > 1").select("vertex")
        up = stars.where("vertex <> root").join(shared, "vertex", "left_semi")
        nxt = up.select(F.least("vertex", "root").alias("u"), F.greatest("vertex", "root").alias("v"), F.lit(None).cast("string").alias("near")).distinct()
        # a vertex that is a root wherever it lies may have no edge above; it keeps its own name unless it has
        own = seen.where("vertex = root and vertex = most").select("vertex", "root")
        levels.append(scratch.save(settled.unionByName(own), "level"))
        old, e = e, scratch.save(nxt, "edges")
        m = e.count()
        scratch.drop(stars, old)
        stalled = stalled + 1 if m >= n else 0
        if stalled == 4:  # no placing of four made progress
            bound, stalled = bound * 2, 0
        n = m
    if not levels:
        return spark.createDataFrame([], "vertex long, root long")
    out = levels[-1]
    for lower in reversed(levels[:-1]):
        above = out.select(F.col("vertex").alias("_v"), F.col("root").alias("_r"))
        known = lower.join(above, lower["root"] == F.col("_v"), "left").select("vertex", F.coalesce("_r", "root").alias("root"))
        fresh = above.join(lower, above["_v"] == lower["vertex"], "left_anti").select(F.col("_v").alias("vertex"), F.col("_r").alias("root"))
        out = scratch.save(known.unionByName(fresh), "labels")
    return out


def region_edges(rois: DataFrame, links: DataFrame, lesions: DataFrame) -> DataFrame:
    """Edges between regions: matched pairs, and a star over the regions that one lesion lists.

    Ends that are not in ``rois`` link nothing. A region listed twice, null keys and null lists link
    nothing. Returns (u, v, near) where near is the patient, as a hint for placing.
    """
    regions = rois.where("roi_id is not null").select("roi_id", "pid", "image_index", "roi_idx_in_slice").distinct()
    ids = regions.select("roi_id").distinct()
    pairs = links.where("is_match").select("roi_a", "roi_b", "pid").where("roi_a <> roi_b").distinct()
    pairs = pairs.join(ids, pairs["roi_a"] == ids["roi_id"], "left_semi").join(ids, pairs["roi_b"] == ids["roi_id"], "left_semi")
    lists = lesions.where("size(roi_keys) > 1 and pid is not null").select("pid", "roi_keys").distinct()
    one = lists.select("pid", F.xxhash64("pid", "roi_keys").alias("list"), F.hash("roi_keys", "pid").alias("list2"), F.explode("roi_keys").alias("k"))
    one = one.select("pid", "list", "list2", F.col("k.image_index").alias("image_index"), F.col("k.roi_idx").alias("roi_idx_in_slice"))
    found = one.join(regions, ["pid", "image_index", "roi_idx_in_slice"])
    # the regions of one list, a number bounded by the row that listed them
    stars = found.groupBy("pid", "list", "list2").agg(F.collect_set("roi_id").alias("ids")).where("size(ids) > 1")
    stars = stars.select("pid", F.array_min("ids").alias("u"), F.explode("ids").alias("v")).where("u <> v")
    return pairs.select(F.col("roi_a").alias("u"), F.col("roi_b").alias("v"), F.col("pid").alias("near")).unionByName(stars.select("u", "v", F.col("pid").alias("near")))


def p4_found(spark, sf_dir: str) -> DataFrame:
    edges = region_edges(table(spark, sf_dir, "rois"), table(spark, sf_dir, "roi_links"), table(spark, sf_dir, "lesions"))
    return connected_components(edges, near="near").select(F.col("vertex").alias("roi_id"), F.col("root").alias("group_id"))
