"""Deeply nested records as flat tables: adjacency-table shredding, then entity tables by joins."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.session import Scratch, table

# fixed values: labels under which the dialects keep the same thing
SLICE_LISTS = ("slices", "Images")
REGION_LISTS = ("rois", "ROIs")
IMAGE_INDEX = ("image_index", "ImageIndex")
PIXELS = ("points_px", "Point_px")
MILLIMETRES = ("points_mm", "Point_mm")
NAMES = ("vessel_raw", "Name")
AREAS = ("area_cm2", "Area")

_MARKS = "\ufeff \t\r\n\u00a0"


def _opened(value):
    """JSON text inside a string is opened where it holds an object, a list or such text again, as deep as it goes (each layer is shorter)."""
    while isinstance(value, str) and value.strip(_MARKS)[:1] in ("[", "{", '"'):
        try:
            inner = json.loads(value.strip(_MARKS))
        except (ValueError, RecursionError):
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def _walk(text: str) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar) of one payload, breadth first from node 0."""
    try:
        queue = deque([(0, None, None, 0, json.loads(text.strip(_MARKS)))])
    except (ValueError, RecursionError):
        return
    taken = 1
    while queue:
        node, parent, label, ordinal, value = queue.popleft()
        value = _opened(value)
        inner = value.items() if isinstance(value, dict) else ((None, x) for x in value) if isinstance(value, list) else ()
        kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "scalar"
        scalar = None if kind != "scalar" else value if isinstance(value, str) else json.dumps(value)
        yield node, parent, label, ordinal, kind, scalar
        for i, (name, x) in enumerate(inner):
            queue.append((taken, node, name, i, x))
            taken += 1


def _shredder(key: str):
    columns = [key, "node", "parent", "label", "ordinal", "kind", "scalar"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for k, text in zip(pdf[key], pdf["_t"]):
                for row in _walk(text):
                    rows.append((k, *row))
                    if len(rows) >= 50_000:
                        yield _frame(rows, columns)
                        rows = []
        if rows:
            yield _frame(rows, columns)

    return run


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["parent"] = out["parent"].astype("Int32")
    return out


def shred(records: DataFrame, key: str, payload: str, scratch: Scratch | None = None) -> DataFrame:
    """The adjacency table of JSON payloads.

    One row per node: ``key``, node (a number within the payload, 0 at the root), parent (null at the
    root), label (member name or null), ordinal (place in the parent, from 0), kind (object, array,
    scalar, null) and scalar (text of a scalar). Blanks and a byte order mark around a payload are
    dropped; JSON text inside a string is opened; of members with the same name the last counts. A
    payload that is null, empty or incomplete gives no row. If several rows share a key, the least of
    their payloads is shredded: revisions must come under keys of their own.
    """
    scratch = scratch or Scratch(records.sparkSession, "shred")
    one = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(payload).alias("_t")).where("_t is not null and trim(_t) <> ''")
    kind = dict(one.dtypes)[key]
    schema = f"`{key}` {kind}, node int, parent int, label string, ordinal int, kind string, scalar string"
    return scratch.save(one.mapInPandas(_shredder(key), schema), "nodes")


def _children(parents: DataFrame, nodes: DataFrame, key: str, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Inner join of nodes to their parents; the parent's ``node`` and further columns come along."""
    kids = nodes if labels is None else nodes.where(F.col("label").isin(*labels))
    kids = kids.select(F.col(key).alias("_k"), F.col("parent").alias("_p"), F.col("node").alias("c_node"), F.col("label").alias("c_label"), F.col("ordinal").alias("c_ordinal"), F.col("kind").alias("c_kind"), F.col("scalar").alias("c_scalar"))
    return parents.join(kids, (parents[key] == kids["_k"]) & (parents["node"] == kids["_p"])).drop("_k", "_p")


def slices(nodes: DataFrame, key: str) -> DataFrame:
    """(key, node, image_index): each slice object of a slice list, map or lone slice.

    image_index is the slice's own scalar, else the label under which a map holds it, else null.
    """
    lists = nodes.where(F.col("label").isin(*SLICE_LISTS) & F.col("kind").isin("array", "object")).select(key, "node", "kind")
    inner = _children(lists, nodes, key)
    # an object that holds a slice's own members is a lone slice, not a map of slices
    own = IMAGE_INDEX + REGION_LISTS
    lone = inner.where((F.col("kind") == "object") & F.col("c_label").isin(*own)).select(key, "node").distinct().withColumn("label", F.lit(None).cast("string"))
    many = inner.where("c_kind = 'object'").join(lone.select(key, "node"), [key, "node"], "left_anti").select(key, F.col("c_node").alias("node"), F.col("c_label").alias("label"))
    found = many.unionByName(lone)
    named = _children(found.select(key, "node"), nodes, key, IMAGE_INDEX).where("c_kind = 'scalar'").groupBy(key, "node").agg(F.min("c_scalar").alias("own"))
    return found.join(named, [key, "node"], "left").select(key, "node", F.coalesce(F.expr("try_cast(try_cast(trim(own) as double) as int)"), F.expr("try_cast(trim(label) as int)")).alias("image_index"))


def regions(nodes: DataFrame, key: str) -> DataFrame:
    """(key, slice_node, image_index, node, roi_idx, name, area_cm2): region objects in a slice's region list.

    Lists elsewhere (deleted regions, audits) are not region lists of a slice. roi_idx is the place in
    the list, 0 for a lone object; entries that are not objects are skipped but keep their place.
    """
    parts = slices(nodes, key)
    lists = _children(parts, nodes, key, REGION_LISTS).where("c_kind in ('array', 'object')").select(key, F.col("node").alias("slice_node"), "image_index", F.col("c_node").alias("node"), F.col("c_kind").alias("kind"))
    inside = _children(lists.where("kind = 'array'"), nodes, key).where("c_kind = 'object'").select(key, "slice_node", "image_index", F.col("c_node").alias("node"), F.col("c_ordinal").alias("roi_idx"))
    lone = lists.where("kind = 'object'").select(key, "slice_node", "image_index", "node", F.lit(0).alias("roi_idx"))
    found = inside.unionByName(lone)
    scalars = _children(found.select(key, "node"), nodes, key, NAMES + AREAS).where("c_kind = 'scalar'")
    wide = scalars.groupBy(key, "node").agg(F.min(F.when(F.col("c_label").isin(*NAMES), F.col("c_scalar"))).alias("name"), F.min(F.when(F.col("c_label").isin(*AREAS), F.expr("try_cast(c_scalar as double)"))).alias("area_cm2"))
    return found.join(wide, [key, "node"], "left")


def points(nodes: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """(key, region_node, space, ordinal, x, y, z): outline points of regions, space ``px`` or ``mm``.

    Outlines are members of the region or of its ``geometry``. A point is an entry of a list (numbers,
    an object of x, y, z, or text such as "(a, b)"), a place in parallel lists xs, ys, zs, a piece of
    text between semicolons, or a lone object of x, y, z. Null entries and blank pieces are not points.
    """
    base = regions.select(key, "node")
    geometry = _children(base, nodes, key, ("geometry",)).where("c_kind = 'object'").select(key, F.col("node").alias("region_node"), F.col("c_node").alias("node"))
    holders = base.select(key, F.col("node").alias("region_node"), "node").unionByName(geometry)
    outline = _children(holders, nodes, key, PIXELS + MILLIMETRES).where("c_kind <> 'null'")
    outline = outline.select(key, "region_node", F.when(F.col("c_label").isin(*PIXELS), "px").otherwise("mm").alias("space"), F.col("c_node").alias("node"), F.col("c_kind").alias("kind"), F.col("c_scalar").alias("scalar"))
    ids = [key, "region_node", "space"]

    def coords(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1))

    num = lambda a, i: F.expr(f"try_cast(get({a}, {i}) as double)")
    pieces = outline.where("kind = 'scalar'").select(*ids, F.posexplode(F.split("scalar", ";")).alias("ordinal", "t")).where("trim(t) <> ''")
    texts = pieces.withColumn("n", coords(F.col("t"))).select(*ids, "ordinal", num("n", 0).alias("x"), num("n", 1).alias("y"), num("n", 2).alias("z"))

    entry = _children(outline.where("kind in ('array', 'object')").drop("scalar"), nodes, key).where("c_kind <> 'null'")
    listed = entry.where("kind = 'array'").select(*ids, F.col("c_ordinal").alias("ordinal"), F.col("c_node").alias("node"), F.col("c_kind").alias("kind"), F.col("c_scalar").alias("scalar"))
    flat = listed.where("kind = 'scalar'").withColumn("n", coords(F.col("scalar"))).select(*ids, "ordinal", num("n", 0).alias("x"), num("n", 1).alias("y"), num("n", 2).alias("z"))
    deep = listed.where("kind <> 'scalar'")

    def axes(d: DataFrame, by: list[str], label: str, ordinal: str | None) -> DataFrame:
        at = lambda name, i: F.max(F.when((F.col(label) == name) | (F.col(label).isNull() & (F.col(ordinal) == i) if ordinal else F.lit(False)), F.expr("try_cast(c_scalar as double)")))
        return d.groupBy(*by).agg(at("x", 0).alias("x"), at("y", 1).alias("y"), at("z", 2).alias("z"))

    inner = _children(deep.select(*ids, "ordinal", "node"), nodes, key)
    got = axes(inner, [*ids, "ordinal", "node"], "c_label", "c_ordinal")
    nested = deep.select(*ids, "ordinal", "node").join(got, [*ids, "ordinal", "node"], "left").drop("node")

    members = entry.where("kind = 'object'").select(*ids, F.substring("c_label", 1, 1).alias("axis"), F.col("c_node").alias("node"), F.col("c_kind").alias("kind"), F.col("c_scalar").alias("own"))
    columns = _children(members.where("kind = 'array' and axis in ('x', 'y', 'z')").select(*ids, "axis", "node"), nodes, key).where("c_kind <> 'null'")
    parallel = axes(columns.withColumn("label", F.col("axis")), [*ids, "c_ordinal"], "label", None).withColumnRenamed("c_ordinal", "ordinal")
    lone = axes(members.where("kind = 'scalar' and axis in ('x', 'y', 'z')").select(*ids, F.col("axis").alias("label"), F.col("own").alias("c_scalar")), ids, "label", None).withColumn("ordinal", F.lit(0))
    tables = [texts, flat, nested, parallel, lone]
    return reduce(DataFrame.unionByName, [t.select(*ids, "ordinal", "x", "y", "z") for t in tables])


def region_table(records: DataFrame, key: str = "record_id", payload: str = "payload") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions with their point counts, points, and the adjacency table behind both."""
    scratch = Scratch(records.sparkSession, "nested")
    nodes = shred(records, key, payload, scratch)
    found = scratch.save(regions(nodes, key), "regions")
    pts = scratch.save(points(nodes, found, key), "points")
    counts = pts.groupBy(key, F.col("region_node").alias("node")).agg(F.count_if(F.col("space") == "px").alias("n_px"), F.count_if(F.col("space") == "mm").alias("n_mm"))
    wide = found.join(counts, [key, "node"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("n_px", "n_mm")})
    return wide, pts, nodes


def p3_found(spark, sf_dir: str) -> DataFrame:
    wide, _, _ = region_table(table(spark, sf_dir, "parse_results"))
    return wide.select("record_id", "image_index", "roi_idx", "n_px", "n_mm").distinct()


def p3_points(spark, sf_dir: str) -> DataFrame:
    """Every outline point with the slice and region that it belongs to."""
    wide, pts, _ = region_table(table(spark, sf_dir, "parse_results"))
    parent = wide.select("record_id", F.col("node").alias("region_node"), "slice_node", "image_index", "roi_idx")
    return pts.join(parent, ["record_id", "region_node"])
