"""Filling fixed-capacity containers: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.tokens import with_tokens
from cohortlake.session import Scratch, block_offsets, table

#: Lengths are counted in this many classes of equal width per capacity.
CLASSES = 128
#: A combination's classes add up to between CLASSES - w and CLASSES; what a narrow window leaves over is solved for with the next one.
WINDOWS = (1, 2, 4)
#: Rows that a block, by which ranks within a class are counted, aims at; there are BLOCKS blocks at least.
BLOCK_ROWS, BLOCKS = 200_000, 64
#: Share of the tokens that waits in very short items to fill the room that rounding leaves.
FILLER = 0.03
#: Half capacities in a row that short items may be bundled up to first, at most.
LEVELS = 8


@lru_cache(4)
def combinations(classes: int = CLASSES, window: int = WINDOWS[-1]) -> np.ndarray:
    """All multisets of one to three length classes whose sum fills the window, one row each (0 pads)."""
    out = []
    for total in range(classes - window, classes + 1):
        out.append((total, 0, 0))
        for a in range(1, total // 2 + 1):
            out.append((a, total - a, 0))
        for a in range(1, total // 3 + 1):
            for b in range(a, (total - a) // 2 + 1):
                out.append((a, b, total - a - b))
    return np.array(out, dtype=np.int64)


def solve_repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = 150, windows: tuple[int, ...] = WINDOWS) -> np.ndarray:
    """Repeat counts of combinations: weighted NNLS against the histogram by projected gradient with momentum.

    Counts are rounded down, then up from the largest remainder on, as far as no class is asked for more
    items than it has; what is left over is solved for again with the next window.
    """
    left = histogram.astype(np.int64).copy()
    repeats = np.zeros(len(combos), dtype=np.int64)
    fill = combos.sum(axis=1)
    for window in windows:
        able = np.flatnonzero(np.all((left[combos] > 0) | (combos == 0), axis=1) & (fill >= len(histogram) - 1 - window))
        if not len(able):
            continue
        x = _nnls(combos[able], left, steps)
        whole = np.floor(x).astype(np.int64)
        for want in (whole, (x - whole > 1e-3).astype(np.int64)):
            for k in np.lexsort((-x, -(x - whole)) if want is not whole else (-x,)):
                if want[k]:
                    parts, counts = np.unique(combos[able[k]][combos[able[k]] > 0], return_counts=True)
                    r = min(int(want[k]), int((left[parts] // counts).min()))
                    if r > 0:
                        repeats[able[k]] += r
                        left[parts] -= r * counts
    return repeats


def _nnls(combos: np.ndarray, histogram: np.ndarray, steps: int) -> np.ndarray:
    classes = len(histogram) - 1
    a = np.zeros((classes + 1, len(combos)))
    for k in range(combos.shape[1]):
        np.add.at(a, (combos[:, k], np.arange(len(combos))), (combos[:, k] > 0).astype(float))
    weight = np.sqrt(np.arange(classes + 1) / classes)  # a long item left over costs more than a short one
    b = histogram * weight
    m = a * weight[:, None]
    scale = max(1.0, float(b.max()))
    b = b / scale
    step = 1.0 / max(1e-12, np.linalg.eigvalsh(m @ m.T)[-1])
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * (m.T @ (m @ y - b)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


def _slots(combos: np.ndarray, repeats: np.ndarray, classes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: ends of rank ranges, the first container of each range, and items per container."""
    first = np.concatenate([[0], np.cumsum(repeats)[:-1]])
    out = []
    for c in range(classes + 1):
        times = (combos == c).sum(axis=1) * (c > 0)
        used = np.flatnonzero((times > 0) & (repeats > 0))
        out.append((np.cumsum(repeats[used] * times[used]), first[used], times[used]))
    return out


def _pack_block(capacity: int):
    """Best-fit decreasing of one block: open containers with room, and items still to be placed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf["block"].iloc[0]
        rooms = pdf[pdf["item"].isna()]
        open_: list[tuple[int, str]] = sorted(zip(rooms["size"].astype(int), rooms["container"]))
        items = pdf[pdf["item"].notna()].sort_values(["size", "item"], ascending=[False, True])
        got, made = [], 0
        for size in items["size"].astype(int):
            i = bisect_left(open_, (size, ""))
            if i < len(open_):
                room, name = open_.pop(i)
            else:
                room, name = capacity, f"r{block}-{made}"
                made += 1
            got.append(name)
            if room > size:
                insort(open_, (room - size, name))
        return pd.DataFrame({"item": items["item"].to_numpy(), "container": got})

    return run


def _solve_level(nodes: DataFrame, capacity: int, prefix: str, blocks: int, scratch: Scratch, windows: tuple[int, ...]) -> DataFrame:
    """(item, size, container): nodes that combinations of their classes fill containers with, others with null.

    The histogram of classes, whose size the number of classes bounds, goes to the driver, where NNLS
    finds how often each combination is used. Nodes take their places by their rank in the class, which
    is counted in blocks so that a class with most of the nodes fills no task.
    """
    cls = F.ceil(F.col("size") * CLASSES / F.lit(capacity)).cast("int")
    it = nodes.where(F.col("size") <= capacity).select("item", "size", cls.alias("class"), F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("b"))
    cells = it.groupBy("class", "b").agg(F.count("*").alias("n"))
    histogram = np.zeros(CLASSES + 1)
    for c, k in cells.groupBy("class").agg(F.sum("n")).collect():  # at most 128 rows
        histogram[c] = k
    combos = combinations()
    slots = _slots(combos, solve_repeats(combos, histogram, windows=windows), CLASSES)
    offsets = block_offsets(cells, ["class"], "b", "n", "before").select("class", "b", "before")
    rank = F.row_number().over(Window.partitionBy("class", "b").orderBy("item")) - 1
    ranked = it.withColumn("rank", rank).join(offsets, ["class", "b"]).select("item", "size", "class", (F.col("rank") + F.col("before")).alias("rank"))

    @F.pandas_udf(T.LongType())
    def place(c: pd.Series, r: pd.Series) -> pd.Series:
        out = np.full(len(c), -1, dtype=np.int64)
        cv, rv = c.to_numpy(), r.to_numpy()
        for k in np.unique(cv):
            ends, first, times = slots[k]
            if len(ends):
                m = np.flatnonzero((cv == k) & (rv < ends[-1]))
                s = np.searchsorted(ends, rv[m], side="right")
                begun = np.where(s > 0, ends[s - 1], 0)
                out[m] = first[s] + (rv[m] - begun) // times[s]
        return pd.Series(out).where(out >= 0).astype("Int64")

    placed = ranked.withColumn("slot", place("class", "rank")).select("item", "size", F.when(F.col("slot") >= 0, F.concat(F.lit(prefix), F.col("slot").cast("string"))).alias("container"))
    large = nodes.where(F.col("size") > capacity).select("item", "size", F.lit(None).cast("string").alias("container"))
    return scratch.save(placed.unionByName(large), "placed")


def pack(items: DataFrame, capacity: int, scratch: Scratch | None = None, block_items: int = 20_000) -> DataFrame:
    """(item, container, size): containers of ``capacity`` for ``items`` (item STRING unique, size INT).

    Items larger than the capacity must be cut before (``pieces``). Three items that are short beside the
    capacity fill no container, so these are bundled first: NNLS over combinations fills bundles of the
    largest power-of-two part of the capacity that three mean items fill, then bundles of twice that of
    these and of items, and so on to the capacity. Very short items of FILLER of the tokens wait, drawn
    by a hash. They, and what no combination took (at the capacity: bundles and items), are packed
    greedily, best fit decreasing, into the room that rounding left and into new containers, in blocks
    of about ``block_items`` rows.
    Containers of combinations begin with c, those of the greedy pass with r. Items of size 0 or null,
    or larger than the capacity, are left out.
    """
    scratch = scratch or Scratch(items.sparkSession, "packing")
    nodes = scratch.save(items.where(f"size > 0 and size <= {int(capacity)}").select("item", F.col("size").cast("int").alias("size")), "items")
    very_short = F.col("size") <= capacity // 64
    n, tokens, least = nodes.agg(F.count("*"), F.sum("size"), F.sum(F.when(very_short, F.col("size")))).first()
    blocks = max(BLOCKS, -(-n // BLOCK_ROWS))
    depth = min(LEVELS, max(0, math.ceil(math.log2(capacity * n / (3 * tokens))))) if n else 0
    waits = F.coalesce(very_short & (F.pmod(F.xxhash64("item"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, FILLER * (tokens or 0) / (least or 1)))), F.lit(False))
    wait, nodes = nodes.where(waits), nodes.where(~waits)
    levels = []
    for k in range(depth, -1, -1):
        placed = _solve_level(nodes, capacity >> k, f"b{k}-" if k else "c", blocks, scratch, WINDOWS if k == 0 else WINDOWS[:1])
        levels.append(placed)
        if k:
            bundles = placed.where("container is not null").groupBy(F.col("container").alias("item")).agg(F.sum("size").cast("int").alias("size"))
            nodes = scratch.save(placed.where("container is null").select("item", "size").unionByName(bundles), "nodes")
    placed = levels[-1]
    rest = placed.where("container is null").unionByName(wait.withColumn("container", F.lit(None).cast("string")))
    rooms = placed.where("container is not null").groupBy("container").agg((F.lit(capacity) - F.sum("size")).cast("int").alias("size")).where("size > 0")
    both = rest.select("item", "size", "container").unionByName(rooms.select(F.lit(None).cast("string").alias("item"), "size", "container"))
    both = scratch.save(both, "residuals")
    blocks = max(1, -(-both.count() // block_items))
    block = F.pmod(F.xxhash64(F.coalesce("item", "container")), F.lit(blocks)).cast("int").alias("block")
    greedy = both.select(block, "item", "size", "container").groupBy("block").applyInPandas(_pack_block(capacity), "item string, container string")
    label = placed.where("container is not null").select("item", "container").unionByName(greedy)
    for placed in reversed(levels[:-1]):  # from bundles down to what they hold
        up = label.select(F.col("item").alias("_n"), F.col("container").alias("_c"))
        label = placed.withColumn("_n", F.coalesce("container", "item")).join(up, "_n").select("item", F.col("_c").alias("container"))
    if levels[:-1]:  # those that waited are no bundle's
        label = label.unionByName(wait.select("item").join(greedy, "item"))
    return items.select("item", F.col("size").cast("int").alias("size")).join(label, "item").select("item", "container", "size")


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(item, doc_id, piece, size): documents as items; only one longer than the capacity is cut.

    A long document gives pieces of the capacity and one piece of the rest; documents without tokens
    give none. Pieces of a document are numbered from 0.
    """
    n = F.col("n_tokens")
    d = sized.where("n_tokens > 0 and doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    d = d.select("doc_id", n.alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))).alias("piece"))
    size = F.least(F.lit(capacity).cast("long"), n - F.col("piece") * F.lit(capacity).cast("long")).cast("int")
    return d.select(F.concat_ws("-", "doc_id", "piece").alias("item"), "doc_id", "piece", size.alias("size"))


def pack_documents(sized: DataFrame, sizes: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, container, doc_id, piece, size) for each named capacity."""
    scratch = Scratch(sized.sparkSession, "packing")
    out = None
    for name, capacity in sizes:
        items = scratch.save(pieces(sized, capacity), "pieces")
        got = pack(items.select("item", "size"), capacity, scratch)
        got = got.join(items.select("item", "doc_id", "piece"), "item").select(F.lit(name).alias("pack_name"), "container", "doc_id", "piece", "size")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else sized.sparkSession.createDataFrame([], "pack_name string, container string, doc_id long, piece int, size int")


def _all(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = Scratch(spark, "sized").save(with_tokens(docs), "sized")
    # a table of capacities that the caller configures
    sizes = [(r.pack_name, r.capacity_tokens) for r in table(spark, sf_dir, "pack_sizes").where("capacity_tokens > 0").orderBy("pack_name").collect()]
    return pack_documents(sized, sizes)


def p7_packs(spark, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir)


def p7_fill(spark, sf_dir: str) -> DataFrame:
    """Per capacity: containers, items, tokens, the share of tokens in solved combinations, the share of room that is used, and the least possible number of containers."""
    packs = _all(spark, sf_dir).join(table(spark, sf_dir, "pack_sizes"), "pack_name")
    per = packs.groupBy("pack_name", "capacity_tokens", "container").agg(F.sum("size").alias("fill"), F.count("*").alias("n"))
    got = per.groupBy("pack_name", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"), F.sum(F.when(F.col("container").startswith("c"), F.col("fill")).otherwise(0)).alias("solved"))
    got = got.withColumn("solved_share", F.col("solved") / F.col("tokens")).drop("solved")
    return got.withColumns({"used": F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), "least_containers": F.ceil(F.col("tokens") / F.col("capacity_tokens"))})
