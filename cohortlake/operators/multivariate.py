"""Components, clusters, stability, harmonisation and redundancy.

Spark aggregates what grows with the rows (moments, counts, nearest distances); only matrices as large
as the number of columns, batches or clusters reach the driver. Replicates are fitted to whole tables.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import chain, combinations, count, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cohortlake.functions.scoring import yeo_johnson
from cohortlake.operators.windows import average_rank
from cohortlake.session import Scratch


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariance of complete rows, from one aggregation."""
    d = df.na.drop(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = d.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    p = len(columns)
    cov = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[1 + p :]):
        cov[i, j] = cov[j, i] = v or 0.0
    return row[0], np.array([v or 0.0 for v in row[1 : 1 + p]]), cov


def components(df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (k x columns) and variance shares; each loading's largest entry is positive."""
    _, _, cov = gram(df, columns)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    load = vectors[:, order].T
    sign = np.sign(load[np.arange(len(load)), np.abs(load).argmax(axis=1)])
    return load * np.where(sign == 0, 1, sign)[:, None], values[order] / max(values.sum(), 1e-300)


def project(df: DataFrame, columns: list[str], load: np.ndarray, prefix: str = "pc") -> DataFrame:
    """Scores without centring, as the columns are z-scores."""
    score = lambda row: sum((F.col(c) * float(v) for c, v in zip(columns, row)), F.lit(0.0))
    return df.withColumns({f"{prefix}{i + 1}": score(row) for i, row in enumerate(load)})


def loadings_table(spark, columns: list[str], load: np.ndarray, share: np.ndarray) -> DataFrame:
    rows = [(f"pc{i + 1}", c, float(v), float(share[i])) for i, r in enumerate(load) for c, v in zip(columns, r)]
    return spark.createDataFrame(rows, "pc string, feature string, loading double, variance_share double")


def _products(points: np.ndarray, part: np.ndarray) -> np.ndarray:
    return points @ part


def _two_nearest(points: np.ndarray, rows: np.ndarray, most: np.ndarray, leaf: int = 256) -> np.ndarray:
    """Distances of each point to its two nearest rows, infinite where there are none up to ``most``.

    The rows are halved down to leaves; a point is measured in one leaf near it, then in all whose box may hold a nearer row.
    """
    out = np.full((len(points), 2), np.inf)
    if not len(points) or not len(rows):
        return out
    middle = rows.mean(0)
    p, x, order = points - middle, rows - middle, np.arange(len(rows))
    sq, wide = (p**2).sum(1), np.c_[p, np.ones(len(p))]
    slack = 1e-13 * (sq + (x**2).sum(1).max()) + 1e-300  # the expanded square is rough beside zero
    best, where = np.tile((most**2 * (1 + 1e-9) + slack)[:, None], 2), np.full((len(p), 2), -1)

    def split(a: int, b: int) -> tuple:
        part = x[order[a:b]]
        low, high = part.min(0), part.max(0)
        if b - a <= leaf:
            return low, high, a, np.vstack([-2 * part.T, (part**2).sum(1)])
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, part.var(0).argmax()], half)]
        return low, high, split(a, a + half), split(a + half, b)

    def bound(node: tuple, who: np.ndarray) -> np.ndarray:
        g = np.maximum(np.maximum(node[0] - p[who], p[who] - node[1]), 0)
        return np.einsum("ij,ij->i", g, g)

    def measure(start: int, part: np.ndarray, who: np.ndarray) -> None:
        for at in range(0, len(who), 1024):
            w = who[at : at + 1024]
            d = _products(wide[w], part)
            ok = d.min(1) + sq[w] < best[w, 1]
            w, d = w[ok], d[ok]
            near = np.argpartition(d, 1, axis=1)[:, :2] if d.shape[1] > 2 else np.tile(np.arange(d.shape[1]), (len(w), 1))
            both = np.c_[best[w], np.take_along_axis(d, near, 1) + sq[w][:, None]]
            first = np.argsort(both, axis=1, kind="stable")[:, :2]
            best[w], where[w] = np.take_along_axis(both, first, 1), np.take_along_axis(np.c_[where[w], order[start + near]], first, 1)

    def walk(node: tuple, who: np.ndarray, one: bool) -> None:
        who = who[bound(node, who) < best[who, 1] + slack[who]]
        if not len(who):
            return
        if not isinstance(node[2], tuple):
            measure(node[2], node[3], who)
        elif one:
            left = bound(node[2], who) <= bound(node[3], who)
            walk(node[2], who[left], True)
            walk(node[3], who[~left], True)
        else:
            walk(node[2], who, False)
            walk(node[3], who, False)

    root, everyone = split(0, len(x)), np.arange(len(p))
    walk(root, everyone, True)
    best[:] = (best[:, 1] * (1 + 1e-9) + slack)[:, None]
    where[:] = -1
    walk(root, everyone, False)
    for k in range(2):
        got = np.flatnonzero(where[:, k] >= 0)
        out[got, k] = np.sqrt(((points[got] - rows[where[got, k]]) ** 2).sum(1))
    return np.sort(out, axis=1)


def _cuts(sample: np.ndarray, cells: int) -> tuple | int:
    """Nested (column, value, below, above), down to the numbers 0, 1, ... of at most ``cells`` cells that share the sample evenly."""
    number = count()

    def cut(x: np.ndarray, k: int) -> tuple | int:
        if k < 2 or len(x) < 2 or not (spread := x.var(0)).max() > 0:
            return next(number)
        c = int(spread.argmax())
        at = np.sort(x[:, c])[len(x) * (k // 2) // k]
        low = x[:, c] < at
        return (c, float(at), cut(x[low], k // 2), cut(x[~low], k - k // 2)) if low.any() else next(number)

    return cut(sample, cells)


def _cell_of(x: np.ndarray, cuts: tuple | int) -> np.ndarray:
    cell, stack = np.zeros(len(x), dtype=np.int32), [(cuts, np.arange(len(x)))]
    while stack:
        node, who = stack.pop()
        if not isinstance(node, tuple):
            cell[who] = node
        elif len(who):
            low = x[who, node[0]] < node[1]
            stack += [(node[2], who[low]), (node[3], who[~low])]
    return cell


def hopkins(df: DataFrame, columns: list[str], key: str, share: float = 0.1, least: int = 100, cells: int = 4096, chunk: int = 65_536, seed: int = 42) -> DataFrame:
    """Hopkins statistic: distances of a share of the rows, and of as many uniform points, to their second nearest row.

    ``share`` of the rows are drawn by a hash of the key, ``least`` where that would be fewer. Rows lie in
    cells of about ``chunk`` rows (at most ``cells`` cells, smaller ones in small tables), cut at medians of
    a sample; a point is first measured in the cell whose box is nearest and then sent to the cells whose
    box can hold a nearer row, so distances are exact. A cell is joined in chunks, so no task holds more
    than ``chunk`` rows and points, which it searches by nested boxes. Under three rows null; no distances 0.5.
    """
    spark = df.sparkSession
    store = Scratch(spark, "hopkins")
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    d = store.save(df.na.drop(subset=[*columns, key]).select(F.xxhash64(F.lit(seed), key).alias("h"), x), "rows")
    p = len(columns)
    row = d.agg(F.count("*"), *[f(F.col("x")[i]) for f in (F.min, F.max) for i in range(p)]).first()
    n = row[0]
    if n < 3:
        return spark.createDataFrame([(None,)], "hopkins double")
    low, high = np.array(row[1 : 1 + p], dtype=float), np.array(row[1 + p :], dtype=float)
    drawn = max(share, min(1.0, least / n))
    parts = max(1, min(cells, max(math.isqrt(n) // 32, n // chunk)))
    cuts = _cuts(np.array([r.x for r in d.orderBy(F.xxhash64(F.lit(seed + 1), "h"), "h").limit(max(4096, 32 * parts)).collect()]), parts)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=_cell_of(np.vstack(pdf["x"]), cuts))

    rows = store.save(d.mapInPandas(place, "h long, x array<double>, cell int"), "cells")
    box = sorted(rows.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("x")[i]) for f in (F.min, F.max) for i in range(p)]).collect())
    name, size = np.array([r["cell"] for r in box], dtype=np.int32), {r["cell"]: r["n"] for r in box}
    lows, highs = np.array([r[2 : 2 + p] for r in box], dtype=float), np.array([r[2 + p :] for r in box], dtype=float)

    def to_boxes(q: np.ndarray) -> np.ndarray:
        """Squares of the distances of points to the boxes."""
        out = np.zeros((len(q), len(name)))
        for c in range(p):
            out += np.maximum(np.maximum(lows[None, :, c] - q[:, None, c], q[:, None, c] - highs[None, :, c]), 0) ** 2
        return out

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = pdf["h"].to_numpy(dtype=np.int64)
            pick = _unit(h, seed) < drawn
            if pick.any():
                h, part = h[pick], pdf[pick]
                uniform = np.column_stack([low[c] + _unit(h, seed + 1 + c) * (high[c] - low[c]) for c in range(p)])
                both = [*part["x"], *uniform]
                cell = np.concatenate([name[to_boxes(np.vstack(both[at : at + 512])).argmin(1)] for at in range(0, len(both), 512)])
                yield pd.DataFrame({"real": np.r_[np.ones(len(h), bool), np.zeros(len(h), bool)], "x": both, "cell": cell})

    # a probe has a number of its own: redelivered keys are probes of their own
    own = d.mapInPandas(probe, "real boolean, x array<double>, cell int").withColumn("i", F.monotonically_increasing_id())
    probes = store.save(own.withColumn("most", F.lit(float("inf"))), "probes")

    def measured(sent: DataFrame) -> DataFrame:
        """(i, near): the two smallest distances, up to ``most``, of each probe to the rows of the cells it is sent to."""
        asked = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}
        parts = spark.createDataFrame([(c, -(-size[c] // chunk), -(-k // chunk)) for c, k in asked.items()], "cell int, rows int, probes int")
        spread = lambda t, mine, other, on: (
            t.join(F.broadcast(parts), "cell").withColumn(mine, F.expr(f"cast(pmod(xxhash64({on}), {mine}) as int)")).withColumn(other, F.expr(f"explode(sequence(0, {other} - 1))"))
        )
        a = spread(sent.select("i", "x", "most", "cell"), "probes", "rows", "i, 1").groupBy("cell", "rows", "probes")
        b = spread(rows.select("h", "x", "cell"), "rows", "probes", "h, 2").groupBy("cell", "rows", "probes")

        def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"i": [], "near": []})
            return pd.DataFrame({"i": left["i"], "near": list(_two_nearest(np.vstack(left["x"]), np.vstack(right["x"]), left["most"].to_numpy()))})

        t = a.cogroup(b).applyInPandas(near, "i long, near array<double>")
        return t.groupBy("i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, 2).alias("near"))

    # a chunk of a cell may be empty by hash, but not all of them
    first = store.save(probes.drop("most").join(measured(probes), "i").withColumn("most", F.col("near")[1]), "first")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                most = part["most"].to_numpy()
                reach = (to_boxes(np.vstack(part["x"])) <= (most**2 * (1 + 1e-9))[:, None]) & (name[None] != part["cell"].to_numpy()[:, None])
                at_row, cell = np.nonzero(reach)
                yield pd.DataFrame({"i": part["i"].to_numpy()[at_row], "x": part["x"].to_numpy()[at_row], "cell": name[cell], "most": most[at_row]})

    sent = store.save(first.select("i", "x", "cell", "most").mapInPandas(send, "i long, x array<double>, cell int, most double"), "sent")
    both = first.select("i", "real", "near").join(measured(sent).withColumnRenamed("near", "more"), "i", "left")
    both = both.select("real", F.sort_array(F.concat("near", F.coalesce("more", F.array().cast("array<double>"))))[1].alias("d"))
    s = both.agg(F.sum(F.when(F.col("real"), F.col("d"))).alias("w"), F.sum(F.when(~F.col("real"), F.col("d"))).alias("u"))
    return s.select(F.when(F.col("u") + F.col("w") > 0, F.col("u") / F.nullif(F.col("u") + F.col("w"), F.lit(0.0))).otherwise(0.5).alias("hopkins"))


#: Levels of the grid on which columns are clustered: sums of whole numbers do not depend on partitions.
LEVELS = 2**20


def _unit(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from row hashes and a salt."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def _drawn(h: np.ndarray, seed: int, b: int) -> np.ndarray:
    """Whether the subsample ``b`` holds the rows: four in five groups of them."""
    groups = np.random.default_rng([seed, b]).permutation(20)[:16]
    return np.isin((_unit(h, seed * 31 + 7) * 20).astype(int), groups)


class Replicates:
    """k-means of replicates of a whole table, all fitted in the same passes over its rows.

    A replicate is ``all`` rows, ``boot`` (the rows that a bootstrap draws at least once, by a hash of
    the key), ``sub`` (16 of 20 groups of rows, grouped by the hash) or ``box`` (as many uniform points in
    the columns' ranges, made from the row hashes).
    A pass leaves sums per cluster; the driver has replicates x clusters x columns. Starts are drawn by
    k-means++ over all rows. The same on any number of partitions.
    """

    def __init__(self, df: DataFrame, columns: list[str], key: str, seed: int):
        d = df.na.drop(subset=[*columns, key]).select(F.xxhash64(F.lit(seed), key).alias("h"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
        self.rows, self.p, self.seed = Scratch(df.sparkSession, "replicates").save(d, "rows"), len(columns), seed
        row = self.rows.agg(F.count("*"), *[f(f"x{i}") for f in (F.min, F.max) for i in range(self.p)]).first()
        self.n = row[0]
        if self.n:
            self.low = np.array(row[1 : 1 + self.p], dtype=float)
            self.step = (np.array(row[1 + self.p :], dtype=float) - self.low) / LEVELS

    def scan(self, sets: list[tuple[str, int]], work, schema: str) -> DataFrame:
        """``work(set, hashes, whole-numbered rows, kept)`` over chunks; a chunk's sums of squares stay exact in doubles."""
        low, step, p, seed = self.low, self.step, self.p, self.seed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 4096):
                    part = pdf.iloc[at : at + 4096]
                    h = part["h"].to_numpy(dtype=np.int64)
                    own = np.rint((part.drop(columns="h").to_numpy(dtype=float) - low) / np.where(step > 0, step, 1))
                    out = []
                    for kind, b in sets:
                        salt = (seed * 1_000_003 + b) * 64
                        q = own if kind != "box" else np.column_stack([np.rint(_unit(h, salt + c) * LEVELS) for c in range(p)])
                        kept = _unit(h, salt + 63) < 1 - math.exp(-1) if kind == "boot" else _drawn(h, seed, b) if kind == "sub" else np.ones(len(h), dtype=bool)
                        out += work((kind, b), h, q, kept)
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        return self.rows.mapInPandas(run, schema)

    def nearest(self):
        step = self.step
        return lambda q, centres: ((centres * step) ** 2).sum(1) - 2 * (q * step**2) @ centres.T

    def fit(self, runs: list[tuple[int, str, int]], starts: int = 4, steps: int = 50) -> tuple[list[np.ndarray], list[float]]:
        """Centres (in levels) and dispersion of the best start of each run (k, kind, replicate)."""
        near, step, seed = self.nearest(), self.step, self.seed
        tiny = 1e-12 * ((LEVELS * step) ** 2).sum()  # about the grid
        every = [(k, kind, b, s) for k, kind, b in runs for s in range(starts if k > 1 else 1)]
        centres: list[np.ndarray] = [np.zeros((0, self.p)) for _ in every]
        for j in range(max(k for k, *_ in every)):
            now = [r for r, (k, *_) in enumerate(every) if k > j]

            def draw(of, h, q, kept, now=now, j=j):
                out, size = [], ((q * step) ** 2).sum(1)
                for r in (r for r in now if every[r][1:3] == of):
                    # the first of exponential clocks whose rates are the squared distances
                    d2 = np.ones(len(q)) if j == 0 else np.maximum(size + near(q, centres[r]).min(1), 0)
                    d2 = np.where(kept & ((d2 > tiny) | (j == 0)), d2, 0)
                    with np.errstate(divide="ignore"):
                        clock = -np.log(_unit(h, (seed * 7919 + r) * 64 + j)) / d2
                    i = int(clock.argmin()) if len(q) else -1
                    if i >= 0 and np.isfinite(clock[i]):
                        out.append((r, float(clock[i]), int(h[i]), q[i].tolist()))
                return out

            first = self.scan(sorted({every[r][1:3] for r in now}), draw, "r int, clock double, h long, q array<double>").groupBy("r").agg(F.min_by("q", F.struct("clock", "h")).alias("q"))
            got = {x.r: np.array(x.q) for x in first.collect()}
            for r in now:
                # no row apart from the centres: the cluster stays empty
                centres[r] = np.vstack([centres[r], got[r] if r in got else np.full(self.p, 1e9)])
        open_ = list(range(len(every)))
        for _ in range(steps):
            sums = self.sums(every, centres, open_, False)
            still = []
            for r in open_:
                new = np.array([[v / n for v in s] if n else centres[r][c] for c, (n, s, _) in enumerate(sums[r])])
                if not np.allclose(new, centres[r]):
                    still.append(r)
                centres[r] = new
            open_ = still
            if not open_:
                break
        cost = {r: sum(float(step[c]) ** 2 * ((n * s2[c] - s[c] ** 2) / n) for n, s, s2 in sums if n for c in range(self.p)) for r, sums in self.sums(every, centres, list(range(len(every))), True).items()}
        best = [min((r for r, e in enumerate(every) if e[:3] == run), key=lambda r: cost[r]) for run in runs]
        return [centres[r] for r in best], [cost[r] for r in best]

    def sums(self, every, centres, which: list[int], squares: bool) -> dict[int, list]:
        """Per run and cluster: rows, sums and sums of squares of the columns, as whole numbers."""
        near = self.nearest()

        def add(of, h, q, kept):
            out, q = [], q[kept]
            for r in (r for r in which if every[r][1:3] == of):
                hot = (near(q, centres[r]).argmin(1)[:, None] == np.arange(len(centres[r]))).astype(float)
                n, s, s2 = hot.sum(0), hot.T @ q, hot.T @ q**2 if squares else np.zeros((len(centres[r]), self_p))
                out += [(r, c, [int(v) for v in (n[c], *s[c], *s2[c])]) for c in range(len(n)) if n[c]]
            return out

        self_p = self.p
        t = self.scan(sorted({every[r][1:3] for r in which}), add, "r int, c int, v array<bigint>")
        t = t.groupBy("r", "c").agg(*[F.sum(F.col("v")[i].cast("decimal(38,0)")).alias(f"v{i}") for i in range(1 + 2 * self.p)])
        out = {r: [(0, [0] * self.p, [0] * self.p) for _ in centres[r]] for r in which}
        for r, c, n, *v in t.collect():
            out[r][c] = (int(n), [int(x) for x in v[: self.p]], [int(x) for x in v[self.p :]])
        return out


def gap_statistic(df: DataFrame, columns: list[str], key: str, ks: tuple[int, ...] = (1, 2, 3, 4, 5), replicates: int = 20, seed: int = 42) -> DataFrame:
    """(k, log_w, gap, s): log dispersion of all complete rows against as many points in uniform boxes."""
    spark, m = df.sparkSession, Replicates(df, columns, key, seed)
    if m.n < 2:
        return spark.createDataFrame([], "k int, log_w double, gap double, s double")
    runs = [(k, *of) for k in ks for of in [("all", 0), *[("box", b + 1) for b in range(replicates)]]]
    log_w = dict(zip(runs, (math.log(max(c, 1e-300)) for c in m.fit(runs)[1])))
    rows = []
    for k in ks:
        own, ref = log_w[k, "all", 0], np.array([log_w[k, "box", b + 1] for b in range(replicates)])
        rows.append((k, own, float(ref.mean() - own), float(ref.std() * math.sqrt(1 + 1 / replicates))))
    return spark.createDataFrame(rows, "k int, log_w double, gap double, s double")


def cluster_stability(df: DataFrame, columns: list[str], key: str, k: int, replicates: int = 30, seed: int = 42) -> DataFrame:
    """(cluster, jaccard_median, jaccard_mean, stable): overlap of each cluster of all rows with its best match in bootstraps."""
    spark, m = df.sparkSession, Replicates(df, columns, key, seed)
    schema = "cluster int, jaccard_median double, jaccard_mean double, stable boolean"
    if not m.n:
        return spark.createDataFrame([], schema)
    base, *boots = m.fit([(k, "all", 0), *[(k, "boot", b + 1) for b in range(replicates)]])[0]
    near = m.nearest()

    def cross(of, h, q, kept):
        a, b = near(q, base).argmin(1), near(q, boots[of[1] - 1]).argmin(1) if of[0] == "boot" else np.zeros(len(q), dtype=int)
        cells = np.bincount((a * k + b)[kept], minlength=k * k)
        return [(of[1], i // k, i % k, int(n)) for i, n in enumerate(cells) if n]

    t = m.scan([("all", 0), *[("boot", b + 1) for b in range(replicates)]], cross, "rep int, a int, b int, n long").groupBy("rep", "a", "b").agg(F.sum("n").alias("n"))
    n = np.zeros((replicates + 1, k, k))
    for r in t.collect():
        n[r.rep, r.a, r.b] = r.n
    union = n[1:].sum(2, keepdims=True) + n[1:].sum(1, keepdims=True) - n[1:]
    best = (n[1:] / np.maximum(union, 1)).max(2)
    rows = [(c, float(np.median(best[:, c])), float(best[:, c].mean()), bool(np.median(best[:, c]) >= 0.75)) for c in range(k) if n[0, c].sum()]
    return spark.createDataFrame(rows, schema)


def consensus(df: DataFrame, columns: list[str], key: str, ks: tuple[int, ...] = (2, 3, 4), replicates: int = 30, starts: int = 4, block: int = 1000, seed: int = 42) -> DataFrame:
    """(k, n_pairs, pac): share of ambiguous pairs of all complete rows over subsampled clusterings.

    A row's signature is its label in each replicate that draws it. Rows of one signature agree with
    the others alike, so pairs are counted between distinct signatures, weighted by their rows, in
    blocks of ``block`` signatures; how many there are depends on where the replicates' borders differ,
    not on the rows. A pair that no replicate draws together is not counted. Under two rows no result.
    """
    spark, m = df.sparkSession, Replicates(df, columns, key, seed)
    schema = "k int, n_pairs decimal(38,0), pac double"
    if m.n < 2:
        return spark.createDataFrame([], schema)
    runs = [(k, "sub", b) for k in ks for b in range(replicates)]
    centres, near = dict(zip(runs, m.fit(runs, starts)[0])), m.nearest()

    def sign(of, h, q, kept):
        out, held = [], np.column_stack([_drawn(h, seed, b) for b in range(replicates)])
        for k in ks:
            lab = np.column_stack([near(q, centres[k, "sub", b]).argmin(1) for b in range(replicates)])
            sig, n = np.unique(np.where(held, lab, 255).astype(np.uint8), axis=0, return_counts=True)
            out += [(k, bytes(v), int(c)) for v, c in zip(sig, n)]
        return out

    store = Scratch(spark, "consensus")
    t = store.save(m.scan([("all", 0)], sign, "k int, sig binary, n long").groupBy("k", "sig").agg(F.sum("n").alias("n")), "signatures")
    most = t.groupBy("k").count().agg(F.max("count")).first()[0]
    parts = -(-most // block)
    mine = t.withColumn("b", F.expr(f"cast(pmod(xxhash64(sig), {parts}) as int)")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    mine = mine.select("k", "sig", "n", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        k, i, j = (int(pdf[c].iloc[0]) for c in ("k", "i", "j"))
        sides = []
        for b in (i, j):
            side = pdf[pdf["b"] == b]
            lab = np.frombuffer(b"".join(side["sig"]), dtype=np.uint8).reshape(len(side), replicates)
            hot = (lab[:, :, None] == np.arange(k)).reshape(len(side), replicates * k).astype(np.float32)
            sides.append((hot, (lab != 255).astype(np.float32), side["n"].to_numpy(dtype=float)))
        (a, wa, na), (b, wb, nb) = sides
        together, same = wa @ wb.T, a @ b.T
        rows = np.outer(na, nb)
        if i == j:
            # each pair once; within a signature the rows agree
            rows = np.triu(rows, 1) + np.diag(na * (na - 1) / 2)
        rows = np.where(together > 0, rows, 0)
        share = same / np.maximum(together, 1)
        return pd.DataFrame({"k": [k], "pairs": [int(rows.sum())], "vague": [int(rows[(share > 0.1) & (share < 0.9)].sum())]})

    c = mine.groupBy("k", "i", "j").applyInPandas(count, "k int, pairs long, vague long")
    total = lambda v: F.sum(F.col(v).cast("decimal(38,0)"))
    return c.groupBy("k").agg(total("pairs").cast("decimal(38,0)").alias("n_pairs"), (total("vague").cast("double") / total("pairs").cast("double")).alias("pac"))


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42):
    """Fitted k-means model over all complete rows, and those rows with ``features``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df.na.drop(subset=columns))
    return KMeans(k=k, seed=seed, maxIter=30).fit(rows), rows


def combat(df: DataFrame, batch: str, columns: list[str], rounds: int = 50) -> DataFrame:
    """Batch-harmonised columns by empirical Bayes on batch means and variances.

    Means and variances per batch come from Spark; the iteration works on batches x columns. One batch
    leaves the columns as they are; a batch of one row is an error, as it has no variance.
    """
    d = df.where(F.col(batch).isNotNull())
    per = d.groupBy(batch).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_samp(c).alias(f"v_{c}") for c in columns]).orderBy(batch).collect()
    if len(per) < 2:
        return df
    if min(r["n"] for r in per) < 2:
        raise ValueError("a batch has a single row")
    n = np.array([r["n"] for r in per], dtype=float)
    m = np.array([[r[f"m_{c}"] or 0.0 for c in columns] for r in per])
    v = np.array([[r[f"v_{c}"] or 0.0 for c in columns] for r in per])
    grand = (n[:, None] * m).sum(0) / n.sum()
    pooled = np.maximum(((n - 1)[:, None] * v).sum(0) / n.sum(), 1e-12)
    g_hat, d_hat = (m - grand) / np.sqrt(pooled), np.maximum(v / pooled, 1e-8)
    g_bar, t2 = g_hat.mean(1, keepdims=True), np.maximum(g_hat.var(1, ddof=1, keepdims=True) if len(columns) > 1 else np.ones((len(per), 1)), 1e-8)
    dm, dv = d_hat.mean(1, keepdims=True), np.maximum(d_hat.var(1, ddof=1, keepdims=True) if len(columns) > 1 else np.ones((len(per), 1)), 1e-8)
    a, b = (2 * dv + dm**2) / dv, (dm * dv + dm**3) / dv
    g, dl = g_hat.copy(), d_hat.copy()
    for _ in range(rounds):
        g_new = (t2 * n[:, None] * g_hat + dl * g_bar) / (t2 * n[:, None] + dl)
        sq = (n - 1)[:, None] * d_hat + n[:, None] * (g_hat - g_new) ** 2
        d_new = (0.5 * sq + b) / (n[:, None] / 2 + a - 1)
        done = max(np.abs(g_new - g).max(), np.abs(d_new - dl).max()) < 1e-6
        g, dl = g_new, d_new
        if done:
            break
    spark = df.sparkSession
    rows = [(per[i][batch], *map(float, g[i]), *map(float, dl[i])) for i in range(len(per))]
    kind = dict(df.dtypes)[batch]
    fit = spark.createDataFrame(rows, ", ".join([f"`{batch}` {kind}", *[f"_g{i} double" for i in range(len(columns))], *[f"_d{i} double" for i in range(len(columns))]]))
    fixed = {c: F.coalesce(((F.col(c) - float(grand[i])) / float(np.sqrt(pooled[i])) - F.col(f"_g{i}")) / F.sqrt(F.col(f"_d{i}")) * float(np.sqrt(pooled[i])) + float(grand[i]), F.col(c)) for i, c in enumerate(columns)}
    return df.join(fit, batch, "left").withColumns(fixed).drop(*[f"_{k}{i}" for i in range(len(columns)) for k in "gd"])


def fit_yeo_johnson(df: DataFrame, columns: list[str], passes: int = 3) -> dict[str, float]:
    """Most likely power per column: a grid of powers in one aggregation, narrowed twice; no spread gives 1."""
    span = {c: (-3.0, 5.0) for c in columns}
    best = dict.fromkeys(columns, 1.0)
    for _ in range(passes):
        grid = {c: np.linspace(*span[c], 17) for c in columns}
        aggs = []
        for c in columns:
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"n_{c}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"l_{c}")]
            aggs += [F.var_pop(yeo_johnson(x, F.lit(float(g)))).alias(f"v_{c}_{i}") for i, g in enumerate(grid[c])]
        row = df.agg(*aggs).first()
        for c in columns:
            ll = [(-row[f"n_{c}"] / 2 * math.log(v) + (g - 1) * row[f"l_{c}"], -abs(g - 1), g) for i, g in enumerate(grid[c]) if (v := row[f"v_{c}_{i}"]) and v > 1e-12]
            if ll:
                best[c] = float(max(ll)[2])
                step = grid[c][1] - grid[c][0]
                span[c] = (best[c] - step, best[c] + step)
    return best


def rank_correlation(df: DataFrame, columns: list[str], key: str) -> np.ndarray:
    """Spearman matrix of complete rows: average ranks by window over distinct values, then one Gram."""
    d = df.na.drop(subset=[*columns, key]).select(key, *columns)
    out = d.select(key)
    for c in columns:
        r = average_rank(d.select(key, c).withColumn("_one", F.lit(1)), ["_one"], c, f"r_{c}").select(key, f"r_{c}")
        out = out.join(r, key)
    _, _, cov = gram(out, [f"r_{c}" for c in columns])
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = np.where(np.outer(sd, sd) > 0, cov / np.outer(sd, sd), 0.0)
    np.fill_diagonal(rho, 1.0)
    return np.clip(rho, -1, 1)


def average_linkage(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of a small distance matrix by average linkage (columns, not rows, are clustered)."""
    groups = {i: [i] for i in range(len(dist))}
    merges = []
    while len(groups) > 1:
        h, a, b = min((dist[np.ix_(groups[a], groups[b])].mean(), a, b) for a, b in combinations(sorted(groups), 2))
        groups[a] += groups.pop(b)
        merges.append((a, b, float(h)))
    return merges


def redundancy(df: DataFrame, columns: list[str], key: str, least_gap: float = 0.05, fallback: float = 0.25) -> DataFrame:
    """(feature, cluster, representative): columns grouped by 1 - rho^2, cut in the widest gap of merge heights.

    The representative is the first by name. The matrix is as large as the number of columns.
    """
    rho = rank_correlation(df, columns, key)
    merges = average_linkage(np.clip(1 - rho**2, 0, 1))
    heights = sorted(h for _, _, h in merges)
    gaps = np.diff(heights)
    cut = fallback
    if len(gaps) and gaps.max() >= least_gap:
        i = int(gaps.argmax())
        cut = (heights[i] + heights[i + 1]) / 2
    label = list(range(len(columns)))
    for a, b, h in merges:
        if h <= cut:
            la, lb = label[a], label[b]
            label = [la if x == lb else x for x in label]
    names = {x: i for i, x in enumerate(dict.fromkeys(label))}
    first = {x: min(c for c, y in zip(columns, label) if y == x) for x in set(label)}
    return df.sparkSession.createDataFrame([(c, names[x], c == first[x]) for c, x in zip(columns, label)], "feature string, cluster int, representative boolean")


class _Free:
    """Free controls of a group by value: controls of one value are taken in the order of their keys, and a value without any is stepped over."""

    def __init__(self, values: np.ndarray, keys: pa.Array):
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
        self.keys, n = keys, len(first)
        self.values = array("d", np.r_[-np.inf, values[first], np.inf])
        self.next, self.end = array("q", np.r_[0, first, 0]), array("q", np.r_[0, first[1:], [len(values)] * (n > 0), 0])
        self.down, self.up = array("q", range(n + 2)), array("q", range(n + 2))

    @staticmethod
    def _step(to: array, i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    def _tied(self, x: float, d: float, low: int, high: int) -> int:
        """Of the values that round to one distance the one whose next key is the smallest."""
        at = []
        while abs(x - self.values[low]) == d:
            at.append(low)
            low = self._step(self.down, low - 1)
        while abs(self.values[high] - x) == d:
            at.append(high)
            high = self._step(self.up, high + 1)
        return min(at, key=lambda i: self.keys[self.next[i]].as_py())

    def take(self, x: float, at: int, caliper: float, ratio: int) -> list[int]:
        """Numbers of the nearest controls of a case with value ``x``, which lies at or below the value numbered ``at``."""
        v, down, up, got = self.values, self.down, self.up, []
        low, high = self._step(down, at - 1), self._step(up, at)
        while len(got) < ratio:
            below, above = x - v[low], v[high] - x
            d = min(below, above)
            if d > caliper or d == math.inf:
                break
            if below == above or (below == d and x - v[low - 1] == d) or (above == d and v[high + 1] - x == d):
                i = self._tied(x, d, low, high)
            else:
                i = low if below == d else high
            got.append(self.next[i])
            self.next[i] += 1
            if self.next[i] == self.end[i]:
                down[i], up[i] = i - 1, i + 1
                low, high = self._step(down, low), self._step(up, high)
        return got


def _in_turn(caliper: float, ratio: int):
    """(case, control) of rows sorted by group, controls before cases, controls by value and key, cases by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, controls, free = None, [], None
        for batch in batches:
            rows = zip(batch.column("group").to_pylist(), batch.column("side").to_pylist())
            at = 0
            for (g, side), same in groupby(rows):
                part = batch.slice(at, sum(1 for _ in same))
                at += len(part)
                if g != group:
                    group, controls, free = g, [], None
                values = part.column("value").to_numpy()
                if side == 0:
                    controls.append((values, part.column("control")))
                elif controls:
                    if free is None:
                        free = _Free(np.concatenate([v for v, _ in controls]), pa.concat_arrays([k for _, k in controls]))
                        controls = [(free.keys, None)]
                    got = [free.take(x, i, caliper, ratio) for x, i in zip(values.tolist(), np.searchsorted(free.values, values).tolist())]
                    turn = np.repeat(np.arange(len(got)), [len(x) for x in got])
                    if len(turn):
                        yield pa.RecordBatch.from_arrays([part.column("case").take(pa.array(turn)), free.keys.take(pa.array(list(chain(*got))))], ["case", "control"])

    return run


def caliper_match(cases: DataFrame, controls: DataFrame, by: list[str], key: str, value: str, caliper: float, ratio: int, scratch, drawn: bool = False) -> DataFrame:
    """(case, control): each case in turn takes its up to ``ratio`` nearest free controls, ties by key.

    Turns are in ascending order of the key or, with ``drawn``, in the order of a hash of it. Keys are unique.

    A group is matched in one task, as any turn may depend on all before it. The task reads the rows sorted: it
    holds the group's controls, some 40 bytes and a key each, and takes the cases one after another,
    so work grows with the rows and not with the pairs within the caliper.
    """
    if caliper <= 0:
        raise ValueError("the caliper must be positive")
    ok = (F.abs(value) < float("inf")) & F.col(key).isNotNull()
    for c in by:
        ok = ok & F.col(c).isNotNull()

    def rows(df: DataFrame, side: int, name: str, other: str, other_type) -> DataFrame:
        turn = F.xxhash64(F.lit(42), key) if drawn and side else F.lit(0).cast("long")
        # 0.0 is added as -0.0 is the same value
        return df.where(ok).select(F.to_json(F.struct(*by)).alias("group") if by else F.lit("").alias("group"), F.lit(side).alias("side"), (F.col(value).cast("double") + 0.0).alias("value"), turn.alias("turn"), F.col(key).alias(name), F.lit(None).cast(other_type).alias(other))

    kinds = cases.schema[key].dataType, controls.schema[key].dataType
    both = rows(controls, 0, "control", "case", kinds[0]).unionByName(rows(cases, 1, "case", "control", kinds[1]))
    order = ["group", "side", F.when(F.col("side") == 0, F.col("value")), "turn", "control", "case"]
    both = both.repartition("group").sortWithinPartitions(*order).select("group", "side", "value", "case", "control")
    schema = StructType([StructField("case", kinds[0]), StructField("control", kinds[1])])
    return scratch.save(both.mapInArrow(_in_turn(caliper, ratio), schema), "pairs")


def null_agreement(ones: int, zeros: int, rate: float = 0.1, percentile: float = 5.0) -> float | None:
    """The adjusted Rand index that two labels keep with all but ``percentile`` % of chances when ``rate`` of them flip.

    Which rows flip matters only through how many of them have label 1, a hypergeometric number, so the
    percentile comes from its probabilities and not from simulated rows. Null where nothing flips.
    """
    n = ones + zeros
    m = math.floor(rate * n)
    if m == 0 or n <= 1:
        return None
    mean = m * ones / n
    wide = 12 * math.sqrt(max(mean * (1 - ones / n) * (n - m) / (n - 1), 1.0)) + 2
    x = np.arange(max(0, m - zeros, math.floor(mean - wide)), min(m, ones, math.ceil(mean + wide)) + 1, dtype=float)
    # probabilities up to a factor, from the ratios of neighbours
    step = np.log((ones - x[:-1]) * (m - x[:-1])) - np.log((x[1:]) * (zeros - m + x[1:]))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    prob = np.exp(log_p - log_p.max())
    pair = lambda v: v * (v - 1) / 2
    both = pair(ones - x) + pair(x) + pair(m - x) + pair(zeros - m + x)
    a, b = pair(ones) + pair(zeros), pair(ones - 2 * x + m) + pair(zeros - m + 2 * x)
    by_chance = a * b / pair(n)
    most = (a + b) / 2
    ari = np.where(most == by_chance, 1.0, (both - by_chance) / np.where(most == by_chance, 1.0, most - by_chance))
    order = np.argsort(ari)
    return float(ari[order][min(np.searchsorted(np.cumsum(prob[order]) / prob.sum(), percentile / 100), len(x) - 1)])


class Frozen:
    """Scaling, components to a share of the variance and a mixture of two, fitted on training rows; ``predict`` never fits again."""

    def __init__(self, train: DataFrame, columns: list[str], share: float = 0.85, parts: int = 2, seed: int = 42, steps: int = 20):
        from pyspark.ml.clustering import GaussianMixture

        self.columns = columns
        n, self.mean, cov = gram(train, columns)
        var = np.diag(cov) * n / max(n - 1, 1)
        self.sd = np.where(var > 0, np.sqrt(np.maximum(var, 1e-300)), 1.0)
        values, vectors = np.linalg.eigh(cov / np.outer(self.sd, self.sd))
        order = np.argsort(values)[::-1]
        k = int(np.searchsorted(np.cumsum(values[order]) / max(values.sum(), 1e-300), share - 1e-12)) + 1
        load = vectors[:, order[:k]].T
        sign = np.sign(load[np.arange(len(load)), np.abs(load).argmax(axis=1)])
        self.load = load * np.where(sign == 0, 1, sign)[:, None]
        self.names = [f"pc{i + 1}" for i in range(len(self.load))]
        self.model = GaussianMixture(k=parts, seed=seed, maxIter=steps).fit(self._vectors(self.project(train)))
        self.means = np.array([np.asarray(g.mean) for g in self.model.gaussians])

    def project(self, df: DataFrame) -> DataFrame:
        """Complete rows with their scores."""
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.sd)]
        return df.na.drop(subset=self.columns).withColumns({n: sum((x * float(v) for x, v in zip(z, row)), F.lit(0.0)) for n, row in zip(self.names, self.load)})

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.names, outputCol="features").transform(df)

    def predict(self, df: DataFrame) -> DataFrame:
        """Complete rows with scores, label and the distance to each part's mean."""
        out = self.model.transform(self._vectors(self.project(df))).withColumnRenamed("prediction", "label")
        far = lambda m: F.sqrt(sum(((F.col(n) - float(v)) ** 2 for n, v in zip(self.names, m)), F.lit(0.0)))
        return out.withColumns({f"distance_{i}": far(m) for i, m in enumerate(self.means)}).drop("features", "probability")
