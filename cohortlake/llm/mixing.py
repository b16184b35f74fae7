"""Mixing sources to target weights: hash-seeded Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.tokens import with_tokens
from cohortlake.session import Scratch, table

#: Rates tried in one pass of the search for a source's rate.
GRID = 24


def uniform(*cols) -> Column:
    """A number in (0, 1) from a hash of the columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_count(u: Column, rate: Column, cap: Column) -> Column:
    """The inverse Poisson distribution of ``rate`` at ``u``, at most ``cap`` (all three per row).

    Sums the distribution term by term up to the cap, so the work is the cap, not the rate.
    """
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))
    step = lambda acc, i: F.when(acc["cdf"] >= u, acc).otherwise(F.struct((acc["term"] * rate / i).alias("term"), (acc["cdf"] + acc["term"] * rate / i).alias("cdf"), i.alias("k")))
    return F.when(cap < 1, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(cap, F.lit(1))), start, step, lambda acc: acc["k"]))


def rates(sized: DataFrame, targets: DataFrame, seed: int, passes: int = 4) -> DataFrame:
    """(source, share, cap, available, goal, rate) per source of ``targets`` that has tokens.

    The goal is the largest mix that all shares allow: the total is the least of cap * tokens / share.
    A source's rate is found on grids of rates, narrowed around the one whose drawn tokens come nearest
    to the goal; a source whose goal is all it may give has rate infinity (every count is the cap).
    """
    scratch = Scratch(sized.sparkSession, "mixing")
    avail = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count_if(F.col("n_tokens") > 0).alias("n_docs"))
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0 and not isnan(target_share)").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("cap"))
    t = t.join(avail.where("available > 0"), "source")
    whole = t.agg(F.sum("target_share").alias("s"))
    t = t.join(whole, F.lit(True)).withColumn("share", F.col("target_share") / F.col("s"))
    total = t.agg(F.min(F.col("cap") * F.col("available") / F.col("share")).alias("total"))
    t = t.join(total, F.lit(True)).withColumn("goal", F.col("total") * F.col("share"))
    full = F.col("goal") >= F.col("cap") * F.col("available") * (1 - 1e-12)
    # rate 2 * mean + 40 fills a capped mean nearly to the cap
    state = scratch.save(t.select("source", "target_share", "share", "cap", "available", "goal", full.alias("full"), F.lit(0.0).alias("low"), (F.col("goal") / F.col("available") * 2 + 40).alias("high")), "state")
    docs = sized.select("source", "doc_id", "n_tokens").where("n_tokens > 0")
    for _ in range(passes):
        grid = state.where("not full").select("source", "cap", "goal", F.explode(F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / GRID)).alias("rate"))
        drawn = docs.join(F.broadcast(grid), "source").withColumn("c", poisson_count(uniform(F.lit(seed), "doc_id"), F.col("rate"), F.col("cap")))
        sums = drawn.groupBy("source", "rate").agg(F.sum(F.col("c") * F.col("n_tokens")).alias("got"), F.first("goal").alias("goal"))
        near = sums.groupBy("source").agg(F.max(F.when(F.col("got") <= F.col("goal"), F.col("rate"))).alias("a"), F.min(F.when(F.col("got") >= F.col("goal"), F.col("rate"))).alias("b"), F.min_by("rate", F.struct(F.abs(F.col("got") - F.col("goal")), "rate")).alias("best"))
        state = scratch.save(state.drop("best").join(near, "source", "left").withColumn("low", F.coalesce("a", "low")).withColumn("high", F.coalesce("b", "high")).drop("a", "b"), "state")
    return state.select("source", "target_share", "share", "cap", "available", "goal", F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.col("best")).alias("rate"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Repeat documents so that each source reaches its share of the tokens; returns (mix, shares).

    ``sized``: doc_id, source, n_tokens; ``targets``: source, target_share, max_repeats, a small table
    that the caller configures (one row per source, and so broadcast). The mix has a row per use of a
    document: source, doc_id, copy (from 1), n_tokens, ordered by a hash over the whole table. A
    document's count inverts a Poisson distribution with the source's rate at a hash of its id, capped
    at max_repeats. Documents without tokens, without source or of a source without target are left
    out; shares that do not add up to 1 are scaled. The shares tell per source: target_share,
    actual_share, tokens used and available, documents used, most_used.
    """
    scratch = Scratch(sized.sparkSession, "mix")
    rate = scratch.save(rates(sized, targets, seed), "rates")
    d = sized.where("n_tokens > 0").join(F.broadcast(rate.select("source", "cap", "rate")), "source")
    count = F.when(F.col("rate") == float("inf"), F.col("cap")).otherwise(poisson_count(uniform(F.lit(seed), "doc_id"), F.col("rate"), F.col("cap")))
    used = scratch.save(d.select("source", "doc_id", "n_tokens", count.alias("uses")).where("uses > 0"), "used")
    copies = used.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"), "n_tokens")
    mixed = copies.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), "doc_id", "copy")
    per = used.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens_used"), F.count("*").alias("docs_used"), F.max("uses").alias("most_used"))
    whole = per.agg(F.sum("tokens_used").alias("w"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    shares = t.join(per, "source", "left").join(rate.select("source", "available", "rate"), "source", "left").join(whole, F.lit(True), "left")
    shares = shares.select("source", "target_share", F.coalesce(F.col("tokens_used") / F.col("w"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("available", F.lit(0)).alias("tokens_available"), F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeats", "rate")
    return mixed, shares


def _sized(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return Scratch(spark, "sized").save(with_tokens(docs), "sized")


def p8_mix(spark, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]
