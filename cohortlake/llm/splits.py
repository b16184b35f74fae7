"""Splits that keep related records together: random-mate contraction, then splits by cumulative weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.scoring import kernel_key
from cohortlake.session import Scratch, blocked_cumsum, table

# fixed values: spellings that stand for "no person"
PLACEHOLDERS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "unknown", "anonymous", "anon", "unbekannt", "inconnu", "missing", "tbd", "test", "xxx")
# fixed values: the three sides of a split and their shares
PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def person_number(subject: Column) -> Column:
    """The person number that a free subject_id means, or null for blanks, placeholders and numbers of only 0 or only 9."""
    s = F.lower(F.trim(F.regexp_replace(subject, r"[\s ﻿]+", " ")))
    s = F.regexp_replace(s, r"[.,]0+$", "")
    digits = F.regexp_extract(s, r"([0-9]+)\D*$", 1)
    bare = F.regexp_replace(digits, "^0+", "")
    only_nines = digits.rlike("^9{5,}$")
    return F.when(subject.isNull() | s.isin(*PLACEHOLDERS) | (bare == "") | only_nines, F.lit(None)).otherwise(bare)


def contract(edges: DataFrame, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of ``edges`` (a STRING, b STRING) by random-mate contraction.

    Each round every vertex draws a coin from a hash of its name and the round. A vertex with tails
    that has a neighbour with heads is collapsed into the smallest such neighbour, edges are renamed,
    and loops and repeats vanish. When no edge is left the rounds are unwound from the last to the
    first. Returns (vertex, component), one row per vertex on an edge; component is a member's name.
    Null ends and loops link nothing. A vertex with very many edges is aggregated map-side, so it
    fills no task; an edge outlives a round with probability at most 3/4, independent of its shape.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "contract")
    e = scratch.save(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    heads = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(len(rounds)), c), F.lit(2)) == 1
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("w")).union(e.select("b", "a"))
        mate = both.where(~heads(F.col("v")) & heads(F.col("w"))).groupBy("v").agg(F.min("w").alias("into"))
        mate = scratch.save(mate, "mates")
        ma, mb = mate.select(F.col("v").alias("a"), F.col("into").alias("ia")), mate.select(F.col("v").alias("b"), F.col("into").alias("ib"))
        named = e.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b")).where("a <> b")
        old, e = e, scratch.save(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        rounds.append(mate)
        scratch.drop(old)
    scratch.drop(e)
    if not rounds:
        return spark.createDataFrame([], "vertex string, component string")
    labels = rounds[-1].select(F.col("v").alias("vertex"), F.col("into").alias("component"))
    for i, mate in enumerate(reversed(rounds[:-1])):
        up = labels.select(F.col("vertex").alias("_v"), F.col("component").alias("_c"))
        now = mate.join(up, mate["into"] == F.col("_v"), "left").select(F.col("v").alias("vertex"), F.coalesce("_c", "into").alias("component"))
        # a vertex collapses at most once, so the rounds' vertices never meet
        labels = labels.unionByName(now)
        if i % 4 == 3:
            labels = scratch.save(labels, "labels")
    labels = scratch.save(labels, "labels")
    return labels.unionByName(labels.select(F.col("component").alias("vertex"), "component").distinct())


def person_edges(manifest: DataFrame) -> DataFrame:
    """Edges (a, b) between scans of one person: same person number, same series, or one's prior.

    Scans that share a key are joined to the smallest pid of the key, a star, never to each other. A
    prior_pid that is no scan of the table, nulls, blanks and placeholders link nothing.
    """
    m = manifest.select(F.trim("pid").alias("pid"), person_number(F.col("subject_id")).alias("person"), F.trim("prior_pid").alias("prior"), F.trim("series_uid").alias("series")).where("pid <> ''")
    series = F.when(~F.lower("series").isin(*PLACEHOLDERS), F.col("series"))
    keys = m.select("pid", F.explode(F.array(F.concat(F.lit("p"), "person"), F.concat(F.lit("s"), series))).alias("key")).where("key is not null").distinct()
    star = keys.groupBy("key").agg(F.min("pid").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    shared = keys.join(star, "key").select(F.col("pid").alias("a"), "b").where("a <> b")
    known = m.select(F.col("pid").alias("b")).distinct()
    prior = m.select(F.col("pid").alias("a"), F.col("prior").alias("b")).where("b is not null and a <> b").join(known, "b", "left_semi").select("a", "b")
    return shared.unionByName(prior)


def persons(manifest: DataFrame) -> DataFrame:
    """(pid, person): each distinct pid of the manifest with the component of its person."""
    comp = contract(person_edges(manifest))
    pids = manifest.select(F.trim("pid").alias("pid")).where("pid <> ''").distinct()
    return pids.join(comp, pids["pid"] == comp["vertex"], "left").select("pid", F.coalesce("component", "pid").alias("person"))


def leaks(splits: DataFrame, people: DataFrame) -> DataFrame:
    """(split_id, fold, pid) of test pids whose person also has a scan in training.

    Blanks around pids are dropped; a pid outside ``people`` is a person of its own; null lists and
    null pids give nothing; repeated pids count once.
    """

    def side(col: str) -> DataFrame:
        d = splits.select("split_id", "fold", F.explode(col).alias("pid")).select("split_id", "fold", F.trim("pid").alias("pid")).where("pid <> ''").distinct()
        return d.join(people, "pid", "left").select("split_id", "fold", "pid", F.coalesce("person", "pid").alias("person"))

    train = side("train_pids").select("split_id", "fold", "person").distinct()
    return side("test_pids").join(train, ["split_id", "fold", "person"], "left_semi").select("split_id", "fold", "pid").distinct()


def assign(records: DataFrame, proportions=PROPORTIONS, seed: int = 7, blocks: int = 64) -> DataFrame:
    """Give whole groups to sides of a split: ``records`` has (pid, person, stratum).

    A group's weight is its number of records and its stratum that of most of its records (ties to the
    smallest). Groups of a stratum stand in an order drawn from a hash; the side is where the middle of
    the group's stretch of the cumulative weight falls, so every stratum is shared out alike. The sum
    runs in ``blocks`` blocks. Returns (pid, person, side), one row per pid.
    """
    one = records.select("pid", "person", F.coalesce("stratum", F.lit("none")).alias("stratum")).distinct()
    per = one.groupBy("person", "stratum").agg(F.count("*").alias("n"))
    groups = per.groupBy("person").agg(F.sum("n").alias("weight"), F.max_by("stratum", F.struct("n", F.col("stratum"))).alias("stratum"))
    groups = groups.withColumn("draw", F.xxhash64(F.lit(seed), "person"))
    block = F.least(F.lit(blocks - 1), F.floor((F.col("draw").cast("double") / F.lit(2.0**64) + 0.5) * blocks)).cast("int")
    run = blocked_cumsum(groups, ["stratum"], ["draw", "person"], block, F.col("weight"), "before", blocks)
    total = groups.groupBy("stratum").agg(F.sum("weight").alias("total"))
    at = (F.col("before") + F.col("weight") / 2) / F.col("total")
    side, upto = None, 0.0
    for name, share in proportions:
        upto += share
        side = F.when(at < upto, name) if side is None else side.when(at < upto, name)
    run = run.join(total, "stratum").select("person", side.otherwise(proportions[-1][0]).alias("side"))
    return one.select("pid", "person").distinct().join(run, "person").select("pid", "person", "side")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "fold_splits"), persons(table(spark, sf_dir, "manifest")))


def p5_splits(spark, sf_dir: str) -> DataFrame:
    """One row per scan: its person, and the side that the whole person has."""
    m = table(spark, sf_dir, "manifest")
    first = m.select(F.trim("pid").alias("pid"), kernel_key(F.col("kernel")).alias("k")).where("pid <> ''").groupBy("pid").agg(F.min("k").alias("stratum"))
    return assign(persons(m).join(first, "pid"))
