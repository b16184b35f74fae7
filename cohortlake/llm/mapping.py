"""Mapping free-entered values to a canonical list: token repair by edit distance, soft TF-IDF ranking."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.session import Scratch, table

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = str.maketrans("аеорсухіјѕԁԛԝАВЕКМНОРСТУХІЈЅαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧı", "aeopcyxijsdqwABEKMHOPCTYXIJSabeikvoptuxABEZHIKMNOPTYXi")
# fixed values: digits and signs written for letters
LEET = str.maketrans("01345789@$!|", "oieastbgasil")
# fixed values: words around a name that say nothing about which one is meant
NOISE = frozenset("roi vessel calcium calcification calc plaque in of the at copy lesion segment seg reader read by".split())
# fixed values: ways to write the ordinals of a numbered entry
NUMERALS = {"1st": "first", "2nd": "second", "1": "first", "2": "second", "i": "first", "ii": "second", "one": "first", "two": "second"}
# fixed values: words of the field for an entry's words, which no spelling tells
SYNONYMS = {"main": "coronary artery", "stem": "coronary artery"}
#: Likeness of a word to its beginnings, to an abbreviation by its first letter and one or two later ones, to a part of it, and to a word that begins alike.
BEGINNING, ABBREVIATION, PART, ALIKE = 0.95, 0.85, 0.8, 0.7

UNMATCHED = "UNMATCHED"


def words_of(text: str | None) -> list[str]:
    """The plain lower-case words of a typed value: accents, lookalikes, leet, dots and camel case undone."""
    if text is None:
        return []
    s = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(LOOKALIKES)
    s = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m[0].replace(".", "") + " ", s)
    s = " ".join(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", w) if re.fullmatch(r"(?:[A-Z][a-z]{3,}){2,}", w) else w for w in s.split())
    raw = re.findall(r"[a-z0-9@$!|]*[a-z0-9][a-z0-9@$!|]*", s.lower().replace("_", " "))
    out: list[str] = []
    skip = False
    for i, w in enumerate(raw):
        w = w.rstrip("!|") or w
        if skip and (w.isdigit() or len(w) == 1):  # the number of a region, the letter of a reader
            skip = False
            continue
        skip = w in ("roi", "reader")
        if w in NOISE:
            continue
        if w.isdigit() or re.fullmatch(r"[a-z]{1,2}[0-9]|[0-9](?:st|nd|rd|th)", w):
            out.append(w)
            continue
        w = w.translate(LEET)
        if len(w) == 1 and out and len(out[-1]) == 1 and out[-1].isalpha() and i and len(raw[i - 1]) == 1:
            out[-1] += w  # letters typed apart: A-V, L A D
        else:
            out.append(w)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_of(values: pd.Series) -> pd.Series:
    return values.map(words_of)


def _deletions(word: Column, most: Column) -> Column:
    """The word and all words that deleting one or two letters leaves, for an equi-join by edit distance."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    none, one = F.array(word), cut(word)
    two = F.flatten(F.transform(one, cut))
    return F.array_distinct(F.when(most >= 2, F.concat(none, one, two)).when(most >= 1, F.concat(none, one)).otherwise(none))


def _allowed(length: Column) -> Column:
    return F.when(length <= 3, 0).when(length <= 5, 1).otherwise(2)


def repair(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim): words of the vocabulary that a distinct token may stand for.

    ``tokens``: token; ``vocabulary``: word. By edit distance up to 0, 1 or 2 for words of up to 3, up
    to 5 and more letters, found by an equi-join on shared deletions and then measured; or, from three
    letters on, as the beginning of a word. Both sides are joined by keys, never each with each.
    """
    longest = vocabulary.agg(F.max(F.length("word")).alias("most"))
    # two more letters than the longest word are beyond any distance
    t = tokens.join(longest, F.length("token") <= F.col("most") + 2).select("token", F.explode(_deletions(F.col("token"), _allowed(F.length("token") + 1))).alias("k"))
    v = vocabulary.select("word", F.explode(_deletions(F.col("word"), _allowed(F.length("word")))).alias("k"))
    near = t.join(v, "k").select("token", "word").distinct()
    near = near.withColumn("d", F.levenshtein("token", "word")).where(F.col("d") <= _allowed(F.length("word")))
    near = near.select("token", "word", (1 - F.col("d") / F.greatest(F.length("token"), F.length("word"))).alias("sim"))
    long = vocabulary.where("length(word) > 3")
    starts = long.select("word", F.explode(F.transform(F.sequence(F.lit(3), F.length("word") - 1), lambda i: F.substr("word", F.lit(1), i))).alias("token"))
    short = tokens.join(starts, "token").select("token", "word", F.lit(BEGINNING).alias("sim"))
    return near.unionByName(short).groupBy("token", "word").agg(F.max("sim").alias("sim"))


def abbreviations(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim): words that a token may shorten, learned from the words themselves.

    A token of up to three letters shortens a word that begins with its first letter and has its others
    later on, in their order; one of three or more letters may be a part of a long word, or begin with the
    three letters that a word of five or more begins with. All by keys that the vocabulary's words generate.
    """
    letters = F.transform(F.sequence(F.lit(2), F.length("word")), lambda i: F.substr("word", i, F.lit(1)))
    first = F.substr("word", F.lit(1), F.lit(1))
    two = F.transform("letters", lambda x: F.concat(first, x))
    three = F.flatten(F.transform("letters", lambda x, i: F.transform(F.slice("letters", i + 2, F.size("letters")), lambda y: F.concat(first, x, y))))
    some = vocabulary.where("length(word) > 1").withColumn("letters", letters)
    keys = some.select("word", F.explode(F.array_distinct(F.concat(F.array(first), two, three))).alias("token"))
    out = tokens.join(keys, "token").select("token", "word", F.lit(ABBREVIATION).alias("sim"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(2), F.length("word") - 2), lambda i: F.transform(F.sequence(F.lit(3), F.length("word") - i + 1), lambda n: F.substr("word", i, n))))
    parts = vocabulary.where("length(word) > 5").select("word", F.explode(F.array_distinct(cuts)).alias("token"))
    out = out.unionByName(tokens.join(parts, "token").select("token", "word", F.lit(PART).alias("sim")))
    stem = lambda c: F.substr(c, F.lit(1), F.lit(3)).alias("stem")
    alike = tokens.where("length(token) between 4 and 6").select("token", stem("token")).join(vocabulary.where("length(word) >= 5").select("word", stem("word")), "stem")
    out = out.unionByName(alike.select("token", "word", F.lit(ALIKE).alias("sim")))
    return out.groupBy("token", "word").agg(F.max("sim").alias("sim"))


def match(values: DataFrame, reference: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(value, code, score): the entry of ``reference`` that each distinct value means, or UNMATCHED.

    ``values``: value STRING; ``reference``: code, name, short_forms ARRAY<STRING>. Names are cut into
    words; one-word short forms stand for the words of their entry's name. Distinct tokens are repaired
    against the reference's words, and what stands for none may shorten one (``abbreviations``). The score of an entry is the
    cosine of TF-IDF vectors in which a repaired token counts by its similarity; a token that repairs
    to nothing counts as a rare word against every entry, a number that an entry lacks counts not at
    all, and a value that matches by numbers only means none. Ties go to the smaller code. Null
    values are left out; blank values and values without words are UNMATCHED.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "mapping")
    val = scratch.save(values.where("value is not null").select("value").distinct().withColumn("tokens", tokens_of("value")), "values")
    toks = val.select("value", F.posexplode("tokens").alias("pos", "token"))

    ref = scratch.save(reference.where("code is not null and name is not null").select("code", "name", "short_forms").withColumn("words", F.array_distinct(tokens_of("name"))), "reference")
    entry_words = ref.select("code", F.explode("words").alias("word")).distinct()
    n = ref.select("code").distinct().agg(F.count("*").alias("N"))
    idf = entry_words.groupBy("word").agg(F.count("*").alias("df")).join(n, F.lit(True)).select("word", F.log(1 + F.col("N") / F.col("df")).alias("idf"), F.log(1 + 2 * F.col("N")).alias("rare"))
    weighted = entry_words.join(idf, "word")
    norms = weighted.groupBy("code").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm_e"))
    vocabulary = entry_words.select("word").distinct()

    # what a token stands for as a whole: short forms of one word, the letters of numbered ones, numerals
    codes = ref.select(F.explode("short_forms").alias("s"), "words").withColumn("t", tokens_of("s")).where("size(t) = 1").select(F.col("t")[0].alias("token"), "words", F.explode("words").alias("word"))
    fixed = spark.createDataFrame([(k, w) for k, ws in (NUMERALS | SYNONYMS).items() for w in ws.split()], "token string, word string")
    # the letters of numbered codes stand for the words of their entries that are no numerals
    base = codes.select(F.regexp_extract("token", "^([a-z]{2,})[0-9]+$", 1).alias("token"), "word").where((F.col("token") != "") & ~F.col("word").isin(*set(NUMERALS.values())))
    fixed = fixed.unionByName(base.distinct())
    fixed = fixed.join(vocabulary, "word", "left_semi").join(codes.select("token").distinct(), "token", "left_anti")
    whole = codes.select("token", "word").unionByName(fixed).distinct()
    distinct = toks.select("token").distinct()
    known = distinct.join(whole, "token").select("token", "word", F.lit(1.0).alias("sim"), F.lit(True).alias("whole"))
    rest = scratch.save(distinct.join(whole.select("token").distinct(), "token", "left_anti"), "rest")
    repaired = scratch.save(repair(rest, vocabulary), "repaired")
    # a token that stands for no word yet may be a short form and one or two initials of its entry's words, or shorten a word
    open_ = scratch.save(rest.join(repaired.select("token").distinct(), "token", "left_anti"), "open")
    cut = open_.where("length(token) >= 3").select("token", F.explode(F.transform(F.array(F.lit(1), F.lit(2)), lambda i: F.substr("token", F.lit(1), F.length("token") - i))).alias("code"))
    initials = lambda ws: F.transform(ws, lambda w: F.substr(w, F.lit(1), F.lit(1)))
    longer = cut.where("length(code) >= 2").join(codes.select(F.col("token").alias("code"), "word", "words"), "code")
    more = F.filter(F.split(F.substr("token", F.length("code") + 1), ""), lambda x: x != "")
    longer = longer.where(F.size(F.array_except(more, initials(F.col("words")))) == 0).select("token", "word", F.lit(ABBREVIATION).alias("sim"), F.lit(True).alias("whole")).distinct()
    shortened = abbreviations(open_.join(longer.select("token").distinct(), "token", "left_anti"), vocabulary)
    mapped = scratch.save(known.unionByName(longer).unionByName(repaired.unionByName(shortened).withColumn("whole", F.lit(False))), "mapped")

    number = F.col("token").rlike("^[0-9]+$")
    hits = toks.join(mapped, "token", "left").join(idf.select("word", "idf"), "word", "left").join(n.select(F.log(1 + 2 * F.col("N")).alias("rare")), F.lit(True))
    hits = scratch.save(hits, "hits")
    # a whole stands for all its words; else a token weighs as the likeliest of its words, or as a rare one
    per_token = hits.groupBy("value", "pos").agg(F.max("rare").alias("rare"), F.max(number).alias("number"), F.max("whole").alias("whole"), F.sum(F.col("idf") ** 2).alias("all2"), F.max_by("idf", F.struct("sim", "idf")).alias("top"))
    weight2 = F.when(F.col("number"), 0.0).when(F.col("whole"), F.col("all2")).otherwise(F.coalesce("top", "rare") ** 2)
    norm_v = per_token.groupBy("value").agg(F.sum(weight2).alias("norm2"), F.max(~F.col("number")).alias("letters"))

    pair = hits.where("word is not null").select("value", "pos", "word", "sim", "idf", number.alias("number")).join(entry_words, "word")
    best = pair.groupBy("value", "code", "pos").agg(F.max("sim").alias("top"))
    pair = pair.join(best, ["value", "code", "pos"]).where("sim = top")
    word_hit = pair.groupBy("value", "code", "word").agg(F.max("sim").alias("sim"), F.max("idf").alias("idf"), F.min("number").alias("number"))
    dot = word_hit.groupBy("value", "code").agg(F.sum(F.col("sim") * F.col("idf") ** 2).alias("dot"), F.sum(F.when(F.col("number"), F.col("idf") ** 2).otherwise(0.0)).alias("by_number"), F.min("number").alias("only_numbers"))
    score = F.col("dot") / (F.sqrt(F.col("norm2") + F.col("by_number")) * F.col("norm_e"))
    ranked = dot.where("not only_numbers").join(norm_v, "value").join(norms, "code").select("value", "code", F.round(score, 9).alias("score"))
    top = ranked.groupBy("value").agg(F.min_by(F.struct("code", "score"), F.struct(-F.col("score"), F.col("code"))).alias("top"))
    out = val.select("value").join(top, "value", "left").select("value", F.col("top.code").alias("code"), F.coalesce("top.score", F.lit(0.0)).alias("score"))
    return out.select("value", F.when(F.col("score") >= threshold, F.col("code")).otherwise(UNMATCHED).alias("code"), "score")


def _reference(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vessel_ref").select(F.col("vessel_code").alias("code"), F.col("vessel_name").alias("name"), "short_forms")


def p1_found(spark, sf_dir: str) -> DataFrame:
    ref = _reference(spark, sf_dir)
    rois = table(spark, sf_dir, "rois").where("roi_id is not null and vessel_raw is not null").select("roi_id", F.col("vessel_raw").alias("value"))
    free = rois.join(ref.select(F.col("name").alias("value")).distinct(), "value", "left_anti")
    codes = match(free, ref)
    return free.join(codes, "value").groupBy("roi_id").agg(F.min("code").alias("vessel_code"))


def p1_report(spark, sf_dir: str) -> DataFrame:
    """(value, code, n_rois, n_dirty): each typed name with its entry, and how often it is met."""
    ref = _reference(spark, sf_dir)
    typed = table(spark, sf_dir, "rois").where("vessel_raw is not null").groupBy(F.col("vessel_raw").alias("value")).agg(F.countDistinct("roi_id").alias("n_rois"))
    dirty = table(spark, sf_dir, "parse_results").select(F.explode("dirty_vessel_names").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n_dirty"))
    both = typed.join(dirty, "value", "full").na.fill(0, ["n_rois", "n_dirty"])
    codes = match(both.select("value"), ref)
    return both.join(codes, "value").select("value", "code", "n_rois", "n_dirty")
