"""Abusive, hateful or sexual content: cumulative-link ordinal regression over hashed text features.

No word is named here: every weight comes from reviewed documents. A document is as severe as its worst
sentence, and a reviewer says only that some sentence is, so sentences and weights are found in turns.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.mapping import LOOKALIKES
from cohortlake.session import Scratch, table

CATEGORIES = ("abuse", "hate", "sexual")
#: Reviewed documents that the models are fitted on at most, drawn by a hash of their id, and how long such a document may be.
FIT_DOCUMENTS, FIT_CHARS = 6_000, 20_000
#: Severity grades above 0; a category occurs in a document whose chance of grade 2 or more is at least DECIDE (weights held near 0 give low chances).
GRADES, DECIDE = 3, 0.35
#: Features are hashed into so many buckets.
BUCKETS = 1 << 22
#: Lengths of character n-grams, and their value beside a word's 1.
GRAMS, GRAM_VALUE = (4, 5), 0.1

_LEET = str.maketrans("034578@$€!|", "oeastbaseii")
_SEP = re.compile(r"(?<![^\W\d_])([^\W\d_]([ .\-_·*]{1,2})(?:[^\W\d_]\2){2,}[^\W\d_])(?![^\W\d_])")
_QUOTED = re.compile(r"„[^“”\n]*[“”]|“[^”\n]*”|«[^»\n]*»|»[^«\n]*«|\"[^\"\n]*\"")
_STRUCK = re.compile(r"~~.*?~~|<(?:s|del|strike)>.*?</(?:s|del|strike)>|\[[^\]\n]*(?:struck|stricken|gestrichen|rayé|expunged)[^\]\n]*\]", re.S)
_SPLIT = re.compile(r"(?:(?<!\b[A-Z])(?<!\bAbg)(?<!\bDr)(?<!\bMr)(?<!\bMs)[.!?…]+[)\]]?\s+)|\n+|(?<=\))\s+(?=\()")
_WORD = re.compile(r"?(?:[^\W_](?:[\w*@$€'’\-|]*[\w*@$€])?|[@$][\w*@$]+|\*+[^\W_][\w*]*)")
_RUN = re.compile(r"(.)\1+")


def _squeeze(word: str) -> str:
    return _RUN.sub(r"\1", word)


def _plain(text: str) -> str:
    s = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
    s = "".join(c for c in s if not (unicodedata.combining(c) or unicodedata.category(c) == "Cf")) if not s.isascii() else s
    return s.translate(LOOKALIKES).replace("ß", "ss").replace("’", "'")


def segments(text: str) -> Iterator[list[str]]:
    """The words of each sentence or heckle: struck words are left out, quoted ones begin with a quote mark.

    Letters of other scripts, accents, repeated and spaced letters are undone here; stars and signs for
    letters when a vocabulary is known (``Reader``).
    """
    s = _SEP.sub(lambda m: re.sub(r"[ .\-_·*]", "", m[1]), _plain(_STRUCK.sub(" ", text)))
    # a quotation is one stretch of words, whatever sentences it holds
    s = _QUOTED.sub(lambda m: " " + " ".join("" + w for w in _WORD.findall(m[0])) + " ", s)
    for part in _SPLIT.split(s):
        words = []
        for w in _WORD.findall(part):
            mark, w = ('"', w[1:]) if w[0] == "" else ("", w)
            w = _squeeze(w.lower())
            words.append(mark + ("#" if w.isdigit() else w))
            if "-" in w and "*" not in w:
                words += [mark + x for x in w.split("-") if x]
        if words:
            yield words


class Reader:
    """Words with stars or signs for letters, as the words of a vocabulary (word to count) that they can be."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(vocabulary, key=lambda w: (-vocabulary[w], w)):
            self.by_length.setdefault(len(w), []).append(w)
        self.read = lru_cache(100_000)(self._read)

    def _read(self, word: str) -> str:
        if word[0] == '"':
            return '"' + self.read(word[1:]) if len(word) > 1 else word
        if "*" in word:
            pattern = re.compile("".join(r"\w{0,3}" if part[0] == "*" else re.escape(part.translate(_LEET)) for part in re.findall(r"\*+|[^*]+", word)))
            n = len(word)
            for length in (n, n - 1, n + 1, n - 2, n + 2):  # the nearest length first, then the commonest word
                for w in self.by_length.get(length, ()):
                    if pattern.fullmatch(w):
                        return w
            return word
        if word.isalpha() or not any(c.isdigit() or c in "@$€|" for c in word):
            return word
        tries = [_squeeze(word.translate(_LEET).replace("1", x)) for x in "il"]
        return next((t for t in tries if t in self.vocabulary), tries[0])


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


@lru_cache(200_000)
def grams(word: str) -> tuple[int, ...]:
    """Buckets of a word's character n-grams; short, quoted and odd words have none."""
    if not word.isalpha() or len(word) < 4:
        return ()
    p = f"<{word}>"
    return tuple(bucket("~" + p[i : i + n]) for n in GRAMS for i in range(len(p) - n + 1))


class OrdinalModel:
    """P(grade >= j) = logistic(w.x - t_j): one weight vector for all ordered thresholds."""

    def __init__(self, weights: dict[int, float] | None = None, cuts: np.ndarray | None = None):
        self.weights = weights or {}
        self.cuts = np.array([2.5, 3.5, 5.0]) if cuts is None else cuts

    def word(self, w: str) -> float:
        get = self.weights.get
        return get(bucket(w), 0.0) + GRAM_VALUE * sum(get(g, 0.0) for g in grams(w))

    def pair(self, a: str, b: str) -> float:
        return self.weights.get(bucket(a + " " + b), 0.0)

    def score(self, words: list[str]) -> float:
        return sum(map(self.word, words)) + sum(map(self.pair, words, words[1:]))

    def chances(self, eta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(eta)[..., None] - self.cuts, -40, 40)))

    def severity(self, eta: np.ndarray) -> np.ndarray:
        return self.chances(eta).sum(-1)


class Bags:
    """Sentences of the reviewed documents as sparse counts of words, pairs and character n-grams.

    A sentence's score is the sum of its words' scores and its pairs' weights, and a word's score is its
    weight and those of its n-grams, so n-grams are kept once per word.
    """

    def __init__(self, docs: list[list[list[str]]]):
        sentences = [s for d in docs for s in d]
        self.doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.n = len(sentences)
        lengths = np.array([len(s) for s in sentences], dtype=np.int64)
        words, at = np.unique(np.array([bucket(w) for s in sentences for w in s], dtype=np.int64), return_inverse=True)
        self.word_seg, self.word = np.repeat(np.arange(self.n), lengths), at
        pairs = np.array([bucket(a + " " + b) for s in sentences for a, b in zip(s, s[1:])], dtype=np.int64)
        pair_seg = np.repeat(np.arange(self.n), np.maximum(lengths - 1, 0))
        # a pair that one document alone has says nothing about others
        seen = np.unique(pairs * len(docs) + self.doc[pair_seg]) // max(1, len(docs))
        names, times = np.unique(seen, return_counts=True)
        common = names[times > 1]
        keep = np.isin(pairs, common)
        self.pair_seg, self.pair = pair_seg[keep], np.searchsorted(common, pairs[keep])
        text = {}
        for s in sentences:
            for w in s:
                text.setdefault(bucket(w), w)
        each = [grams(text[int(b)]) for b in words]
        gram_names, gram_at = np.unique(np.array([g for e in each for g in e], dtype=np.int64), return_inverse=True)
        self.gram_word, self.gram = np.repeat(np.arange(len(words)), [len(e) for e in each]), gram_at
        self.names = [words, common, gram_names]
        self.sizes = [len(x) for x in self.names]

    def scores(self, w: list[np.ndarray]) -> np.ndarray:
        own = w[0] + GRAM_VALUE * np.bincount(self.gram_word, weights=w[2][self.gram], minlength=self.sizes[0])
        return np.bincount(self.word_seg, weights=own[self.word], minlength=self.n) + np.bincount(self.pair_seg, weights=w[1][self.pair], minlength=self.n)

    def gradient(self, g: np.ndarray) -> list[np.ndarray]:
        """Sums of ``g``, a number per sentence, over the features."""
        word = np.bincount(self.word, weights=g[self.word_seg], minlength=self.sizes[0])
        return [word, np.bincount(self.pair, weights=g[self.pair_seg], minlength=self.sizes[1]), GRAM_VALUE * np.bincount(self.gram, weights=word[self.gram_word], minlength=self.sizes[2])]

    def part(self, keep: np.ndarray) -> Bags:
        """The same features over the sentences ``keep`` (ascending)."""
        out = object.__new__(Bags)
        place = np.full(self.n, -1)
        place[keep] = np.arange(len(keep))
        for seg, name in (("word_seg", "word"), ("pair_seg", "pair")):
            s = place[getattr(self, seg)]
            setattr(out, seg, s[s >= 0])
            setattr(out, name, getattr(self, name)[s >= 0])
        out.gram_word, out.gram, out.names, out.sizes, out.n, out.doc = self.gram_word, self.gram, self.names, self.sizes, len(keep), self.doc[keep]
        return out


def fit(bags: Bags, rows: np.ndarray, grades: np.ndarray, ridge: float = 2.0, steps: int = 80, rate: float = 0.1) -> tuple[list[np.ndarray], np.ndarray]:
    """Most likely weights (per kind of feature) and cuts of the sentences ``rows`` with ``grades``, weights held near 0 by ``ridge``."""
    keep, place = np.unique(rows, return_inverse=True)
    b = bags.part(keep)
    start = np.array([2.5, 3.5, 5.0])
    w, cuts = [np.zeros(n) for n in b.sizes], start.copy()
    params = [*w, cuts]
    m, s = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    above = (grades[:, None] >= np.arange(1, GRADES + 1)[None]).astype(float)
    for t in range(1, steps + 1):
        eta = b.scores(w)[place]
        miss = 1 / (1 + np.exp(-np.clip(eta[:, None] - cuts, -40, 40))) - above
        g = b.gradient(np.bincount(place, weights=miss.sum(1), minlength=len(keep)))
        grads = [*[x + ridge * y for x, y in zip(g, w)], -miss.sum(0) + 5 * (cuts - start)]
        for k, x in enumerate(params):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            s[k] = 0.99 * s[k] + 0.01 * grads[k] ** 2
            x -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8) / np.sqrt(1 + t / 20)
    return w, np.sort(cuts)


def grade(label_counts: dict[str, int], category: str) -> int | None:
    """0 to 3 by the share of reviewers who name the category among those who name it or none."""
    yes, no = label_counts.get(category, 0), label_counts.get("none", 0)
    if not yes + no:
        return None  # only other categories were named, which says nothing about this one
    share = yes / (yes + no)
    return 0 if yes == 0 else 1 if share < 0.5 else 2 if share < 1 or yes == 1 else 3


def fit_models(reviewed: list[tuple[str | None, dict[str, int]]], rounds: int = 4, others: int = 5) -> tuple[dict[str, OrdinalModel], dict[str, int]]:
    """A model per category from reviewed documents (text, counts of labels), and the vocabulary to read masked words by.

    At first a feature's weight is the log odds of documents with the category against those without.
    Then rounds: a document's grade goes to the sentence that scores highest, from documents of grade 0
    to the highest few, and the weights are fitted again. A document for which only other categories
    were named is no counterexample, but the sentences found for those are: reviewers name one
    category each, and now and then a wrong one. Without a reviewed case a category has no weights.
    """
    raw = [(list(segments(t or "")), c) for t, c in reviewed]
    raw = [(d, c) for d, c in raw if d]
    vocabulary = Counter(w for d, _ in raw for s in d for w in s if w.isalpha())
    read = Reader(vocabulary).read
    docs = [[[read(w) for w in s] for s in d] for d, _ in raw]
    grades = {c: np.array([-1 if (g := grade(v, c)) is None else g for _, v in raw], dtype=int) for c in CATEGORIES}
    known = [c for c in CATEGORIES if (grades[c] > 0).any()]
    models = {c: OrdinalModel() for c in CATEGORIES}
    if not known:
        return models, {}
    bags = Bags(docs)
    weights = {c: _odds(bags, grades[c]) for c in known}
    grades = {c: grades[c][bags.doc] for c in known}
    cuts: dict[str, np.ndarray] = {}
    first = np.r_[0, np.flatnonzero(np.diff(bags.doc)) + 1]
    start = np.repeat(first, np.diff(np.r_[first, bags.n]))
    for _ in range(rounds):
        place = {}  # of each sentence within its document, by falling score
        for c in known:
            by = np.lexsort((np.arange(bags.n), -bags.scores(weights[c]), bags.doc))
            place[c] = np.empty(bags.n, dtype=int)
            place[c][by] = np.arange(bags.n) - start
        for c in known:
            yes = (grades[c] > 0) & (place[c] == 0)
            no = (grades[c] == 0) & (place[c] < others)
            other = (grades[c] < 0) & np.any([(grades[o] > 0) & (place[o] == 0) for o in known if o != c] or [np.zeros(bags.n, dtype=bool)], axis=0)
            rows = np.flatnonzero(yes | no | other)
            weights[c], cuts[c] = fit(bags, rows, np.where(yes, grades[c], 0)[rows])
    for c in known:
        models[c] = OrdinalModel({int(n): float(x) for names, w in zip(bags.names, weights[c]) for n, x in zip(names, w) if abs(x) > 1e-3}, cuts[c])
    return models, dict(vocabulary)


def _odds(bags: Bags, grades: np.ndarray) -> list[np.ndarray]:
    """Log odds of each word and pair in documents of grade 2 or more against grade 0; 0 where not above 0."""
    yes, no = grades >= 2, grades == 0
    out = []
    for seg, name, n in ((bags.word_seg, bags.word, bags.sizes[0]), (bags.pair_seg, bags.pair, bags.sizes[1])):
        doc, feature = np.divmod(np.unique(bags.doc[seg] * n + name), max(1, n))
        with_, without = (np.bincount(feature, weights=x[doc].astype(float), minlength=n) for x in (yes, no))
        out.append(np.where(with_ > 0, np.maximum(0.0, np.log((with_ + 0.1) / (yes.sum() + 1)) - np.log((without + 0.1) / (no.sum() + 1))), 0.0))
    return [*out, np.zeros(bags.sizes[2])]


class Scorer:
    """Per category the highest score of any sentence of a text; scores of words and pairs are kept."""

    def __init__(self, models: dict[str, OrdinalModel], vocabulary: dict[str, int]):
        self.models = [models[c] for c in CATEGORIES]
        self.read = Reader(vocabulary).read
        self.word = lru_cache(300_000)(lambda w: np.array([m.word(w) for m in self.models]))
        self.pair = lru_cache(500_000)(lambda a, b: np.array([m.pair(a, b) for m in self.models]))

    def worst(self, text: str | None) -> np.ndarray:
        """A text without words has none, which is minus infinity."""
        out = np.full(len(CATEGORIES), -np.inf)
        for s in segments(text or ""):
            s = [self.read(w) for w in s]
            out = np.maximum(out, sum(map(self.word, s)) + sum(map(self.pair, s, s[1:]), np.zeros(len(CATEGORIES))))
        return out


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, abuse, hate, sexual, has_abuse, has_hate, has_sexual) for every document.

    The three numbers are expected severities from 0 to 3. The models are fitted on at most
    ``FIT_DOCUMENTS`` reviewed documents of at most ``FIT_CHARS`` characters; every document is scored
    over its whole text. Null and empty texts have severity 0; labels without document or of unknown
    category are ignored; a category that no reviewer named is found nowhere. Repeated doc_ids are
    scored row by row.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin("none", *CATEGORIES))
    votes = known.groupBy("doc_id", "label").agg(F.countDistinct(F.coalesce("reviewer", F.lit("?"))).cast("int").alias("n"))
    votes = votes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("votes"))
    drawn = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS)
    fitted_on = documents.where(F.length("text") <= FIT_CHARS).select("doc_id", "text").join(drawn, "doc_id")
    models, vocabulary = fit_models([(r.text, r.votes) for r in fitted_on.orderBy("doc_id", "text").collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(models, vocabulary)
        for pdf in batches:
            eta = np.array([scorer.worst(t) for t in pdf["text"]]).reshape(-1, len(CATEGORIES))
            out = pdf[["doc_id", "source"]].copy()
            for i, c in enumerate(CATEGORIES):
                there = ~np.isinf(eta[:, i]) & bool(models[c].weights)
                out[c] = np.where(there, models[c].severity(np.maximum(eta[:, i], -50)), 0.0)
                out["has_" + c] = there & (models[c].chances(eta[:, i])[:, 1] >= DECIDE)
            yield out

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, abuse double, hate double, sexual double, has_abuse boolean, has_hate boolean, has_sexual boolean")


def _scored(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "speech_labels"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    each = F.array(*[F.when(F.col("has_" + c), F.lit(c)) for c in CATEGORIES])
    return _scored(spark, sf_dir).select("doc_id", F.explode(F.array_compact(each)).alias("category")).distinct()


def p9_scores(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p9_rates(spark, sf_dir: str) -> DataFrame:
    """Per source: documents, and the share with each category and with any."""
    s = Scratch(spark, "scores").save(_scored(spark, sf_dir), "scores")
    any_ = F.col("has_abuse") | F.col("has_hate") | F.col("has_sexual")
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), *[F.avg(F.col("has_" + c).cast("double")).alias(f"{c}_rate") for c in CATEGORIES], F.avg(any_.cast("double")).alias("any_rate"), *[F.avg(c).alias(f"{c}_severity") for c in CATEGORIES])
