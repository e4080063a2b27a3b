"""Toxicity by a weighted lexicon matched with Aho-Corasick over folded text.

Folding lowers case, strips zero-width characters, maps homoglyphs to Latin letters and, inside words that hold a letter,
digits and signs to the letters they stand for. The lexicon is learnt from labelled rows: whole words (``idiot``) and word
beginnings (``vequ*``), each weighted by how much likelier a toxic document is to hold it. Phrases that hold a term and a
neighbouring word, and that only clean documents hold, are exceptions: a match inside one doesn't count. A document's
evidence is its matches' weights, normalised by the square root of its length in words (a single term says less in a long
text, but still something), through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, scratch, small_batches, table

# Characters that look like Latin letters, and digits and signs that stand for letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕһԁɡⅼոυνωαεικορτҽǝ", "aeopcyxijshdglnuvwaeikoptee")
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
_INVISIBLE = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD))

_FOLDED = _INVISIBLE | HOMOGLYPHS
_ODD = re.compile("[" + "".join(map(chr, _FOLDED)) + "]")
_WORD = re.compile(r"[^\W_]+")
_LEET = re.compile(r"(?<![^\W_])(?:[a-z]+[0-9@$!|]|[0-9@$!|]+[a-z])[a-z0-9@$!|]*(?<![!|])")
SAMPLE_ROWS = 20_000
SHORT = 32
#: Features that a worker holds before it passes their counts on; Spark adds them up.
HELD = 30_000
PREFIXES = range(3, 9)


def fold(text: str) -> str:
    """Lower case, with homoglyphs, digits and signs in words read as letters."""
    out = text.lower()
    if not out.isascii() and _ODD.search(out):
        out = out.translate(_FOLDED)
    return _LEET.sub(lambda m: m[0].translate(SUBSTITUTES), out)


def features(text: str) -> set[str]:
    """The distinct words of a folded text, and their beginnings marked by ``*``."""
    words = set(_WORD.findall(fold(text)))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the curve from length-normalised evidence to a probability."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    scale: float = 1.0
    base: float = -3.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            whole = not term.endswith("*")
            found.add_word(" " + (term + " " if whole else term[:-1]), (len(term) + 2 if whole else len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        if len(found):
            found.make_automaton()
        return found

    def evidence(self, text: str, machine: ahocorasick.Automaton) -> float:
        """The sum of all matches over the square root of the text's length, in units of SHORT words (those at least)."""
        words = _WORD.findall(fold(text))
        if not words or not len(machine):
            return 0.0
        line = f" {' '.join(words)} "
        hits = [(end - size + 1, end, weight) for end, (size, weight) in machine.iter(line)]
        if not hits:
            return 0.0
        spared = [(a, b) for a, b, w in hits if w == 0.0]
        counted: dict[int, float] = {}
        for a, b, w in hits:
            if w > 0.0 and not any(x <= a and b <= y for x, y in spared):
                counted[a] = max(counted.get(a, 0.0), w)  # the weightiest term that begins at a word
        if not counted:
            return 0.0
        return sum(counted.values()) * math.sqrt(SHORT / max(SHORT, len(words)))

    def score(self, text: str | None, machine: ahocorasick.Automaton) -> float:
        x = self.base + self.scale * self.evidence(text or "", machine)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _table(toxic: Counter, clean: Counter):
    keys = list(toxic.keys() | clean.keys())
    if keys:
        yield pd.DataFrame({"feature": keys, "t": np.array([toxic[k] for k in keys], dtype=np.int64), "c": np.array([clean[k] for k in keys], dtype=np.int64)})


def _counts(batches):
    """Of each partition: in how many toxic and clean documents a feature stands."""
    toxic, clean = Counter(), Counter()

    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["toxic"]):
            (toxic if label else clean).update(features(text))
            if len(toxic) + len(clean) > HELD:
                yield from _table(toxic, clean)
                toxic, clean = Counter(), Counter()
    yield from _table(toxic, clean)


def _neighbours(terms: frozenset[str]):
    """Of each partition: in how many toxic and clean documents a term stands with the word before or after it."""

    def count(batches):
        toxic, clean = Counter(), Counter()
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["toxic"]):
                words, found = _WORD.findall(fold(text)), set()
                for i, w in enumerate(words):
                    if w in terms or any(w[:k] + "*" in terms for k in PREFIXES if len(w) > k):
                        found.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
                (toxic if label else clean).update(found)
        yield from _table(toxic, clean)

    return count


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, least_docs: int = 5) -> Lexicon:
    """Learn a lexicon from labelled rows: `docs` with doc_id and text, `labels` with doc_id and toxic (0 or 1).

    At most about `sample_rows` rows, chosen by a hash of doc_id, are used: the documented bound of the sample, which
    also bounds what is broadcast, counted and learnt: features are counted in the cluster, and every term and exception
    that the sample bears out comes to the driver. Null labels or ids are ignored; null texts count as empty; of several
    labels of one id one counts. Without labels of both kinds the lexicon is empty and scores are the base rate.
    """
    with scratch(docs.sparkSession), small_batches(docs.sparkSession):
        return _learnt(docs, labels, sample_rows, least_docs)


def _least_hashes(sample_rows: int, total: int) -> int:
    """Up to which of 2 ** 63 hashes a row is in the sample, however small its share is."""
    return min(2**63 - 1, sample_rows * 2**63 // max(total, 1))


def _learnt(docs: DataFrame, labels: DataFrame, sample_rows: int, least_docs: int) -> Lexicon:
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    total = marked.count()
    picked = marked.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= _least_hashes(sample_rows, total)).dropDuplicates(["doc_id"]).limit(2 * sample_rows)
    rows = materialize(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic"), "labelled")
    sizes = {bool(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_t, n_c = sizes.get(True, 0), sizes.get(False, 0)
    if not n_t or not n_c:
        discard(rows)
        return Lexicon({}, base=-3.0)

    ratio = F.log((F.col("t") + 0.5) / (n_t + 1.0)) - F.log((F.col("c") + 0.5) / (n_c + 1.0))
    counted = rows.mapInPandas(_counts, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    strong = counted.where((F.col("t") >= least_docs) & (F.col("c") <= 0.02 * F.col("t")) & (ratio > math.log(20))).withColumn("w", ratio)
    strong = materialize(strong, "strong")
    # a term says nothing new where a shorter beginning of it is strong
    stem = F.regexp_replace("feature", r"\*+$", "")
    starts = F.array(*[F.when(F.length(stem) > k, F.concat(F.substring(stem, 1, k), F.lit("*"))) for k in PREFIXES])
    longer = strong.select("feature", F.explode(starts).alias("start")).join(strong.select(F.col("feature").alias("start")), "start", "left_semi")
    terms = strong.join(longer.select("feature").distinct(), "feature", "left_anti")
    keep = {r["feature"]: r["w"] for r in terms.collect()}
    discard(strong)
    lexicon = Lexicon(keep)
    if keep:
        near = rows.mapInPandas(_neighbours(frozenset(keep)), "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        spared = near.where((F.col("c") >= 3) & (F.col("t") == 0))
        lexicon.exceptions = frozenset(r["feature"] for r in spared.collect())

    # the curve: evidence in steps of a tenth, a few rows to the driver whatever the sample
    def steps(batches):
        machine = lexicon.automaton()
        for pdf in batches:
            yield pd.DataFrame({"x": [round(lexicon.evidence(t, machine) * 10) for t in pdf["text"]], "y": pdf["toxic"]})

    seen = rows.mapInPandas(steps, "x long, y long").groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    x, n, y = (np.array([r[k] for r in seen], dtype=float) for k in ("x", "n", "y"))
    lexicon.scale, lexicon.base = _logistic(x / 10, n, y)
    discard(rows)
    return lexicon


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a lightly penalised logistic fit to counts, by Newton's method."""
    beta = np.zeros(2)
    design = np.column_stack((x, np.ones_like(x)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - n * p) - 0.01 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, gradient)
    return float(max(beta[0], 0.0)), float(beta[1])


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "toxicity") -> DataFrame:
    """Add a column `name`, a probability, to every row: one map over whole texts, however long.

    Null and empty texts score as texts without a match. Repeated rows are scored each; an empty table stays empty;
    other columns pass through, and one called `name` is replaced.
    """
    made: list = []

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(lexicon.automaton())
        return pd.Series([lexicon.score(t, made[0]) for t in texts], dtype="float64")

    return docs.withColumn(name, rate(F.col(text)))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def crc_fold(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def query(spark, sf_dir: str) -> DataFrame:
    """`op7_toxicity`: a score for every document, learnt from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    lexicon = train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"))
    with small_batches(spark):
        return materialize(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "scores")
