"""Toxicity: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

The labelled rows drawn for learning fall into three parts by hash: one finds the lexicon (words and word beginnings far more frequent in toxic
texts), one grows the trees, one fits the calibration. Features are rates, so texts of any length compare: lexicon densities, second-person
words near lexicon words, capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import held, send_code, staged
from cohortloom.llm.tokens import slices, texts_of

THRESHOLD = 0.7
# Labelled rows that are learned from at most (about: drawn by hash), and terms of the learned lexicon at most.
SAMPLE, MOST_TERMS = 24_000, 20_000
# A term is learned if this many toxic texts hold it and its odds are this many times those of other texts.
LEAST_TEXTS, LEAST_ODDS = 4, 7.0
TREES, DEPTH = 20, 4
# Tasks that hold the learning rows, whose number `sample` bounds, while trees grow.
FIT_TASKS = 8
# Part of the score that the uncalibrated margin has.
TIE = 1e-3
# Beginnings of words that are terms of their own: their lengths (words must be two characters longer).
BEGINNINGS = (4, 5, 6)
# Words between a second-person word and a lexicon word that still count as near.
NEAR = 5

# Common insults, and second-person words of the languages at hand.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers trash garbage scum clown pathetic worthless disgusting dumb fool ugly filthy "
    "idiota idiotas estúpido estúpida imbécil basura asqueroso asquerosa inútil dumm dummkopf blöd trottel abschaum ekelhaft wertlos "
    "imbécile stupide crétin débile ordure dégoûtant pathétique nul".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W_]+")
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[0-9@$!|*]+[^\W\d_]+)+")
_UPPER, _LETTER, _DIGIT, _MARK, _SPACE, _BANG, _ASK = range(1, 8)
NAMES = (
    "insults", "insult_count", "words", "word_count", "beginnings", "beginning_count", "near_you", "you", "capitals", "shouted",
    "punctuation", "bangs", "asks", "digits", "disguised", "unmasked", "stretched", "length",
)


def _classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            table[c] = _UPPER if x.isupper() else _LETTER
        elif x.isnumeric():
            table[c] = _DIGIT
        elif x.isspace():
            table[c] = _SPACE
        elif x.isprintable():
            table[c] = _MARK
    table[ord("!")], table[ord("?")] = _BANG, _ASK
    return table




def terms(text: str) -> dict[str, Counter]:
    """Words of a text, and beginnings of its longer words, with their counts."""
    words = Counter(_WORD.findall(text.lower()))
    starts: Counter = Counter()
    for word, n in words.items():
        for size in BEGINNINGS:
            if len(word) >= size + 2:
                starts[word[:size]] += n
    return {"word": words, "beginning": starts}


def _rates(text: str) -> list[float]:
    """Rates of the characters of a text: capitals, shouted words, punctuation, bangs, asks, digits, stretched letters."""
    tables = held("toxicity")
    if "classes" not in tables:
        tables["classes"] = _classes()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = tables["classes"][points]
    counts = np.bincount(kinds, minlength=8)
    letters, size = max(counts[_UPPER] + counts[_LETTER], 1), max(len(points), 1)
    same = points[1:] == points[:-1]
    stretched = int((same[1:] & same[:-1] & (kinds[2:] != _SPACE)).sum())
    upper = kinds == _UPPER
    pairs = int((upper[1:] & upper[:-1]).sum())
    marks = counts[_MARK] + counts[_BANG] + counts[_ASK]
    return [counts[_UPPER] / letters, pairs / letters, marks / size, counts[_BANG] / size, counts[_ASK] / size, counts[_DIGIT] / size, stretched / size]


def features(text: str, lexicon: dict[str, dict[str, float]]) -> list[float]:
    """The values of NAMES for one text; a text without words has zeros for all rates of words."""
    found = terms(text)
    words, n = found["word"], max(sum(found["word"].values()), 1)
    insults = sum(c for w, c in words.items() if w in INSULTS)
    learned = {w: c for w, c in words.items() if w in lexicon["word"]}
    starts = {w: c for w, c in found["beginning"].items() if w in lexicon["beginning"]}
    weight = sum(lexicon["word"][w] * c for w, c in learned.items())
    start_weight = sum(lexicon["beginning"][w] * c for w, c in starts.items())
    you = sum(c for w, c in words.items() if w in SECOND_PERSON)
    near = 0
    if you and (insults or learned):
        order = _WORD.findall(text.lower())
        at = np.array([i for i, w in enumerate(order) if w in SECOND_PERSON])
        hits = np.array([i for i, w in enumerate(order) if w in INSULTS or w in learned])
        spot = np.searchsorted(at, hits)
        before = hits - at[np.maximum(spot - 1, 0)]
        after = at[np.minimum(spot, len(at) - 1)] - hits
        near = int(((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)).sum())
    masked = _DISGUISED.findall(text)
    unmasked = sum((w := m.lower().translate(DISGUISE)) in INSULTS or w in lexicon["word"] for m in masked)
    capitals, shouted, marks, bangs, asks, digits, stretched = _rates(text)
    return [
        insults / n, math.log1p(insults), weight / n, math.log1p(sum(learned.values())), start_weight / n, math.log1p(sum(starts.values())),
        near / n, you / n, capitals, shouted, marks, bangs, asks, digits, len(masked) / n, unmasked / n, stretched, math.log1p(n),
    ]


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document may not be learned from: crc32 of its id as text leaves 1 when divided by 3. False for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def _learning_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic, part (0 lexicon, 1 trees, 2 calibration) of the labelled rows drawn; texts are not shuffled."""
    labels = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = staged(labels.where("l_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("toxic").alias("toxic")))
    n = labels.count()
    cut = min(1.0, sample / max(n, 1))
    draw = F.pmod(F.xxhash64("l_id", F.lit("draw")), F.lit(1 << 30)) < F.lit(int(cut * (1 << 30)) + (cut == 1.0))
    part = F.pmod(F.xxhash64("l_id", F.lit("part")), F.lit(5))
    labels = labels.where(draw).withColumn("part", F.when(part < 2, 0).when(part < 4, 1).otherwise(2))
    text = docs.select(F.col("doc_id").cast("long").alias("l_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(labels), "l_id").select("text", "toxic", "part")  # at most about `sample` labels


def _lexicon(rows: DataFrame) -> dict[str, dict[str, float]]:
    """Log odds of the learned terms by kind."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                for kind, counts in terms(text).items():
                    if counts:
                        yield pa.RecordBatch.from_pydict({"kind": [kind] * len(counts), "term": list(counts), "toxic": pa.array([toxic] * len(counts), pa.int32())})

    share = rows.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = share["bad"] or 0, share["n"] - (share["bad"] or 0)
    counted = rows.select("text", "toxic").mapInArrow(found, "kind string, term string, toxic int")
    counted = counted.groupBy("kind", "term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = ((F.col("bad") + 0.5) / F.lit(bad + 1.0)) / ((F.col("good") + 0.5) / F.lit(good + 1.0))
    kept = counted.where(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    lexicon: dict[str, dict[str, float]] = {"word": {}, "beginning": {}}
    for row in kept.orderBy(F.desc("odds"), "term").limit(MOST_TERMS).collect():
        lexicon[row["kind"]][row["term"]] = math.log(row["odds"])
    return lexicon


def _features(text: Column, lexicon: dict[str, dict[str, float]]) -> Column:
    @F.pandas_udf("array<double>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "", lexicon) for t in texts])

    return compute(text)


class Scorer:
    """Learned lexicon, trees and calibration, learned from labelled rows that are not held out."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5):
        send_code(docs.sparkSession)
        rows = staged(_learning_rows(docs, labels, sample))
        self.lexicon = _lexicon(rows.where("part = 0"))
        learned = staged(rows.select("toxic", "part", _features(F.col("text"), self.lexicon).alias("f_values")))
        learned = learned.coalesce(FIT_TASKS).select("part", F.col("toxic").cast("double").alias("f_label"), array_to_vector("f_values").alias("f_vector"))
        sums = {r["part"]: (r["n"], r["bad"]) for r in learned.groupBy("part").agg(F.count("*").alias("n"), F.sum("f_label").alias("bad")).collect()}
        n, bad = sums.get(1, (0, 0.0))
        self.trees = self.curve = None
        self.share = bad / n if n else 0.0
        if 0 < bad < n:
            trees = GBTClassifier(
                featuresCol="f_vector", labelCol="f_label", predictionCol="f_class",
                maxIter=TREES, maxDepth=DEPTH, seed=seed, checkpointInterval=-1,
            )
            self.trees = trees.fit(learned.where("part = 1"))
            n, bad = sums.get(2, (0, 0.0))
            if 0 < bad < n:
                # One made-up row of the other label at either end: k toxic rows at the top count as k / (k + 1), so few rows claim little.
                ends = docs.sparkSession.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "f_margin double, f_label double")
                curve = IsotonicRegression(featuresCol="f_margin", labelCol="f_label", predictionCol="f_score")
                self.curve = curve.fit(self._margins(learned.where("part = 2")).select("f_margin", "f_label").unionByName(ends))

    def _margins(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("f_margin", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "f_class")

    def scored(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with f_score (0 to 1); no other column is left behind. Without both labels among the learning rows the score is their share of toxic ones."""
        if self.trees is None:
            return rows.withColumn("f_score", F.lit(self.share))
        rows = rows.withColumn("f_values", _features(F.col(text), self.lexicon)).withColumn("f_vector", array_to_vector("f_values")).drop("f_values")
        rows = self._margins(rows).drop("f_vector")
        if self.curve is None:  # no calibration without both labels: half-way to the share of toxic rows
            return rows.withColumn("f_score", (F.col("f_margin") + self.share) / 2).drop("f_margin")
        rows = self.curve.transform(rows)
        # Margins break the ties of the curve's steps.
        return rows.withColumn("f_score", F.col("f_score") * (1 - TIE) + F.col("f_margin") * TIE).drop("f_margin")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document's whole text (null: empty), repeated rows and null ids included.

    Labels: doc_id, toxic; null ids and labels are left out, of several labels of a document the highest holds. Only labels of documents that
    are not held out are learned from, at most about `sample` of them. Only the text enters a score. Empty tables are allowed.
    """
    scorer = Scorer(docs, labels, sample)
    rows = scorer.scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("f_score").alias("score"), (F.col("f_score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    own = {c: f"d_{i}" for i, c in enumerate(docs.columns)}
    rows = Scorer(docs, labels, sample).scored(docs.toDF(*own.values()), own["text"])
    return rows.where(F.col("f_score") < threshold).select(*(F.col(new).alias(old) for old, new in own.items()))
