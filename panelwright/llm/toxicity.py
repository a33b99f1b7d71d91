"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of a bias, of its words' weights and of
the number of sentences, and a document's score is the noisy-or of all its sentences' (it is toxic if any of them
is), in training and scoring alike. The bias falls with the logarithm of that number: with no evidence a document of
a thousand sentences is as likely toxic as one of ten. Weights are learned from document labels alone, through the
noisy-or; the sentences that score highest are then the offending ones. A word's weight is that of the word and of
its beginnings, so that related forms share evidence.

Only rows that `split` assigns to training are learned from, at most `per_label` of each label, in hash
order, of at most `longest` characters: these bounds keep the driver's memory fixed. Every row is scored.

Defined results: a null text is the empty text; a text without words has no sentence and scores 0. Repeated rows get
equal scores; labels that disagree about a document count as toxic. A null label is none. Only key and text
are read; labels, language and source never enter a score. With no labelled rows every score is 0.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import map_arrow, texts_of

#: Beginnings of words that have weights of their own.
PREFIXES = (4, 5, 6, 7)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: A document is called toxic from this score on.
THRESHOLD = 0.7
WORDS_KEPT = 100_000


@dataclass(frozen=True)
class Training:
    per_label: int = 2000
    longest: int = 20_000
    least_documents: int = 4
    rounds: int = 200
    rate: float = 0.4
    sparsity: float = 2e-4
    bias: float = -4.0


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *[word[:n] + "*" for n in PREFIXES if n <= len(word)]]


def _bags(text: str) -> Iterator[list[str]]:
    return filter(None, (_WORD.findall(m[0]) for m in _SENTENCE.finditer(text.lower())))


def fit(texts: list[str], labels: list[int], training: Training = Training()) -> tuple[float, dict[str, float]]:
    """(bias, weights) that maximise the likelihood of the labels under the noisy-or, by proximal Adagrad."""
    seen: Counter = Counter()
    vocabulary: dict[str, int] = {}
    sentence, word, doc = array("i"), array("i"), array("i")  # words are numbered as they are read; no text's words are kept
    for d, text in enumerate(texts):
        met: dict[str, None] = {}
        for words in _bags(text):
            for w in dict.fromkeys(words):
                sentence.append(len(doc))
                word.append(vocabulary.setdefault(w, len(vocabulary)))
                met[w] = None
            doc.append(d)
        seen.update({f for w in met for f in features(w)})
    names = sorted(f for f, n in seen.items() if n >= training.least_documents)
    number = {f: i for i, f in enumerate(names)}
    if not names or not doc or len(set(labels)) < 2:
        return training.bias, {}
    pairs = [(i, number[f]) for w, i in vocabulary.items() for f in features(w) if f in number]
    of_word, of_feature = (np.array(x) for x in zip(*pairs))
    sentence, word, doc, y = np.array(sentence), np.array(word), np.array(doc), np.array(labels, float)
    prior = -np.log(np.bincount(doc, minlength=len(y))[doc])
    weights, bias = np.zeros(len(names)), training.bias
    squares, bias_square = np.full(len(names), 1e-8), 1e-8
    for _ in range(training.rounds):
        of_words = np.bincount(of_word, weights[of_feature], len(vocabulary))
        z = np.clip(bias + prior + np.bincount(sentence, of_words[word], len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of the chance that no sentence is toxic
        any_ = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(y == 1, -np.exp(none) / any_, 1.0)
        slope = pull[doc] * p / len(y)
        by_word = np.bincount(word, slope[sentence], len(vocabulary))
        gradient = np.bincount(of_feature, by_word[of_word], len(names))
        squares += gradient**2
        step = training.rate / np.sqrt(squares)
        weights -= step * gradient
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * training.sparsity, 0)
        total = slope.sum()
        bias_square += total**2
        bias = min(-2.0, bias - 0.1 * training.rate * total / np.sqrt(bias_square))
    return float(bias), {names[i]: float(weights[i]) for i in np.flatnonzero(np.abs(weights) > 1e-6)}


class Model:
    """Scores of sentences and documents from a bias and weights."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self.words: dict[str, float] = {}

    def _weigh(self, words: set[str]) -> dict[str, float]:
        own = self.words
        if len(own) > WORDS_KEPT:
            own.clear()
        for w in words.difference(own):
            own[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return own

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of all the document's sentences and (start, end, score) of each."""
        lower = text.lower()
        if not self.weights:
            return 0.0, []
        if len(lower) != len(text):
            lower = text
        bags = [(m.start(), m.end(), set(_WORD.findall(m[0].lower()))) for m in _SENTENCE.finditer(lower)]
        own = self._weigh({w for _, _, words in bags for w in words})
        spans = [(a, b, math.fsum(map(own.__getitem__, words))) for a, b, words in bags if words]
        if not spans:
            return 0.0, []
        bias = self.bias - math.log(len(spans))
        found = [(a, b, 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + known))))) for a, b, known in spans]
        return -math.expm1(math.fsum(math.log1p(-p) for _, _, p in found)), found


def remainder(key: Column) -> Column:
    """crc32 of the key as text, mod 3."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", training: Training = Training()) -> tuple[float, dict[str, float]]:
    """Weights from a bounded sample of the labelled rows whose remainder isn't 1."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(F.col(key)) != 1)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    texts = docs.filter((remainder(F.col(key)) != 1) & (F.length(text) <= training.longest)).select(key, F.xxhash64(text).alias("h"))
    ids = texts.groupBy(key).agg(F.min("h").alias("h")).join(known, key)
    picked = None
    for value in (0, 1):
        part = ids.filter(F.col("y") == value).orderBy(F.xxhash64(key), key).limit(training.per_label)
        picked = part if picked is None else picked.unionByName(part)
    rows = picked.select(key, "y", "h").collect()  # at most 2 * per_label small rows
    spark = docs.sparkSession
    if not rows:
        return training.bias, {}
    bounded = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], f"`{key}` {docs.schema[key].dataType.simpleString()}, y int, h bigint")
    chosen = docs.select(key, text).withColumn("h", F.xxhash64(text)).join(F.broadcast(bounded), [key, "h"]).groupBy(key, "h").agg(F.first(text).alias("t"), F.first("y").alias("y"))
    sample = sorted((tuple(r) for r in chosen.select(key, "t", "y").collect()), key=lambda r: repr(r[0]))
    return fit([t or "" for _, t, _ in sample], [y for _, _, y in sample], training)


def scores(docs: DataFrame, model: tuple[float, dict[str, float]], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted, offending): offending has the sentences that score at least a half, by place in the text."""
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *model))

    def rows(batch):
        own = worker_model(sent)
        found = [own.score(t) for t in texts_of(batch, text)]
        keys = ["" if k is None else str(k) for k in batch.column(key).to_pylist()]
        spans = [[{"start": a, "end": b, "score": p} for a, b, p in s if p >= 0.5] for _, s in found]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        columns = [
            pa.array([zlib.crc32(k.encode()) % 3 == 1 for k in keys]),
            pa.array([p for p, _ in found], pa.float64()),
            pa.array([int(p >= threshold) for p, _ in found], pa.int32()),
            pa.array(spans, kind),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "held_out", "score", "predicted", "offending"])

    docs = docs.select(key, text)
    return map_arrow(docs, rows, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int, offending array<struct<start:bigint,end:bigint,score:double>>")


_MODELS: dict[str, Model] = {}


def worker_model(sent) -> Model:
    """The model of a broadcast; a worker builds it once."""
    name, bias, weights = sent.value
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(bias, weights)
    return _MODELS[name]


def clean_documents(docs: DataFrame, model: tuple[float, dict[str, float]], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *model))

    def rows(batch):
        own = worker_model(sent)
        keep = pa.array([own.score(t)[0] < threshold for t in texts_of(batch, text)])
        yield batch.filter(keep)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, rows, fields)
