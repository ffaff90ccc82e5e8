"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words, and the
document's score is the noisy-or of its sentences: 1 minus the product of what each leaves. The
weights are trained from document labels alone, and the trained sentence scores then locate the
sentences at fault.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import discard, free_name, materialize, trim

#: Most labelled documents that training reads, those with the smallest hashed ids, each whole.
SAMPLE_DOCS = 8_192
#: Words kept as features, and the fewest training documents that hold one.
FEATURES, MIN_DOCS = 4096, 4
STEPS, RATE, DECAY, SEED = 300, 0.1, 1e-3, 7
#: Rows scored before they are handed on.
SLICE = 256

_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Word weights of the sentence scorer; a sentence without known words has the logit ``bias``."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0

    def logits(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans and logits of the sentences of a text."""
        spans = [m.span() for m in _SENTENCE.finditer(text)]
        get = self.weights.get
        return spans, np.array([self.bias + sum(get(w, 0.0) for w in set(_TOKEN.findall(text[a:b].lower()))) for a, b in spans])

    def score(self, text: str | None) -> float:
        """Noisy-or over the sentences; an empty text has no sentence and so the score 0.

        Sentences without known words enter by their number alone."""
        if not text:
            return 0.0
        known, get = self.weights, self.weights.get
        low = text.lower()
        if known and not any(w in known for w in set(_TOKEN.findall(low))):
            return float(-np.expm1(-len(_SENTENCE.findall(low)) * np.logaddexp(0.0, self.bias)))
        plain, total = 0, 0.0
        for sentence in _SENTENCE.findall(low):
            hits = [get(w, 0.0) for w in set(_TOKEN.findall(sentence)) if w in known]
            if hits:
                total += np.logaddexp(0.0, self.bias + sum(hits))
            else:
                plain += 1
        return float(-np.expm1(-(total + plain * np.logaddexp(0.0, self.bias))))


def fit(bags: list[tuple[int, list[list[int]]]], labels: list[int], starts: dict[str, float]) -> Model:
    """Train on a bag for each document: (sentences without known words, feature numbers of every other
    sentence). ``starts`` gives the words of the features in their order with their first weights. The
    noisy-or likelihood is climbed by full-batch Adam with weight decay. Without both labels the model
    scores everything 0 (or, where all are toxic, near 1)."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(bias=-40.0 if not len(y) or y.max() == 0 else 0.0)
    plain = np.array([p for p, _ in bags], float)
    docs = np.repeat(np.arange(len(bags)), [len(s) for _, s in bags])
    sizes = [len(x) for _, s in bags for x in s]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    words = np.array([w for _, s in bags for x in s for w in x], int)
    w, bias = np.array(list(starts.values())), -8.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows, w[words], len(docs))
        left = np.bincount(docs, np.logaddexp(0.0, z), len(y)) + plain * np.logaddexp(0.0, bias)  # -log of what no sentence claims
        # d(-log likelihood)/d(left): 1 for label 0, -1/(e^left - 1) for label 1; a label may be wrong, so it is bounded
        slope = np.where(y > 0, -1.0 / np.maximum(np.expm1(np.minimum(left, 50)), 0.02), 1.0) / len(y)
        dz = slope[docs] / (1 + np.exp(-z))
        grad = np.append(np.bincount(words, dz[rows], len(w)) + DECAY * w / len(y) * 10, dz.sum() + (slope * plain).sum() / (1 + np.exp(-bias)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({word: float(x) for word, x in zip(starts, w, strict=True) if abs(x) > 1e-3}, float(bias))


def bag_of(text: str, index: dict[str, int]) -> tuple[int, list[list[int]]]:
    """Sentences without known words, and the feature numbers of every other sentence."""
    plain, hits = 0, []
    for sentence in _SENTENCE.findall(text.lower()):
        found = sorted(index[w] for w in set(_TOKEN.findall(sentence)) if w in index)
        if found:
            hits.append(found)
        else:
            plain += 1
    return plain, hits


def chosen_words(sample: DataFrame, features: int = FEATURES, min_docs: int = MIN_DOCS) -> dict[str, float]:
    """Words of (text, toxic) rows whose share among toxic documents lies furthest from their share among
    the others, three standard errors at least, with their first weights: smoothed log odds, doubled
    and not below 0. Words are counted where the rows are; ``features`` of them reach the driver."""
    n, toxic = sample.agg(F.count(F.lit(1)), F.sum((F.col("toxic") > 0).cast("long"))).first()
    if not n or not toxic or toxic == n:
        return {}
    rate = toxic / n

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            present, bad = Counter(), Counter()
            for t, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                words = set(_TOKEN.findall(t.as_py().lower()))
                present.update(words)
                if y > 0:
                    bad.update(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(present), pa.string()), pa.array(list(present.values()), pa.int64()), pa.array([bad[w] for w in present], pa.int64())], ["word", "n", "t"])

    counts = sample.select("text", "toxic").mapInArrow(counted, "word string, n long, t long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    z = F.abs(F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    top = counts.filter(F.col("n") >= min_docs).withColumn("z", z).filter("z >= 3").orderBy(F.desc("z"), "word").limit(features).collect()
    return {r.word: max(0.0, float(np.log((r.t + rate) / (r.n - r.t + 1 - rate)))) * 2 for r in top}


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0


def train(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled documents outside the held-out fold, at most ``sample_docs`` of them, those with
    the smallest hashed ids; their texts are read whole, on the executors. A document with several label
    rows counts as toxic if any says so, one with several texts gives the text of the least digest; rows
    without a label or an id, and null texts, say nothing."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the ids are chosen before any text is read
    chosen = marks.orderBy(F.xxhash64(F.col("doc_id"), F.lit(SEED)), "doc_id").limit(sample_docs)
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = materialize(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.sha2("text", 256)).alias("text")), "toxicity-sample")
    starts = chosen_words(sample)
    index = {w: i for i, w in enumerate(starts)}

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [bag_of(t.as_py(), index) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([int(y > 0) for y in b.column("toxic").to_pylist()], pa.int32()), pa.array([p for p, _ in bags], pa.int64()), pa.array([x for _, x in bags], pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "plain", "hits"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(bagged, f"doc_id {kind}, toxic int, plain long, hits array<array<int>>").collect() if starts else sample.select("doc_id", "toxic").collect()
    found.sort(key=lambda r: r.doc_id)  # at most sample_docs rows of feature numbers
    bags = [(r.plain, r.hits) for r in found] if starts else [(1, [])] * len(found)
    discard(sample)
    return fit(bags, [int(r.toxic > 0) for r in found], starts)


def score_documents(documents: DataFrame, model: Model, keep: list[str] | None = None, sentences: bool = False, score: str = "score") -> DataFrame:
    """``keep`` (default: every column but those this adds) plus ``score`` (a double, under that name) of
    the whole text; with ``sentences`` also ``spans``, the (start, end, score) of each sentence whose own
    score is 0.5 or more, offsets in code points. A null or empty text scores 0.

    Columns travel under numbers, so that no name can clash, and each text travels once; rows are
    handed on a few at a time."""
    keep = keep if keep is not None else [c for c in documents.columns if c not in (score, "spans")]
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most FEATURES words
    send = keep if "text" in keep else [*keep, "text"]
    at, names = send.index("text"), [f"c{i}" for i in range(len(send))]
    numbered = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(send, names, strict=True)))
    schema = StructType(list(numbered.select(*names[: len(keep)]).schema.fields)).add("_score", "double")
    if sentences:
        span = StructType().add("start", "integer").add("end", "integer").add("score", "double")
        schema = schema.add("_spans", ArrayType(span))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def located(scorer: Model, text: str) -> list[dict]:
        spans, z = scorer.logits(text)
        return [{"start": a, "end": b, "score": float(1 / (1 + np.exp(-x)))} for (a, b), x in zip(spans, z, strict=True) if x >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                b = whole.slice(first, SLICE)
                scores = [scorer.score(x.as_py()) for x in b.column(at)]
                more = [pa.array(scores, pa.float64())]
                if sentences:
                    # one sentence at 0.5 lifts its document to 0.5
                    more.append(pa.array([located(scorer, x.as_py()) if y >= 0.5 else [] for x, y in zip(b.column(at), scores, strict=True)], kind))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *more], [*names[: len(keep)], "_score", *["_spans"] * sentences])
            del whole, b
        trim()

    out = numbered.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=False)), F.col("_score").alias(score), *[F.col("_spans").alias("spans")] * sentences)


def non_toxic(documents: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score less than ``below``, with their own columns, whatever they
    are called; null and empty texts stay."""
    score = free_name("score", documents.columns)
    scored = score_documents(documents, model, documents.columns, score=score)
    return scored.filter(F.col(score) < below).drop(score)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (the sentences at fault). Null and empty texts score 0,
    repeated rows each keep a row, a null id is held out; an untrainable table of labels scores 0
    throughout, an empty table gives no row. Other columns are not read."""
    scored = score_documents(documents.select("doc_id", "text"), train(documents, labels), ["doc_id"], sentences=True)
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
