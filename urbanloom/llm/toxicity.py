"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words; a document's score is
their noisy-or, 1 - prod(1 - p). Only documents have labels: the loss is taken on the noisy-or, and its gradient
spreads a toxic label over the sentences that explain it, so sentences can be located without sentence labels.

The model is fitted on a bounded sample of labelled rows (``max_train_docs`` and MAX_TRAIN_BYTES, in hash order of the
id); every document of the table is scored, whole. Words are hashed into ``BUCKETS`` weights, so the model that executors
get has a fixed size. Neither labels nor languages, sources or ids are inputs of a score.

Edge cases: a null or empty text is one sentence without words; its score is the bias alone. Rows of labels
with a null id or label are not learnt from; with no labels at all every score is ``PRIOR``'s. Repeated rows
score alike. Of several worst sentences the first is given. Very long texts are read whole, sentence by sentence.
An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import crc_bucket, text_or_empty

BUCKETS = 1 << 18
PRIOR = 0.02
#: Labelled documents, and bytes of their texts, that the model is fitted on at most; not a limit on what is scored.
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 12_000, 64 << 20
SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?\n]+|\Z)")
EDGES = b" \t\n\r\x0b\x0c\"'()[]{}<>,;:.!?*#$%&|-_"


def word_bucket(word: bytes) -> int:
    return zlib.crc32(word) & (BUCKETS - 1)


def sentences(text: bytes) -> Iterator[tuple[int, int]]:
    """Byte spans of the sentences that hold more than white space; a text without any is one empty sentence."""
    some = False
    for found in SENTENCE.finditer(text):
        if found.end() > found.start() and not text[found.start() : found.end()].isspace():
            some = True
            yield found.span()
    if not some:
        yield 0, 0


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its first 4 and 5 bytes, by which inflected and compound forms share evidence."""
    bare = word.strip(EDGES)
    if not bare:
        return ()
    stems = [b"^" + bare[:n] for n in (4, 5) if len(bare) > n]
    return tuple(word_bucket(w) for w in (bare, *stems))


def sentence_buckets(sentence: bytes) -> set[int]:
    return {bucket for word in set(sentence.lower().split()) for bucket in word_features(word)}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled document: its sentences' word buckets, end to end, and their lengths."""
    for batch in batches:
        words, sizes = [], []
        for text in batch.column(1):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            rows = [sorted(sentence_buckets(raw[a:b])) for a, b in sentences(raw)]
            words.append(np.array([w for row in rows for w in row], np.int32).tobytes())
            sizes.append(np.array([len(row) for row in rows], np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], names=["label", "words", "sizes"])


def training_bags(docs: DataFrame, labels: DataFrame, label_col: str, max_train_docs: int, holdout: int, max_train_bytes: int = MAX_TRAIN_BYTES) -> list:
    """Labelled texts in hash order of their ids, up to both bounds; all rows of an id count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = known.where(crc_bucket(F.col("doc_id"), holdout) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    first = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_train_docs).collect()
    spark, kind = docs.sparkSession, "doc_id long, label int"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    sizes = base.join(F.broadcast(spark.createDataFrame(first, kind)), "doc_id").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    size, picked, total = {r.doc_id: r.n for r in sizes}, [], 0
    for row in first:  # max_train_docs rows at most
        total += size.get(row.doc_id, 0)
        if total > max_train_bytes:
            break
        picked.append(row)
    texts = base.join(F.broadcast(spark.createDataFrame(picked, kind)), "doc_id").select("label", "text")
    return texts.mapInArrow(_features, "label int, words binary, sizes binary").collect()


def fit(bags: list, *, rounds: int = 100, rate: float = 0.3, ridge: float = 2e-4, min_docs: int = 5, positive_weight: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias, by Adam on the whole sample. Buckets in few documents keep weight 0."""
    weights, bias = np.zeros(BUCKETS, np.float32), float(np.log(PRIOR / (1 - PRIOR)))
    if not bags:
        return weights, bias
    label = np.array([b.label for b in bags], np.float64)
    words = [np.frombuffer(b.words, np.int32) for b in bags]
    sizes = [np.frombuffer(b.sizes, np.int32) for b in bags]
    seen = np.zeros(BUCKETS, np.int32)
    for w in words:
        seen[np.unique(w)] += 1
    kept = np.flatnonzero(seen >= min_docs)
    column = np.full(BUCKETS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    n_sent = np.array([len(s) for s in sizes])
    doc_of = np.repeat(np.arange(len(bags)), n_sent)
    sent_of = np.repeat(np.arange(len(doc_of), dtype=np.int32), np.concatenate(sizes))
    col = column[np.concatenate(words)]
    sent_of, col = sent_of[col >= 0], col[col >= 0]
    starts = np.concatenate(([0], np.cumsum(n_sent)[:-1]))
    theta = np.zeros(len(kept) + 1)
    theta[-1] = bias - np.log(max(1.0, n_sent.mean()))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    importance = np.where(label == 1, positive_weight, 1.0)
    for step in range(1, rounds + 1):
        z = np.bincount(sent_of, weights=theta[col], minlength=len(doc_of)) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), starts)
        doc_p = np.maximum(-np.expm1(log_none), 1e-9)
        share = np.where(label == 1, -np.exp(log_none) / doc_p, 1.0) * importance
        dz = p * share[doc_of]
        grad = np.empty_like(theta)
        grad[:-1] = np.bincount(col, weights=dz[sent_of], minlength=len(kept)) / len(bags) + ridge * theta[:-1]
        grad[-1] = dz.sum() / len(bags)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6) * (1 if step < rounds * 2 // 3 else 0.2)
    weights[kept] = theta[:-1]
    return weights, float(theta[-1])


def _scores(model, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cache = model.value.tolist(), {}
        weight = weights.__getitem__
        for batch in batches:
            scores, starts, ends, tops = [], [], [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(cache) > 200_000:
                    cache.clear()
                none, best, span = 0.0, -1.0, (0, 0)
                for a, b in sentences(raw):
                    fresh: set[int] = set()
                    for word in set(raw[a:b].lower().split()):
                        used = cache.get(word)
                        if used is None:
                            used = cache[word] = tuple(k for k in word_features(word) if weights[k])
                        if used:
                            fresh.update(used)
                    z = bias + sum(map(weight, sorted(fresh)))  # in one order, so that reruns agree
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                    none += math.log1p(-min(p, 1 - 1e-12))
                    if p > best:
                        best, span = p, (a, b)
                scores.append(-math.expm1(none))
                starts.append(len(raw[: span[0]].decode("utf-8", "surrogatepass")))
                ends.append(len(raw[: span[1]].decode("utf-8", "surrogatepass")))
                tops.append(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(tops, pa.float64())],
                names=["doc_id", "score", "worst_start", "worst_end", "worst_score"],
            )

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", max_train_docs: int = MAX_TRAIN_DOCS, holdout: int = 5, threshold: float = 0.5
) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence: worst_start, worst_end (code points), worst_score."""
    weights, bias = fit(training_bags(docs, labels, label_col, max_train_docs, holdout))
    model = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS floats
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    scored = base.mapInArrow(_scores(model, bias), "doc_id long, score double, worst_start long, worst_end long, worst_score double")
    return scored.select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), holdout) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "worst_start",
        "worst_end",
        "worst_score",
    )
