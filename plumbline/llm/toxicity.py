"""Toxic passages by maximum-scoring segment search over word log-odds.

Fitting counts each word in toxic and in clean labelled documents and takes the log-odds with a
Dirichlet prior in part uniform, in part proportional to all words. Words whose log-odds are significantly above zero are
counted again by the distinct words that precede them, so that a text with many copies counts once;
those still significant form the lexicon. Every other word has the log-odds of all of them together,
a little below zero. The expected score of clean text is thus negative, and the scores are
log-likelihood ratios, so the scale of their extreme-value (Gumbel) distribution is 1.

Scoring finds all maximal-scoring segments of a document in one pass. A segment of score S in a
document of n words is found by chance K * n * exp(-S) times on average (K is fitted on clean
documents), and counts if that is at most ``SIGNIFICANT``. A document's features are its best
segment's S - ln(K * n), the sum of its counting segments, that of all its segments, and the latter for each word, from which
a logistic calibration makes a probability.

The fit takes at most ``FIT_ROWS`` labelled rows, those with the least hash of their id. The lexicon
holds every significant word of these rows, so its size is bounded by theirs and it can go to each
task. Scoring reads whole texts of all documents.

Defined cases: a null, empty or white-space text has no segment and the score of a document without
hits; rows without a label or an id aren't fitted; labels without any toxic or any clean row,
or without a word that tells them apart, give every document the same score, below the threshold; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.store import written
from plumbline.llm.textkit import word_hashes

FIT_ROWS = 20_000
#: The Dirichlet prior of a word: a count, and a share of the word's own counts; the least z-value of a
#: lexicon word; the largest E-value that counts.
PRIOR_COUNT, PRIOR_SHARE, LEAST_Z, SIGNIFICANT = 0.5, 0.005, 2.5, 0.05
THRESHOLD = 0.3
FEATURES = 4
FEATURE_ROWS = "toxic boolean, f0 double, f1 double, f2 double, f3 double, top double, n long"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    words: np.ndarray  # hashes, ascending
    odds: np.ndarray
    other: float
    log_k: float
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[1:] + self.weights[0], -30, 30)))


def segments(at: list[int], odds: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last word, score), in order.

    Word at[i] scores odds[i] > 0 and each word between scores other < 0: one pass over the hits. Each
    open segment knows the last one before it whose sum before is lower, so a search passes over the ones
    between; where none is lower, no later segment can reach back and all open ones are done.
    """
    done: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, the one with a lower sum before
    total, last = 0.0, -1
    for p, s in zip(at, odds, strict=True):
        total += other * (p - last - 1)
        last, first, before = p, p, total
        total += s
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0:
                done += [(a, z, y - x) for a, z, x, y, _ in held]
                held.clear()
            if j < 0 or held[j][3] >= total:
                held.append((first, p, before, total, j))
                break
            first, before = held[j][0], held[j][2]
            del held[j:]
    return done + [(a, z, y - x) for a, z, x, y, _ in held]


def _hits(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[tuple[pa.RecordBatch, int, list[int], list]]:
    """For runs of rows: (batch, first row, words in each row, segments of each row)."""
    for b in batches:
        for first, rows, offsets, words in word_hashes(b.column("text")):
            where = np.searchsorted(m.words, words)
            where[where == len(m.words)] = 0
            hit = np.flatnonzero(m.words[where] == words) if len(m.words) and len(words) else np.zeros(0, np.int64)
            odds, cuts = m.odds[where[hit]], np.searchsorted(hit, offsets)
            found = [segments((hit[a:z] - o).tolist(), odds[a:z].tolist(), m.other) if z > a else [] for a, z, o in zip(cuts[:-1].tolist(), cuts[1:].tolist(), offsets[:-1].tolist(), strict=True)]
            yield b, first, np.diff(offsets).tolist(), found


def features(n: int, found: list[tuple[int, int, float]], log_k: float) -> tuple[float, ...]:
    """Of a document of n words: the best segment's -ln E, the counting segments' sum, that of all, and the latter for each word."""
    base = log_k + math.log(n + 1)
    best = max((s for _, _, s in found), default=0.0) - base
    sure = sum(s for _, _, s in found if s - base >= -math.log(SIGNIFICANT))
    every = sum(s for _, _, s in found)
    return max(-12.0, min(best, 30.0)), math.log1p(sure), math.log1p(every), min(10.0, 10 * every / (n + 20))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): occurrences in this batch's labelled rows."""
    for b in batches:
        labels = np.asarray(b.column("toxic").to_pylist(), dtype=bool)
        for first, rows, offsets, words in word_hashes(b.column("text")):
            toxic = np.repeat(labels[first : first + rows], np.diff(offsets))
            each, back = np.unique(words, return_inverse=True)
            y1 = np.bincount(back, toxic, len(each)).astype(np.int64)
            y0 = np.bincount(back, ~toxic, len(each)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(y1), pa.array(y0)], names=["word", "toxic", "clean"])


def _contexts(words: np.ndarray):
    """(word, before, toxic) where one of the words (hashes, ascending) follows another word, once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = np.asarray(b.column("toxic").to_pylist(), dtype=bool)
            for first, rows, offsets, all_words in word_hashes(b.column("text")):
                if not len(all_words):
                    continue
                where = np.searchsorted(words, all_words)
                where[where == len(words)] = 0
                hit = np.flatnonzero(words[where] == all_words)
                toxic = np.repeat(labels[first : first + rows], np.diff(offsets))[hit]
                before = np.r_[np.uint64(0), all_words[:-1]]
                before[offsets[:-1][offsets[:-1] < len(all_words)]] = 0
                got = np.unique(np.rec.fromarrays([all_words[hit], before[hit], toxic]))
                yield pa.RecordBatch.from_arrays([pa.array(got.f0.view(np.int64)), pa.array(got.f1.view(np.int64)), pa.array(got.f2)], names=["word", "before", "toxic"])

    return run


def _feature_rows(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, first, ns, found in _hits(batches, m):
            rows = [features(n, f, m.log_k) for n, f in zip(ns, found, strict=True)]
            top = [max((s for _, _, s in f), default=0.0) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic").slice(first, len(ns)), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(FEATURES)], pa.array(top, pa.float64()), pa.array(ns, pa.int64())],
                names=["toxic", *[f"f{k}" for k in range(FEATURES)], "top", "n"],
            )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * len(x) * np.r_[0, w[1:]])
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows (doc_id, toxic) of docs (doc_id, text) that aren't held out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    picked = written(rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS), "toxic-labels")  # bounded, so the broadcast is
    train = written(docs.join(F.broadcast(picked), F.col("doc_id").cast("long") == F.col("id")).select("toxic", F.coalesce("text", F.lit("")).alias("text")), "toxic-train")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    prior = min((n_toxic + 1) / (n_toxic + n_clean + 2), THRESHOLD / 2)  # nothing to go by rejects nothing
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 0.0, np.r_[math.log(prior / (1 - prior)), np.zeros(FEATURES)])
    if not n_toxic or not n_clean:
        return empty
    counts = written(train.mapInArrow(_counts, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0")), "toxic-words")
    n1, n0, v = counts.agg(F.coalesce(F.sum("y1"), F.lit(0)), F.coalesce(F.sum("y0"), F.lit(0)), F.count("*")).first()
    if not n1 or not n0:
        return empty
    y1, y0 = F.col("y1"), F.col("y0")
    a, mass = PRIOR_COUNT + PRIOR_SHARE * (y1 + y0), PRIOR_COUNT * v + PRIOR_SHARE * (n1 + n0)
    odds = F.log((y1 + a) / (n1 + mass - y1 - a)) - F.log((y0 + a) / (n0 + mass - y0 - a))
    z = odds / F.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    significant = lambda df: df.select("word", "y1", "y0", odds.alias("odds"), z.alias("z")).where((z >= LEAST_Z) & (odds > 0.5)).toArrow()
    first = np.sort(significant(counts).column("word").to_numpy().view(np.uint64))
    if not len(first):
        return empty
    each = train.mapInArrow(_contexts(first), "word long, before long, toxic boolean").distinct()
    top = significant(each.groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("y1"), F.sum((~F.col("toxic")).cast("long")).alias("y0")))
    words = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, odds = words[order], top.column("odds").to_numpy()[order]
    t1, t0 = top.column("y1").to_numpy().sum(), top.column("y0").to_numpy().sum()
    other = min(-1e-3, math.log((n1 - t1 + 1) / (n1 + 1)) - math.log((n0 - t0 + 1) / (n0 + 1)))
    m = Model(words, odds, other, 0.0, empty.weights)
    if not len(words):
        return m
    got = train.mapInArrow(_feature_rows(m), FEATURE_ROWS).toArrow()
    top, n, toxic = got.column("top").to_numpy(), got.column("n").to_numpy(), got.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
    # Gumbel with scale 1: K is where clean documents' best segments, less ln(n), have their mean excess.
    clean = top[~toxic & (n > 0)] - np.log(n[~toxic & (n > 0)] + 1)
    m.log_k = float(np.log(np.mean(np.exp(np.minimum(clean, 20))))) if len(clean) else 0.0
    got = train.mapInArrow(_feature_rows(m), FEATURE_ROWS).toArrow()
    x = np.column_stack([got.column(f"f{k}").to_numpy() for k in range(FEATURES)])
    m.weights = _logistic(x, got.column("toxic").to_numpy(zero_copy_only=False).astype(float))
    return m


SCORED = "doc_id long, n_words long, score double, passages array<struct<first:long,last:long,score:double,e_value:double>>"


def _scored(m: Model):
    passages = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, first, ns, found in _hits(batches, m):
            x = np.array([features(n, f, m.log_k) for n, f in zip(ns, found, strict=True)]).reshape(-1, FEATURES)
            spans = []
            for n, f in zip(ns, found, strict=True):
                base = m.log_k + math.log(n + 1)
                spans.append([{"first": a, "last": z, "score": s, "e_value": math.exp(min(base - s, 50))} for a, z, s in f if s - base >= -math.log(SIGNIFICANT)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(first, len(ns)), pa.array(ns, pa.int64()), pa.array(m.score(x)), pa.array(spans, passages)], names=["doc_id", "n_words", "score", "passages"]
            )

    return run


def scored(docs: DataFrame, m: Model) -> DataFrame:
    """(doc_id, n_words, score, passages) for each row of docs (doc_id long, text string)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(m), SCORED)


def _kept(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for _, _, ns, found in _hits(iter([b]), m):
                x = np.array([features(n, f, m.log_k) for n, f in zip(ns, found, strict=True)]).reshape(-1, FEATURES)
                keep.append(m.score(x) < THRESHOLD)
            yield b.filter(pa.array(np.concatenate(keep))) if keep else b

    return run


def without_toxic(docs: DataFrame, m: Model) -> DataFrame:
    """The rows of docs whose score is under THRESHOLD, with the columns of docs."""
    return docs.mapInArrow(_kept(m), docs.schema)


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return scored(docs, m).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", "passages")
