"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. A text is cut into windows of
WINDOW words; each is compressed on its own against the ordinary dictionary, and against the toxic one with the
ordinary one behind it. What a window saves with the toxic dictionary is its evidence: a window without toxic strings
saves nothing. A logistic curve over a document's savings (largest, mean of the three largest, mean, share and
numbers of windows that save, number of windows), fitted on the training rows, is the calibrated score.

Toxic documents are mostly ordinary words, so the toxic dictionary is trained on their telling words only: words
that start with a string found in many toxic and few ordinary training documents, chosen greedily until each
document has COVER of them. Labels are learnt from at most TRAIN_DOCS rows of each class, those with the least
hash of id, and the ordinary dictionary from at most ORDINARY_WINDOWS of their windows, taken at even distances over
all of them; only that fit is bounded, all documents and all their windows are scored.

The curve is fitted on the rows that the dictionaries are trained on: holding rows out for it, as parts in turn or one
part, was measured and catches fewer held-out toxic documents (README).

Edge cases. A null or empty text has one empty window and gets that window's score. Long texts are scored whole.
Repeated rows each give a row; repeated labels of an id count once (the largest). With no toxic or no ordinary
training row every score is 0. An empty table gives no rows. Other columns, labels included, are no inputs.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, DICTIONARY = 20, 8192
TRAIN_DOCS = 2000
#: Most windows of ordinary documents that their dictionary is trained on, spread over all that TRAIN_DOCS leaves.
ORDINARY_WINDOWS = 20_000
COVER, RATIO = 4, 8.0
FOLDS, HELD = 5, 0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?|&$%*#\"'()[]{}<>"
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return [w.strip(_EDGES) for w in _WORD.findall((text or "").translate(_LOWER))]


def windows(said: list[str], size: int = WINDOW) -> list[bytes]:
    return [(" " + " ".join(said[a : a + size]) + " ").encode("utf-8", "replace") for a in range(0, max(1, len(said)), size)]


def telling(toxic: list[list[str]], ordinary: list[list[str]]) -> list[str]:
    """Starts of words (and whole words) that tell toxic documents from ordinary ones."""

    def strings(said: list[str]) -> set[str]:
        out = set()
        for w in set(said):
            out.update(f" {w[:n]}" for n in range(3, 9) if len(w) >= n)
            out.add(f" {w} ")
        return out

    # Strings are made anew for each pass: held all at once they would be most of the driver's memory.
    least = max(3, 0.004 * len(toxic))
    in_toxic: Counter[str] = Counter()
    for said in toxic:
        in_toxic.update(strings(said))
    in_toxic = Counter({x: c for x, c in in_toxic.items() if c >= least})
    in_ordinary: Counter[str] = Counter()
    for said in ordinary:
        in_ordinary.update(x for x in strings(said) if x in in_toxic)
    weight = {}
    for x, c in in_toxic.items():
        ratio = (c / len(toxic)) / ((in_ordinary[x] + 0.5) / max(len(ordinary), 1))
        if ratio >= RATIO:
            weight[x] = math.log(ratio)
    need, where = [COVER] * len(toxic), defaultdict(list)
    for i, said in enumerate(toxic):
        for x in strings(said):
            if x in weight:
                where[x].append(i)
    heap = [(-len(v) * weight[x], x) for x, v in sorted(where.items())]
    heapq.heapify(heap)
    chosen: list[str] = []
    while heap:
        _, x = heapq.heappop(heap)
        covers = sum(need[i] > 0 for i in where[x])
        if covers < least or any(x.startswith(q) or q.startswith(x) for q in chosen):
            continue
        if heap and -covers * weight[x] > heap[0][0]:
            heapq.heappush(heap, (-covers * weight[x], x))
            continue
        chosen.append(x)
        for i in where[x]:
            need[i] -= need[i] > 0
    return chosen


def trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def spread(good: list[list[str]], most: int | None = None) -> list[bytes]:
    """All windows of ordinary documents, or if there are more than `most` (ORDINARY_WINDOWS), so many at even distances over all."""
    most = ORDINARY_WINDOWS if most is None else most
    total, before, out = sum(len(range(0, max(1, len(w)), WINDOW)) for w in good), 0, []
    for w in good:  # the k-th of all is taken if a new share of 1 / most of them begins there
        some = windows(w)
        out += some if total <= most else [x for k, x in enumerate(some, before) if k * most // total != (k - 1) * most // total]
        before += len(some)
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def one(content: bytes) -> zstandard.ZstdCompressor:
            how = zstandard.ZstdCompressionParameters(
                window_log=15, hash_log=13, chain_log=13, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
            return zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

        return one(self.ordinary), one(self.toxic + self.ordinary)

    def features(self, texts: list[str | None], pair=None) -> np.ndarray:
        plain, toxic = pair or self.compressors()
        out = np.zeros((len(texts), 7))
        for i, text in enumerate(texts):
            saved = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(words(text))], float)
            top = np.sort(saved)[::-1]
            out[i] = top[0], top[:3].mean(), saved.mean(), (saved >= 2).mean(), np.log1p((saved >= 2).sum()), np.log1p((saved >= 4).sum()), np.log1p(len(saved))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str | None], toxic: list[bool], share: float | None = None) -> Model | None:
    """share: that of toxic rows among all training rows, where texts hold the classes in other proportions."""
    same: dict[str, str] = {}
    said = [[same.setdefault(w, w) for w in words(t)] for t in texts]  # equal words share their memory
    seen: set[tuple[bool, int]] = set()
    bad, good = [], []
    for w, y in zip(said, toxic, strict=True):  # copies count once
        if (key := (bool(y), hash(tuple(w)))) not in seen:
            seen.add(key)
            (bad if y else good).append(w)
    if not bad or not good:
        return None
    starts = tuple(telling(bad, good))
    evidence = [[x for x in w if starts and f" {x} ".startswith(starts)] for w in bad]
    toxic_samples = [(" " + " ".join(e) + " ").encode() for e in evidence if e]
    plain_samples = spread(good)
    model = Model(trained(DICTIONARY, plain_samples), trained(DICTIONARY // 4, toxic_samples) if toxic_samples else b"", np.zeros(7), np.ones(7), np.zeros(8))
    x, y = model.features(texts), np.array(toxic, float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w, ridge = np.zeros(8), np.diag([1e-2] * 7 + [1e-6])
    share = y.mean() if share is None else share
    each = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z.T * (each * p * (1 - p))) @ z + ridge, z.T @ (each * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = w
    return model


def learnt(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> Model | None:
    """The model of the labelled rows that `training` marks, at most TRAIN_DOCS of each class."""
    said = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64("id"))
    few = said.where(training).where("toxic = 1").orderBy("draw", "id").limit(TRAIN_DOCS).unionAll(said.where(training).where("toxic = 0").orderBy("draw", "id").limit(TRAIN_DOCS))
    bad, every = said.where(training).where("toxic IN (0, 1)").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    few = common.written(few, "labelled")  # at most 2 * TRAIN_DOCS rows, so the broadcast is bounded
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(few), "id")
    got = rows.select("id", "text", "toxic").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    texts, toxic = got.column("text").to_pylist(), got.column("toxic").to_pylist()
    return fit([texts[i] for i in order], [bool(toxic[i]) for i in order], bad / every if every else None)


def scored(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, score): one for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        pair = own.compressors() if own else None
        for part in parts:
            texts = part.column(1).to_pylist()
            score = own.score(own.features(texts, pair)) if own else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["id", "score"])

    return common.mapped(docs.select(F.col(key).cast("long"), F.col(text).cast("string")), of, "id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learnt(docs, labels, common.remainder("id", FOLDS) != HELD)
    return scored(docs, model).select(
        F.col("id").alias("doc_id"), (common.remainder("id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 and more go."""
    model = learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    shared = spark.sparkContext.broadcast(model)
    names, place = docs.columns, docs.columns.index("text")

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        pair = own.compressors() if own else None
        for part in parts:
            yield part.filter(pa.array(own.score(own.features(part.column(place).to_pylist(), pair)) < 0.5)) if own and part.num_rows else part

    return common.mapped(docs.select(*(F.col(f"`{c}`") for c in names)), of, docs.schema)
