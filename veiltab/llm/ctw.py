"""Language-model scores by context-tree weighting (CTW) over binary-decomposed bytes.

A text is its UTF-8 bytes, A-Z lowered, and one end symbol (0xFF, which UTF-8 never holds); before its first byte
stand end symbols. A context of depth d is the last d bytes as they are. In every context the next byte is eight
binary decisions, each with Krichevsky-Trofimov counts. By the CTW recursion the evidence of a node is half
its own KT block probability and half the product of its children's; the posterior weights mix the estimates of all
depths 0..depth on the way to the deepest context seen. The mixture is a distribution over whole texts: score is
log10 of a text's probability and -score * log2(10) / bytes its code length per byte.

Counts come from every byte of every training row and all of them stay. The tree grows with the corpus and is never in
one place: it lies as a written table of pairs, is dealt out by contexts of the first depth below its top and built
part by part; only the top is one model that all parts share. The top has depths 0..TOP if at most MOST_TOP (context,
byte) pairs of depth TOP occur, which is counted first; else one depth less, at most 2^16 pairs. Where the tree is cut
changes no result. Beside the top executors are sent, as a cache, the results of the pairs and words with a share of
at least 2^-22 of the total, at most 2^22 each. The results of all other pairs and words are joined by shuffle, so the
cache decides on no score.

Edge cases. A null text is the empty text: one end token, the probability of ending at once. Long texts are scored
whole. Repeated rows each give a row. With no training rows every decision is even. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

DEPTH = 5  # at most 6: a node's key has 8 bits for each byte of the context and 8 for the decisions
#: Least share of the corpus, as a power of two, of what is sent to executors.
SHARE_BITS = 22
#: Depths 0..TOP of the tree are one model if depth TOP has MOST_TOP pairs at most; what is deeper is worked on in parts of about CHUNK pairs.
TOP, MOST_TOP, CHUNK = 2, 1 << 19, 100_000
END = 0xFF
FOLDS, PARTS = 7, 2


def mask(depth: int) -> int:
    """Of a key: the byte in the lowest 8 bits, then 8 bits for each of the bytes before it, the last one lowest."""
    return (1 << (8 + 8 * depth)) - 1


def keys_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(the key of each byte and each end, in order; bounds by text)."""
    gap = bytes([END]) * depth
    joined = np.frombuffer(b"".join(gap + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(bounds[-1]) + np.repeat(np.arange(1, len(texts) + 1) * depth, sizes)
    key = joined[at].astype(np.uint64)
    for d in range(1, depth + 1):
        key |= joined[at - d].astype(np.uint64) << np.uint64(8 * d)
    return key, bounds


def counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (kind, key, n) of docs (text): kind 0 counts the keys, kind 1 the words, kind 2 the texts (key 0)."""

    def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(n, first)

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list] = {0: [], 1: []}
        total = 0

        def rows(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = merged(have[kind])
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[a : a + 100_000])], ["kind", "key", "n"])
            have[kind] = []

        for part in parts:
            for _, some in words.batches(range(part.num_rows), (t.as_py() for t in part.column(0))):
                total += len(some)
                for kind, keys in ((0, keys_of(some, depth)[0]), (1, words.word_hashes(some)[0])):
                    k, n = np.unique(keys, return_counts=True)
                    if len(k):
                        have[kind].append((k, n.astype(np.int64)))
                    if len(have[kind]) > 8:
                        have[kind] = [merged(have[kind])]
                        if len(have[kind][0][0]) > 2_000_000:  # bounded memory: partial sums may go out early
                            yield from rows(kind)
        for kind in (0, 1):
            if have[kind]:
                yield from rows(kind)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["kind", "key", "n"])

    return common.mapped(docs.select("text"), of, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


_HALF = np.array([math.lgamma(i + 0.5) for i in range(64)])
_ONE = np.array([math.lgamma(i + 1.0) for i in range(64)])


def _lgamma(n: np.ndarray, more: float, few: np.ndarray) -> np.ndarray:
    """ln gamma(n + more) for whole n >= 0: a table of the first, then Stirling's series."""
    x = np.maximum(n, len(few)) + more
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < len(few), few[np.minimum(n, len(few) - 1).astype(np.int64)], big)


class Model:
    """For each depth from first on the sorted node keys and the mixed probability of a one there. A node's key is its
    context's bits (key >> 8) above 8 bits for the bits decided so far, with a leading one.

    A whole tree has first 0. A part of a tree holds, from depth first on, all nodes below some contexts of that depth;
    above is the model that ends one depth before. up is what a part says to the nodes above it, below what parts say."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]], first: int = 0, above: Model | None = None, below: tuple[np.ndarray, np.ndarray] | None = None):
        """pairs: for each depth (keys, counts), the keys sorted as unsigned numbers and distinct. below: (distinct nodes
        of the last depth, summed evidence of their children). A part without above has evidence only."""
        self.first, self.above = first, above
        levels = [self._nodes(k, n) for k, n in pairs]
        self.nodes: list[np.ndarray] = [x[0] for x in levels]
        kept = []
        for d in range(len(levels) - 1, -1, -1):
            keys, zero, one = levels[d]
            block = _lgamma(zero, 0.5, _HALF) + _lgamma(one, 0.5, _HALF) - math.log(math.pi) - _lgamma(zero + one, 1.0, _ONE)
            under = np.zeros(len(keys))
            inner = np.zeros(len(keys), bool)
            if below is not None and len(keys):
                at = np.minimum(np.searchsorted(keys, below[0]), len(keys) - 1)
                ok = keys[at] == below[0]
                under[at[ok]] = below[1][ok]
                inner[at[ok]] = True
            stop = np.where(inner, 1 / (1 + np.exp(np.clip(under - block, -700, 700))), 1.0)
            evidence = np.where(inner, np.logaddexp(block, under) - math.log(2), block)
            kept.append((stop, (one + 0.5) / (zero + one + 1.0)))
            if first + d:
                parents, back = np.unique(self._parent(keys, first + d - 1), return_inverse=True)
                below = parents, np.bincount(back, evidence, len(parents))
        self.up = below
        self.ones: list[np.ndarray] = []
        if first and above is None:
            return
        nodes, left, mixed = above.state if above is not None else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
        for d, (stop, ratio) in enumerate(reversed(kept)):
            if first + d and len(nodes):
                at = np.minimum(np.searchsorted(nodes, self._parent(self.nodes[d], first + d - 1)), len(nodes) - 1)
                left_here, mixed_here = left[at], mixed[at]
            else:
                left_here, mixed_here = np.ones(len(ratio)), np.zeros(len(ratio))
            self.ones.append(mixed_here + left_here * ratio)
            nodes, left, mixed = self.nodes[d], left_here * (1 - stop), mixed_here + left_here * stop * ratio
        self.state = nodes, left, mixed

    @staticmethod
    def _parent(nodes: np.ndarray, depth: int) -> np.ndarray:
        return nodes & np.uint64(mask(depth))

    @staticmethod
    def _nodes(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The binary nodes on the way to each byte: (node keys sorted, zeros, ones)."""
        context, byte = keys >> np.uint64(8), keys & np.uint64(255)
        order = np.lexsort((byte, context))
        context, byte, n = context[order], byte[order], n[order].astype(np.float64)
        found = []
        for bit in range(8):
            node = (context << np.uint64(8)) | (np.uint64(1 << bit) | (byte >> np.uint64(8 - bit)))
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
            one = n * ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float64)
            if len(first):
                ones = np.add.reduceat(one, first)
                found.append((node[first], np.add.reduceat(n, first) - ones, ones))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        keys, zero, one = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys)
        return keys[order], zero[order], one[order]

    def _one(self, node: np.ndarray) -> np.ndarray:
        """The mixed probability of a one at the deepest node seen on each node's path."""
        p, todo = np.full(len(node), 0.5), np.arange(len(node))
        for d in range(len(self.nodes) - 1, -1, -1):
            if not len(self.nodes[d]) or not len(todo):
                continue
            want = node[todo] & np.uint64(mask(self.first + d))
            at = np.minimum(np.searchsorted(self.nodes[d], want), len(self.nodes[d]) - 1)
            ok = self.nodes[d][at] == want
            p[todo[ok]] = self.ones[d][at[ok]]
            todo = todo[~ok]
        if self.above is not None and len(todo):
            p[todo] = self.above._one(node[todo])
        return p

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of each key's byte in its context."""
        out = np.zeros(len(keys))
        context, byte = keys >> np.uint64(8), keys & np.uint64(255)
        for bit in range(8):
            p = self._one((context << np.uint64(8)) | (np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))))
            out += np.log10(np.where((byte >> np.uint64(7 - bit)) & np.uint64(1), p, 1 - p))
        return out


def arrays_of(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    keys, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _levels(keys: np.ndarray, n: np.ndarray, depths: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (keys, counts) of each depth from those of the deepest or a deeper one."""
    out = []
    for d in reversed(depths):
        keys, back = np.unique(keys & np.uint64(mask(d)), return_inverse=True)
        n = np.bincount(back, n, len(keys))
        out.append((keys, n))
    return out[::-1]


def _parts(rows: Iterator[pa.RecordBatch], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (key, n, asked) sorted by their context of depth first, as larger ones that hold contexts whole."""
    have, size = [], 0
    for row in rows:
        some = [row.column(0).to_numpy().view(np.uint64), row.column(1).to_numpy(), row.column(2).to_numpy(zero_copy_only=False)]
        have.append(some)
        size += len(some[0])
        if size < CHUNK:
            continue
        key, n, asked = (np.concatenate(x) for x in zip(*have, strict=True))
        context = (key & np.uint64(mask(first))) >> np.uint64(8)
        cut = int(np.flatnonzero(context != context[-1])[-1]) + 1 if (context != context[-1]).any() else 0
        if cut:
            yield key[:cut], n[:cut], asked[:cut]
        have = [[key[cut:], n[cut:], asked[cut:]]]
        size = len(key) - cut
    if size:
        yield tuple(np.concatenate(x) for x in zip(*have, strict=True))


def _together(rows: DataFrame, first: int) -> DataFrame:
    """rows (key, n, asked) with all of a context of depth first in one partition and in a row."""
    context = F.col("key").bitwiseAND(F.lit(mask(first) & ~255))
    return rows.select("key", "n", "asked", context.alias("context")).repartition("context").sortWithinPartitions("context").select("key", "n", "asked")


def train(found: DataFrame, depth: int = DEPTH) -> tuple[Model, int]:
    """The model of the tree's top, with the evidence of all that is deeper, of a written table of counts(), and the
    number of symbols behind it."""
    grams, last = found.where("kind = 0"), min(TOP, depth)
    at = lambda d: grams.groupBy(F.col("key").bitwiseAND(F.lit(mask(d))).alias("key")).agg(F.sum("n").alias("n"))
    while last > 1 and at(last).count() > MOST_TOP:
        last -= 1
    keys, n = arrays_of(at(last))
    below = None
    if depth > last:

        def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, n, _ in _parts(rows, last + 1):
                nodes, evidence = Model(_levels(key, n, range(last + 1, depth + 1)), last + 1).up
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(evidence)], ["key", "n"])

        said = common.mapped(_together(grams.select("key", "n", F.lit(False).alias("asked")), last + 1), of, "key long, n double")
        below = arrays_of(said.groupBy("key").agg(F.sum("n").alias("n")))  # the nodes of depth last
    return Model(_levels(keys, n, range(last + 1)), below=below), int(n.sum())


def evaluated(rows: DataFrame, model: Model, top: Broadcast, depth: int = DEPTH) -> DataFrame:
    """Rows (key, log10) for the distinct keys asked for in rows (key, n: its count in training or 0, asked). rows hold
    every key of the training table; the part of the tree below the top is built context by context."""
    first = len(model.nodes)

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, asked in _parts(rows, min(first, depth)):
            if asked.any():
                part = Model(_levels(key[n > 0], n[n > 0], range(first, depth + 1)), first, top.value)
                want = np.unique(key[asked])
                yield pa.RecordBatch.from_arrays([pa.array(want.view(np.int64)), pa.array(part.log10(want))], ["key", "log10"])

    return common.mapped(_together(rows, min(first, depth)), of, "key long, log10 double")


def scores(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    training says which rows are learnt from; held_out is its negation (a null is held out). The base is the unigram
    word model with add-one smoothing."""
    with common.scratch() as own:
        return common.written(_scores(docs, training, key, text, depth, own), "scores")


def _scores(docs: DataFrame, training: Column, key: str, text: str, depth: int, own: common.Scratch) -> DataFrame:
    spark = docs.sparkSession
    held = ~F.coalesce(training, F.lit(False))
    found = own.written(counts(docs.where(~held).select(F.coalesce(F.col(text), F.lit("")).alias("text")), depth), "counts")
    model, total = train(found, depth)
    top, least = spark.sparkContext.broadcast(model), max(1, total >> SHARE_BITS)
    grams = found.where("kind = 0")
    common_keys, common_logs = arrays_of(evaluated(grams.select("key", "n", (F.col("n") >= least).alias("asked")), model, top, depth).withColumnRenamed("log10", "n"))
    vocabulary = found.where("kind = 1")
    n_words, v_words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = found.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, v = n_words + ends, v_words + bool(ends)
    floor = max(1, n_words >> SHARE_BITS)
    often_keys, often_n = arrays_of(vocabulary.where(F.col("n") >= floor).select("key", "n"))
    shared = spark.sparkContext.broadcast((common_keys, common_logs, often_keys, np.log10((often_n + 1) / (n + v + 1))))
    unseen, end_cost = -math.log10(n + v + 1), math.log10((ends + 1) / (n + v + 1))

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_keys, seen_logs, often, cost = shared.value
        for part in parts:
            rows = list(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True))
            for ids, texts in words.batches(rows, (t.as_py() for t in part.column(1))):
                keys, bounds = keys_of(texts, depth)
                distinct, back = np.unique(keys, return_inverse=True)
                at = np.minimum(np.searchsorted(seen_keys, distinct), max(len(seen_keys) - 1, 0))
                seen = seen_keys[at] == distinct if len(seen_keys) else np.zeros(len(distinct), bool)
                logs = np.where(seen, seen_logs[at], 0.0) if len(seen_keys) else np.zeros(len(distinct))
                score = np.add.reduceat(logs[back], bounds[:-1])
                other = np.flatnonzero(~seen[back])
                other_bounds = np.searchsorted(other, bounds)
                hashes, word_bounds = words.word_hashes(texts)
                n_words = np.diff(word_bounds)
                owner = np.repeat(np.arange(len(texts)), n_words)
                if len(often):
                    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
                    known = often[at] == hashes
                else:
                    at, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                base = np.bincount(owner[known], cost[at[known]] if len(often) else None, len(texts)) + end_cost
                n_known = np.bincount(owner[known], minlength=len(texts)) + bool(ends)
                rare, rare_owner = hashes[~known], owner[~known]
                rare_bounds = np.concatenate(([0], np.cumsum(np.bincount(rare_owner, minlength=len(texts)))))
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _ in ids], pa.int64()), pa.array([h for _, h in ids], pa.bool_()), pa.array(n_words + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(score, pa.float64()), pa.array(np.diff(bounds) - 1, pa.int64()), pa.ListArray.from_arrays(pa.array(rare_bounds, pa.int32()), pa.array(rare.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(other_bounds, pa.int32()), pa.array(keys[other].view(np.int64))),
                ], ["id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "rare", "keys"])

    schema = "id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, keys array<long>"
    every = common.mapped(docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")), held), of, schema)
    # A number of our own for each row: ids may repeat.
    every = own.written(every.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare_words = vocabulary.where(F.col("n") < floor).select("key", F.log10((F.col("n") + 1) / F.lit(float(n + v + 1))).alias("cost"))
    rare = (
        every.select("row", F.explode("rare").alias("key")).join(rare_words, "key", "left")
        .groupBy("row").agg(F.count("cost").alias("more"), F.sum(F.coalesce("cost", F.lit(unseen))).alias("rest"))
    )
    asked = every.select("row", F.explode("keys").alias("key"))
    rows = grams.select("key", "n", F.lit(False).alias("asked")).unionAll(asked.select("key").distinct().select("key", F.lit(0).cast("long"), F.lit(True)))
    logs = own.written(evaluated(rows, model, top, depth), "logs")
    deep = asked.join(logs, "key").groupBy("row").agg(F.sum("log10").alias("deep"))
    both = every.drop("rare", "keys").join(rare, "row", "left").join(deep, "row", "left").withColumn("score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    return both.select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", "n_bytes",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, common.remainder("doc_id", FOLDS) != PARTS).withColumnRenamed("id", "doc_id")
