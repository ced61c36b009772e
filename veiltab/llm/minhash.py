"""Near-duplicate documents by HyperMinHash.

Each set of word shingles is sketched in `buckets` registers. A register holds the number of leading zeros of the
bucket's least hash and the MANTISSA bits after them, 16 bits in all, in place of a 64-bit minimum. Runs of `rows`
registers are the bands; sets that agree on a band are candidates, an estimate of their Jaccard similarity from
equal registers, less the chance collisions of such short registers, drops the hopeless, and the rest is confirmed
on the full sets.

Groups. Equal sets are one class from the start, so copies are never paired. In a bucket of a band each class
meets the most central one only (a star). Classes that are then still in different components of a bucket are
compared in blocks of BLOCK, estimate first and full sets after, and a block gives the links of a spanning forest
only. So a group of n near copies gives about n rows, and no pair of different texts that share a band stays
untested unless they are connected already.

Edge cases. A null or empty text, or one of white space, has the empty set: no links, its own component, kept.
Fewer words than a shingle's: the whole sequence is the one shingle. Repeated texts share a component. Ties: the
smallest id stands for its component. An empty table gives no rows. Other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Registers of a sketch, registers of a band: 42 bands; a pair of similarity 0.75 shares none with probability 3e-4.
BUCKETS, ROWS = 256, 6
MANTISSA = 10
#: Standard deviations of the estimate below the threshold at which a candidate is dropped unverified.
MARGIN = 4.5
#: Classes and shingles of a bucket's block, about; what the stars leave apart is compared block by block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19


def registers(sets: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """A row of 16-bit registers for each non-empty set; empty buckets borrow from filled ones (densification)."""
    n = len(bounds) - 1
    bits = int(math.log2(buckets))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    bucket = (sets >> np.uint64(64 - bits)).astype(np.int64)
    slot = owner * buckets + bucket
    first = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, bool)  # sets are sorted: the least hash of a bucket comes first
    fraction, exponent = np.frexp(((sets[first] << np.uint64(bits)) | np.uint64(1)).astype(np.float64))
    value = ((64 - exponent).clip(0, 63) << MANTISSA) | ((fraction - 0.5) * (2 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1)
    out, full = np.zeros(n * buckets, np.uint16), np.zeros(n * buckets, bool)
    out[slot[first]], full[slot[first]] = value, True
    out, full = out.reshape(n, buckets), full.reshape(n, buckets)
    some = full.any(axis=1)
    origin, done = out.copy(), full.copy()
    for attempt in range(1, 25):
        row, col = np.nonzero(~done & some[:, None])
        if not len(row):
            break
        source = (words.mix((col * 1009 + attempt * 7919).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        ok = full[row, source]
        out[row[ok], col[ok]] = origin[row[ok], source[ok]]
        done[row[ok], col[ok]] = True
    for shift in range(1, buckets):  # few filled buckets: the next one round the ring
        row, col = np.nonzero(~done & some[:, None])
        if not len(row):
            break
        source = (col + shift) % buckets
        ok = full[row, source]
        out[row[ok], col[ok]] = origin[row[ok], source[ok]]
        done[row[ok], col[ok]] = True
    return out


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Rows (id, n: set size, f1, f2: a 128-bit fingerprint of the set, sketch: the registers; null for the empty set)."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ids, texts in words.batches(part.column(0).to_pylist(), (t.as_py() for t in part.column(1))):
                sets, bounds = words.shingle_sets(texts, width)
                sizes = np.diff(bounds)
                table = registers(sets, bounds)
                other = words.mix(sets ^ np.uint64(0x5851F42D4C957F2D))
                total = lambda x: np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
                c1, c2 = total(words.mix(sets)), total(other)
                f1, f2 = (c1[bounds[1:]] - c1[bounds[:-1]]).view(np.int64), (c2[bounds[1:]] - c2[bounds[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(f1), pa.array(f2),
                    pa.array([r.tobytes() if s else None for r, s in zip(table, sizes, strict=True)], pa.binary()),
                ], ["id", "n", "f1", "f2", "sketch"])

    return common.mapped(docs.select(F.col(key).cast("long"), F.col(text)), of, "id long, n long, f1 long, f2 long, sketch binary")


def expected_collisions(na: np.ndarray, nb: np.ndarray, buckets: int, mantissa: int = MANTISSA) -> np.ndarray:
    """Registers of two disjoint sets that agree by chance, after Yu and Weber: 0.1699 is their limit constant."""
    n, m = np.maximum(na, nb).astype(float), np.maximum(np.minimum(na, nb), 1).astype(float)
    ratio = 4 * (n / m) / np.square(1 + n / m)
    return 0.169919487159739093975315012348 * ratio * buckets / 2**mantissa


def estimates(pairs: DataFrame, threshold: float, margin: float = MARGIN) -> DataFrame:
    """Of rows (a, b, na, nb, sa, sb), the pairs (a, b, na, nb) whose collision-corrected estimate may reach threshold."""

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(x, np.uint16) for x in part.column(c).to_pylist()]) for c in ("sa", "sb"))
            na, nb = part.column("na").to_numpy(), part.column("nb").to_numpy()
            k = a.shape[1]
            chance = expected_collisions(na, nb, k) / k
            estimate = ((a == b).mean(axis=1) - chance) / (1 - chance)
            spread = np.sqrt(threshold * (1 - threshold) / np.minimum(k, np.maximum(np.minimum(na, nb), 1)))
            yield part.select(["a", "b", "na", "nb"]).filter(pa.array(estimate >= threshold - margin * spread))

    return common.mapped(pairs, of, "a long, b long, na long, nb long")


def shingles(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ids, texts in words.batches(part.column(0).to_pylist(), (t.as_py() for t in part.column(1))):
                sets, bounds = words.shingle_sets(texts, width)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["id", "shingles"])

    return common.mapped(docs.select(F.col(key).cast("long"), F.col(text)), of, "id long, shingles array<long>")


def sets_of(ids: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Rows (id, shingles) of the documents named by a written table (id)."""
    some = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(common.small(ids), "id", "left_semi")
    return shingles(some, "id", "text", width)


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of candidates (a, b, na, nb) with 100 * intersection >= percent * union of their full sets.

    a may be in any number of pairs (the centre of a star), b in few: a's sets are joined first, while the rows of a
    hot a are four numbers each (and Spark splits them), and go on dealt by b."""
    with common.scratch() as own:
        pairs = own.written(pairs, "candidates")
        ids = own.written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "ids")
        sets = own.written(sets_of(ids, docs, key, text, width), "sets")
        left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return common.written(pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"), "linked")


def forest(names: np.ndarray, component: np.ndarray, equal: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs marked in equal, as many as connect what they connect (component: what is connected before)."""
    above = {int(c): int(c) for c in component}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(equal, 1)), strict=True):
        a, b = root(int(component[i])), root(int(component[j]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((int(min(names[i], names[j])), int(max(names[i], names[j]))))
    return out


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The sizes of all intersections of some sets of distinct values."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = np.cumsum(count > 1) - 1
    some = count[place] > 1
    owner, place = owner[some], twice[place[some]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, (a, a + columns))
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[lo:hi], place[lo:hi] - a] = 1
        out += part @ part.T
    return out.astype(np.int64)


def residue(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one bucket and different components.

    rest: (key, members: classes of the bucket, volume: shingles of them all, rep, n, component); sets: (rep, shingles,
    sketch). A task gets two blocks of a bucket, so its memory is bounded by BLOCK and BLOCK_SHINGLES, or two sets if
    these are larger."""
    threshold = percent / 100
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("volume") / BLOCK_SHINGLES)).cast("int")
    dealt = rest.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", "n", "component").join(sets, "rep")

    def of(group: pa.Table) -> pa.Table:
        names, n, component = (group.column(c).to_numpy() for c in ("rep", "n", "component"))
        table = np.stack([np.frombuffer(x, np.uint16) for x in group.column("sketch").to_pylist()])
        same = np.zeros((len(n), len(n)), np.int16)
        for register in range(table.shape[1]):
            same += table[:, register, None] == table[None, :, register]
        chance = expected_collisions(n[:, None], n[None, :], table.shape[1]) / table.shape[1]
        estimate = (same / table.shape[1] - chance) / (1 - chance)
        spread = np.sqrt(threshold * (1 - threshold) / np.minimum(table.shape[1], np.minimum(n[:, None], n[None, :])))
        likely = (estimate >= threshold - MARGIN * spread) & (component[:, None] != component[None, :])
        on = np.flatnonzero(likely.any(axis=1))
        links = []
        del same, estimate, spread, table
        if len(on):
            lists = group.column("shingles").combine_chunks()
            flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            both = overlaps([flat[bounds[i] : bounds[i + 1]] for i in on])
            union = n[on][:, None] + n[on][None, :] - both
            links = forest(names[on], component[on], likely[np.ix_(on, on)] & (100 * both >= percent * union))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(of, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).

    A written table; what was written on the way is removed."""
    threshold, bands = percent / 100, BUCKETS // ROWS
    with common.scratch() as own:
        every = own.written(sketches(docs, key, text, width), "sketches")
        classes = own.written(every.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
        keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
        banded = classes.select("rep", "n", F.posexplode(keys).alias("band", "key")).select("rep", "n", F.xxhash64("band", "key").alias("key"))
        # Joins on a band's key have one row per key on their other side, so Spark may split a hot key's rows.
        sizes_of = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        shared = own.written(banded.join(sizes_of, "key"), "bands")
        # The centre of a star: the class that meets the most others over all bands, as the origin of a group of copies does.
        met = shared.groupBy("rep").agg(F.sum(F.col("members") - 1).alias("met"))
        bare, shared = shared, own.written(shared.drop("members").join(met, "rep"), "bands")
        own.drop(bare)
        sizes = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        other = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        starred = own.written(shared.join(shared.groupBy("key").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("pivot")), "key").where("rep <> pivot").select("key", "pivot", "rep", "n"), "stars")
        own.drop(shared)
        pairs = starred.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
        near = estimates(pairs.join(sizes, "a").join(other, "b").where(close).select("a", "b", "na", "nb", "sa", "sb"), threshold)
        star = confirmed(near, docs, key, text, width, percent)
        label = common.components(star)
        own.tables += [star, label]
        # What is left: buckets with classes that are not yet connected, without the centres, which have met all others there.
        named = starred.drop("pivot").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), F.sum("n").alias("volume")).where("lo < hi").drop("lo", "hi")
        rest = own.written(named.join(open_keys, "key").select("key", "members", "volume", "rep", "n", "component"), "rest")
        if rest.head(1):
            ids = own.written(rest.select(F.col("rep").alias("id")).distinct(), "ids")
            sets = own.written(sets_of(ids, docs, key, text, width).withColumnRenamed("id", "rep").join(classes.select("rep", "sketch"), "rep"), "sets")
            more = own.written(residue(rest, sets, percent), "more")
            if more.head(1):
                label = common.components(star.unionAll(more))
                own.tables.append(label)
        # Documents without shingles, however many, are not dealt by their common fingerprint.
        members = every.where("n > 0").select("id", "n", "f1", "f2").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).join(label.withColumnRenamed("node", "rep"), "rep", "left")
        found = members.select("id", "n", F.coalesce("component", "rep").alias("component_id")).unionAll(every.where("n = 0").select("id", "n", "id"))
        return common.written(found.select("id", F.col("n").alias("n_shingles"), "component_id", (F.col("component_id") == F.col("id")).alias("kept")), "duplicates")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id. Its other columns, whatever their names, stay too."""
    found = near_duplicates(docs)
    dropped = common.written(found.where("not kept").select(F.col("id").alias("__dropped")), "dropped")
    common.forget(found)
    return docs.join(common.small(dropped), F.col("doc_id") == F.col("__dropped"), "left_anti")


#: All pairs of documents that share a shingle, compared on their full sets.
SQL = rf"""
WITH RECURSIVE said AS (SELECT doc_id, regexp_extract_all({common.LOWER_SQL}, '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i+4], ' ')) END) AS own FROM said),
members AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(own), chr(10)))) AS rep FROM sets WHERE len(own) > 0),
shingles AS MATERIALIZED (SELECT m.rep, len(s.own) AS n, unnest(list_transform(s.own, lambda x: hash(x))) AS shingle FROM members m JOIN sets s USING (doc_id) WHERE m.rep = m.doc_id),
links(a, b) AS MATERIALIZED (SELECT x.rep, y.rep FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.rep < y.rep
         GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
         UNION SELECT rep, doc_id FROM members WHERE rep <> doc_id),
{common.COMPONENTS_SQL}
SELECT s.doc_id, len(s.own) AS n_shingles, coalesce(f.component, s.doc_id) AS component_id, coalesce(f.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN found f ON s.doc_id = f.node
"""
