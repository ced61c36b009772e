"""Hierarchical multi-length packing of token sequences.

Documents are routed to window tiers (powers of two up to `window`): whole windows are cut off a document first, its
rest goes to the smallest tier that holds it. Each tier is packed first-fit; the gap that is left in a window is
then filled from the tiers below it, the longest piece that fits first, and what is still open is closed by cutting
the next shorter document. The few windows that stay open at the end of a partition are split into full windows of
smaller tiers, so that no sequence is padded. Step groups of `step_tokens` tokens hold sequences of one tier of a
partition, so that every group but a tier's last one there has equal work.

A partition is packed by itself: there is no shuffle, memory holds one block of rows, and a lost task is repeated
with the same result. sequence_id is the partition's number times 2^40 plus the sequence's number there;
step_group has the partition, the tier and the group's number there.

Edge cases. A null or empty text is its end token alone. A document longer than a window spans several; each of its
ids lies in exactly one piece. Repeated rows are packed again. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SMALLEST = 2048, 64
STEP_TOKENS = 1 << 17
#: Tokens that are held before they are packed; the pieces of a block share no window with another block's but for the open ones.
BLOCK_TOKENS = 1 << 21
END_ID = 1
#: Characters of a run of white space from which on a text is encoded by the JSON file.
LONG_RUN = 100_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"


def tokenizer(name: str = "byte_bpe_50k"):
    """An encoder of lists of texts to id arrays; the same ids as the JSON file gives in `tokenizers`, from its rank file."""
    import public_tokenizers as files
    import tiktoken
    import tokenizers

    with open(files.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = None

    def encode(text: str) -> list[int]:
        nonlocal other
        if len(text) < LONG_RUN or not _RUN.search(text):
            return own.encode_ordinary(text)
        if other is None:  # the rank file's matcher overflows its stack on such a run, the JSON file's does not
            other = tokenizers.Tokenizer.from_file(files.path(f"{name}.json"))
            other.encode_special_tokens = True
        return other.encode(text, add_special_tokens=False).ids

    return encode


class Packer:
    """Packs the pieces of one partition. A piece is (row, start, length); closed sequences come out of `done`."""

    def __init__(self, window: int = WINDOW, smallest: int = SMALLEST):
        self.window, self.tiers = window, [1 << k for k in range(smallest.bit_length() - 1, window.bit_length())]
        self.pools: dict[int, deque] = {t: deque() for t in self.tiers}
        self.done: list[tuple[int, list]] = []
        self.short = 0

    def route(self, row: int, length: int) -> None:
        start = 0
        while length - start >= self.window:
            self.done.append((self.window, [(row, start, self.window)]))
            start += self.window
        if rest := length - start:
            self.pools[next(t for t in self.tiers if t >= rest)].append((row, start, rest))

    def _fill(self, pieces: list, gap: int, below: int) -> int:
        """Fills a gap from the tiers up to `below`: whole pieces while they fit, then a cut."""
        for tier in reversed(self.tiers[: below + 1]):
            pool = self.pools[tier]
            while pool and gap >= pool[0][2]:
                pieces.append(pool.popleft())
                gap -= pieces[-1][2]
        for tier in self.tiers[: below + 1]:
            pool = self.pools[tier]
            if gap and pool:
                row, start, length = pool.popleft()
                pieces.append((row, start, gap))
                rest = length - gap
                self.pools[next(t for t in self.tiers if t >= rest)].appendleft((row, start + gap, rest))
                return 0
        return gap

    def pack(self) -> None:
        """Empties the pools into windows, the longest tier first."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[k]
            pool = self.pools[tier]
            while pool:
                pieces = [pool.popleft()]
                gap = self._fill(pieces, tier - pieces[0][2], k)
                if gap:
                    self._split(pieces)
                else:
                    self.done.append((tier, pieces))

    def _split(self, pieces: list) -> None:
        """An open window as full windows of powers of two."""
        queue, left = deque(pieces), sum(p[2] for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            out, need = [], size
            while need:
                row, start, length = queue.popleft()
                take = min(length, need)
                out.append((row, start, take))
                if take < length:
                    queue.appendleft((row, start + take, length - take))
                need -= take
            self.done.append((size, out))
            left -= size


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", encode=tokenizer, window: int = WINDOW, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row for each piece, as in SCHEMA; window is the sequence's tier, step_group names groups of one tier and at most step_tokens tokens."""
    if window & (window - 1) or window < SMALLEST:
        raise ValueError("window must be a power of two")

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part_id = encode(), TaskContext.get().partitionId()
        ids, tokens, have, number = [], [], 0, 0
        used: dict[int, int] = {}

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal ids, tokens, have, number
            packer = Packer(window)
            for row, t in enumerate(tokens):
                packer.route(row, len(t))
            packer.pack()
            columns: list[list] = [[] for _ in range(9)]
            for size, pieces in packer.done:
                place, group = 0, used.get(size, 0)
                used[size] = group + 1
                for row, start, length in pieces:
                    crc = zlib.crc32(tokens[row][start : start + length].tobytes())
                    values = (ids[row], start, length, crc, len(tokens[row]), (part_id << 40) + number, place, size, ((((part_id << 6) + size.bit_length()) << 32) + group // max(1, step_tokens // size)))
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    place += length
                number += 1
            ids, tokens, have = [], [], 0
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            for a in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000], pa.int64()) for c in columns], names)

        for part in parts:
            for i, t in zip(part.column(0).to_pylist(), (t.as_py() for t in part.column(1)), strict=True):
                ids.append(i)
                tokens.append(np.array([*own(t or ""), END_ID], "<u4"))
                have += len(tokens[-1])
                if have >= BLOCK_TOKENS:
                    yield from block()
        if tokens:
            yield from block()

    return common.mapped(docs.select(F.col(key).cast("long"), F.col(text).cast("string")), of, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as in SCHEMA: the last stage, so the documents' own columns end here."""
    return packed(docs)
