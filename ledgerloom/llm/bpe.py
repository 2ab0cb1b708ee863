"""Byte-level BPE, encoded with a rank queue over a hierarchical bitmap.

A pre-token's adjacent byte pairs stand in buckets, one per merge rank. A three-level bitmap tells which buckets hold
anything, so the lowest rank is found by three find-first-set steps however many ranks there are. Symbols form a linked
list; a merge changes at most two pairs, whose old bucket entries are left to go stale and are skipped when met. A
pre-token of n bytes takes O(n log n) time, so runs of 100,000 bytes without a break are no special case.

Spark deals the rows; each task encodes whole texts, batch by batch, and keeps a bounded memo of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

_LEVEL = 64
_BIT = [1 << i for i in range(_LEVEL)]


class RankQueue:
    """Positions by merge rank; :meth:`lowest` gives the lowest rank that has any, or -1."""

    def __init__(self, n_ranks: int) -> None:
        n0 = -(-n_ranks // _LEVEL)
        n1 = -(-n0 // _LEVEL)
        self.leaf, self.middle, self.top = [0] * n0, [0] * n1, 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        i = rank >> 6
        x = self.leaf[i]
        self.leaf[i] = x | _BIT[rank & 63]
        if not x:  # the levels above change only with a leaf's first bit
            j = i >> 6
            self.middle[j] |= _BIT[i & 63]
            self.top |= _BIT[j]

    def lowest(self) -> int:
        if not self.top:
            return -1
        j = (self.top & -self.top).bit_length() - 1
        m = self.middle[j]
        i = (j << 6) | ((m & -m).bit_length() - 1)
        x = self.leaf[i]
        return (i << 6) | ((x & -x).bit_length() - 1)

    def pop(self, rank: int) -> int:
        """The leftmost position of a rank; clears the bits of a bucket that empties."""
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return heapq.heappop(bucket)
        del self.buckets[rank]
        i = rank >> 6
        self.leaf[i] = x = self.leaf[i] ^ _BIT[rank & 63]
        if not x:
            j = i >> 6
            self.middle[j] = m = self.middle[j] ^ _BIT[i & 63]
            if not m:
                self.top ^= _BIT[j]
        return bucket[0]


class Codec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_chars: int = 5_000_000) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        n = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(n)]
        self.queue, self.memo_chars, self.held = RankQueue(n), memo_chars, 0
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}  # the memo before the last: what is still in use moves on from it

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        rank_of, queue, n = self.ranks.get, self.queue, len(piece)
        push, pop, lowest = queue.push, queue.pop, queue.lowest
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [*map(rank_of, [piece[i : i + 2] for i in range(n - 1)]), None]
        for i, r in enumerate(pair):
            if r is not None:
                push(r, i)
        while (r := lowest()) >= 0:
            i = pop(r)
            if pair[i] != r:
                continue  # stale: the pair at this place has changed
            j = after[i]
            part[i] = here = part[i] + part[j]
            part[j] = pair[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair[i] = r = rank_of(here + part[k])
                if r is not None:
                    push(r, i)
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                r = rank_of(part[h] + here)
                if r != pair[h]:
                    pair[h] = r
                    if r is not None:
                        push(r, h)
        ranks = self.ranks
        return tuple(ranks[x] for x in part if x is not None)

    def encode(self, text: str) -> list[int]:
        memo, pieces = self.memo, self.find(text)
        for p in set(pieces).difference(memo):
            memo[p] = self.old.get(p) or self.merge(p.encode())
            self.held += len(p)
        ids = list(chain.from_iterable(map(memo.__getitem__, pieces)))
        if self.held > self.memo_chars:
            self.old, self.memo, self.held = memo, {}, 0
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec per worker process and table."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(data), pattern)
    return _codecs[key]


def _map(df: DataFrame, source: str, out: T.StructType, ranks_path: str, pattern: str, keep: list[str] | None, each) -> DataFrame:
    """``each(codec, value)`` for column ``source`` of every row, its tuple put beside a struct of the kept columns."""
    small_batches(df.sparkSession)
    with open(ranks_path, "rb") as f:  # a vocabulary: 50,000 lines, however many rows there are
        table = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.struct(*(["*"] if keep is None else keep)).alias("row"), F.col(source).alias("value"))
    types = T.StructType([rows.schema["row"], *out.fields])
    arrow = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.string() for f in out.fields]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(table.value, pattern)
        for part in parts:
            for lo in range(0, part.num_rows, 256):  # so a batch of long texts stays small
                cut = part.slice(lo, 256)
                made = [each(codec, v.as_py()) for v in cut.column(1)]
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([cut.column(0), *columns], ["row", *out.names])

    return rows.mapInArrow(batches, types)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the columns in ``keep``, all if None) and ``ids`` (array of int) for every row.

    A null or empty text has an empty array. Special-token strings are ordinary text. Repeated rows are encoded each by
    itself; an empty table gives an empty result.
    """
    out = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _map(df, text_col, out, ranks_path, pattern, keep, lambda codec, text: (codec.encode(text or ""),))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``data`` (the decoded bytes) for every row; a null array gives no bytes."""
    out = T.StructType([T.StructField("data", T.BinaryType())])
    return _map(df, ids_col, out, ranks_path, pattern, keep, lambda codec, ids: (codec.decode(ids or ()),))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encodes, then decodes the ids, in one pass.

    The digests spare the job from writing ids twice the size of the text. Nulls count as empty texts.
    """

    out = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _map(df, text_col, out, ranks_path, pattern, keep, lambda codec, text: _digest(codec, codec.encode(text or "")))


def encoded_and_checked(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As :func:`round_trip`, with the ids themselves beside the digests."""

    def each(codec: Codec, text: str | None) -> tuple:
        ids = codec.encode(text or "")
        return (*_digest(codec, ids), ids)

    out = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _map(df, text_col, out, ranks_path, pattern, keep, each)


def _digest(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    listed = " ".join(map(codec.names.__getitem__, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def bpe_digest(docs: DataFrame) -> DataFrame:
    """The query's columns. The text does not come back from the workers."""
    import public_tokenizers

    done = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
