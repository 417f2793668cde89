"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list. Each adjacent pair that is a vocabulary
entry waits in the bucket of its rank; a three-level bitmap of 64-bit words says which
buckets hold anything, so that "lowest rank" is three find-first-set steps. A bucket is
worked from its leftmost position on; an entry whose pair has changed since is stale and
is skipped. Every merge costs a constant number of queue steps, so a pre-token of n bytes
takes O(n log n) however long it is, and many pre-tokens share one queue run.

Defined results: a null or empty text has no ids; decoding returns the text's bytes
exactly. The vocabulary file is a parameter; ids are its ranks. Repeated rows get equal
results; other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewise.llm.common import texts_of

#: Pre-tokens kept with their ids in a task; the store is emptied when it is full.
MEMO_ENTRIES = 400_000
MEMO_CHARS = 48
#: Characters of text encoded side by side.
CHUNK = 1 << 20


class RankQueue:
    """Buckets of positions by rank, and a bitmap over the ranks in use.

    ``low`` has a bit for every rank, ``middle`` one for every word of ``low`` that is
    not zero, ``top`` one for every word of ``middle``.
    """

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        words = (ranks + 63) // 64
        self.low = [0] * words
        self.middle = [0] * ((words + 63) // 64)
        self.top = 0

    def open(self, rank: int, positions: list[int]) -> None:
        """Starts the bucket of a rank that has none."""
        self.buckets[rank] = positions
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def take(self) -> tuple[int, list[int]]:
        """The smallest rank and its bucket, which leaves the queue; rank -1 when it is empty."""
        if not self.top:
            return -1, []
        group = (self.top & -self.top).bit_length() - 1
        bits = self.middle[group]
        word = (group << 6) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        self.low[word] = bits & (bits - 1)
        if not self.low[word]:
            self.middle[group] &= ~(1 << (word & 63))
            if not self.middle[group]:
                self.top &= ~(1 << group)
        return rank, self.buckets.pop(rank)


class Codec:
    """Encoder and decoder of one vocabulary of (bytes, rank) with one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs = np.full(1 << 16, -1, np.int32)
        for piece, rank in ranks.items():
            if len(piece) == 2:
                self.pairs[piece[0] << 8 | piece[1]] = rank

    @classmethod
    def load(cls, path: str, pattern: str) -> "Codec":
        with open(path, "rb") as f:
            rows = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in rows}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of non-empty pre-tokens, merged side by side in one queue run.

        Pre-tokens never touch, so the lowest rank of all is the lowest of its own. A
        bucket is worked from left to right; when a merge makes a pair of a lower rank,
        the rest of the bucket goes back and that rank comes first.
        """
        text = b"".join(pieces)
        n = len(text)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(size) - size
        data = np.frombuffer(text, np.uint8).astype(np.int32)
        first = np.full(n, -1, np.int32)
        first[:-1] = self.pairs[data[:-1] << 8 | data[1:]]
        first[starts[1:] - 1] = -1
        back = np.arange(-1, n, dtype=np.int32)
        back[starts], back[n] = -1, -1
        end = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())  # where the part that starts here ends, which is the next part
        before = array("i", back.tobytes())  # the part before, -1 at the start of a pre-token
        waiting = array("i", first.tobytes())  # rank of the pair that starts here, -1: no merge
        queue, get = self.queue, self.ranks.get
        buckets, put = queue.buckets, queue.open
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0):]
        cuts = np.flatnonzero(np.diff(first[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            put(int(first[order[a]]), order[a:b].tolist())
        while True:
            rank, bucket = queue.take()
            if rank < 0:
                break
            bucket.sort()
            for at, i in enumerate(bucket):
                if waiting[i] != rank:
                    continue  # stale
                lower = False
                j = end[i]
                stop = end[i] = end[j]
                waiting[j] = -1
                new = -1
                if before[stop] >= 0:
                    before[stop] = i
                    new = get(text[i:end[stop]], -1)
                    if new >= 0:
                        if (held := buckets.get(new)) is None:
                            put(new, [i])
                        else:
                            held.append(i)
                        lower = new < rank
                waiting[i] = new
                k = before[i]
                if k >= 0:
                    new = get(text[k:stop], -1)
                    waiting[k] = new
                    if new >= 0:
                        if (held := buckets.get(new)) is None:
                            put(new, [k])
                        else:
                            held.append(k)
                        lower = lower or new < rank
                if lower and at + 1 < len(bucket):
                    put(rank, bucket[at + 1:])
                    break
        out, ranks = [], self.ranks
        for start, stop in zip(starts.tolist(), (starts + size).tolist(), strict=True):
            ids = []
            while start < stop:
                j = end[start]
                ids.append(ranks[text[start:j]])
                start = j
            out.append(tuple(ids))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts: each match of the pattern on its own, no special tokens."""
        out: list[list[int]] = []
        for chunk in _chunks(texts):
            found = [self.split(t) for t in chunk]
            memo = self.memo
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            fresh = dict.fromkeys(chain.from_iterable(found))
            known: dict[str, tuple[int, ...]] = {}
            queued, whole = [], self.ranks.get
            for piece in fresh:
                ids = memo.get(piece)
                if ids is None:
                    data = piece.encode()
                    rank = whole(data)
                    if rank is None:
                        queued.append((piece, data))
                        continue
                    ids = (rank,)
                known[piece] = ids
            if queued:
                known |= zip((p for p, _ in queued), self.encode_pieces([d for _, d in queued]), strict=True)
            memo.update((p, i) for p, i in known.items() if len(p) <= MEMO_CHARS)
            out += [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in found]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``CHUNK`` characters."""
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


@contextmanager
def uncollected() -> Iterator[None]:
    """No cycle collection meanwhile: ids and pieces form no cycles, but each run would walk all of them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the array of token ids; a column of that name is replaced.

    A null text is the empty text and has no ids; an empty table gives an empty one.
    """
    docs = docs.drop(ids)
    at = docs.columns.index(text)
    names = [*docs.columns, ids]
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, pattern)
        for batch in batches:
            for part in _small(batch, at):
                with uncollected():
                    rows = codec.encode(texts_of(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.int32()))], names)

    return docs.mapInArrow(step, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for; a null array has none."""
    at = tokens.columns.index(ids)
    names = [*tokens.columns, out]
    schema = T.StructType([*tokens.schema.fields, T.StructField(out, T.BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, "")
        for batch in batches:
            rows = [codec.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names)

    return tokens.mapInArrow(step, schema)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to.

    Both directions run in one pass, so that ids need not leave the task.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, pattern)
        decimal = {rank: str(rank) for rank in codec.pieces}
        for batch in batches:
            n, coded, decoded = [], [], []
            with uncollected():
                for ids in chain.from_iterable(codec.encode(c) for c in _chunks(texts_of(batch.column(1)))):
                    n.append(len(ids))
                    coded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(step, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _small(batch: pa.RecordBatch, at: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes of text (one text at least), so that few ids are held at once."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        held += n or 0
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
