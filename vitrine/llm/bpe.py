"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Each partition keeps a table of the pieces (words) it has met. Pieces not yet met are encoded together with a
pair occurrence index: every mergeable pair maps to all its positions in all those pieces; ranks are applied in
ascending order, each to all its positions at once, and only the lists of the neighbours change. Texts are
then a gather over the table. Texts are whole; a null or empty text has an empty list of ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Pieces kept by a Python worker; beyond it the table starts anew, so memory stays bounded.
TABLE_PIECES = 400_000
#: Characters taken at once of a batch.
CHUNK_CHARS = 8_000_000


class PairIndexBPE:
    """Encoder over ranks (bytes -> id, lower ranks merge first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text_of = {i: b for b, i in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self._merged: dict[int, int] = {}

    def merged(self, a: int, b: int) -> int:
        """Id of the token that a pair merges into, or -1."""
        key = (a << 32) | b
        got = self._merged.get(key)
        if got is None:
            got = self._merged[key] = self.ranks.get(self.text_of[a] + self.text_of[b], -1)
        return got

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; pieces don't influence each other."""
        ranks, byte, merged = self.ranks, self.byte, self.merged
        out: list = [None] * len(pieces)
        sym: list[int] = []
        prev: list[int] = []
        nxt: list[int] = []
        owner: list[int] = []
        starts: list[tuple[int, int]] = []
        where: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = ranks.get(p)
            if whole is not None:
                out[k] = [whole]
                continue
            n, at = len(p), len(sym)
            ids = [byte[c] for c in p]
            sym += ids
            prev.append(-1)
            prev += range(at, at + n - 1)
            nxt += range(at + 1, at + n)
            nxt.append(-1)
            owner += [k] * n
            starts.append((k, at))
            for i in range(n - 1):
                r = merged(ids[i], ids[i + 1])
                if r >= 0:
                    where.setdefault(r, []).append(at + i)
        heap = list(where)
        heapq.heapify(heap)
        irregular: set[int] = set()
        while heap:
            rank = heapq.heappop(heap)
            spots = where.pop(rank, None)
            if spots is None:
                continue
            spots.sort()
            for i in spots:
                j = nxt[i]
                if sym[i] < 0 or j < 0 or merged(sym[i], sym[j]) != rank:
                    continue
                sym[i], sym[j] = rank, -1
                after = nxt[i] = nxt[j]
                if after >= 0:
                    prev[after] = i
                    r = merged(rank, sym[after])
                    if r >= 0:
                        if r < rank:
                            irregular.add(owner[i])
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(heap, r)
                before = prev[i]
                if before >= 0:
                    r = merged(sym[before], rank)
                    if r >= 0:
                        if r < rank:
                            irregular.add(owner[i])
                        if r in where:
                            where[r].append(before)
                        else:
                            where[r] = [before]
                            heapq.heappush(heap, r)
        for k, at in starts:
            if k in irregular:  # a later pair outranks the one being applied: order within the piece matters
                out[k] = self._one_by_one(pieces[k])
                continue
            ids = []
            while at >= 0:
                ids.append(sym[at])
                at = nxt[at]
            out[k] = ids
        return out

    def _one_by_one(self, piece: bytes) -> list[int]:
        ids = [self.byte[c] for c in piece]
        while len(ids) > 1:
            best = min(((r, i) for i in range(len(ids) - 1) if (r := self.merged(ids[i], ids[i + 1])) >= 0), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.text_of[i] for i in ids)


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class CorpusEncoder:
    """Encodes texts with a table of pieces that grows as texts come."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        self.bpe = PairIndexBPE(parse_ranks(data))
        self.split = regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)

    def _learn(self, fresh: list[str]) -> None:
        coded = self.bpe.encode_pieces([w.encode("utf-8", "surrogatepass") for w in fresh])
        sizes = np.fromiter((len(c) for c in coded), np.int32, len(coded))
        first, total = len(self.number) - len(fresh), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.number) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + total] = np.fromiter((i for c in coded for i in c), np.int32, total)
        self.start[first : first + len(fresh)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(fresh)] = sizes
        self.used += total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        if len(self.number) > TABLE_PIECES:
            self._clear()
        number, split = self.number, self.split
        known = len(number)
        seq: list[int] = []
        ends = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                seq += [number.setdefault(w, len(number)) for w in split(t)]
            ends[k] = len(seq)
        if len(number) > known:
            self._learn(list(number)[known:])
        words = np.array(seq, np.int64)
        sizes = self.size[words].astype(np.int64)
        stop = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(stop[-1]) + np.repeat(self.start[words] - stop[:-1], sizes)
        counts = np.diff(np.concatenate([[0], stop[ends]]))
        return self.flat[take], counts


@lru_cache(2)
def _encoder(data: bytes, pattern: str) -> CorpusEncoder:
    return CorpusEncoder(data, pattern)


def path_of(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers as P

    return P.path(name)


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """Bytes of a rank file and the pattern that splits texts into pieces; by default byte_bpe_50k."""
    import public_tokenizers as P

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), P.PATTERN


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t or "")
        if chars >= CHUNK_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, sizes_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ids array<int>), or (key, n_tokens) with ``sizes_only``, plus the columns named in ``keep``.

    One row for each document, null keys included; nothing is shuffled. The vocabulary (under a megabyte, fixed) is
    broadcast.
    """
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path))
    types = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(*shared.value)
        for b in batches:
            at = 0
            for part in _chunks(b.column(text).to_pylist()):
                ids, counts = enc.encode(part)
                if sizes_only:
                    result = pa.array(counts.astype(np.int32))
                else:
                    result = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                rest = [b.column(c).slice(at, len(part)) for c in (key, *keep)]
                yield pa.RecordBatch.from_arrays([*rest, result], [key, *keep, "n_tokens" if sizes_only else "ids"])
                at += len(part)

    schema = ", ".join(f"`{c}` {types[c]}" for c in (key, *keep)) + (", n_tokens int" if sizes_only else ", ids array<int>")
    return documents.select(key, *keep, text).mapInArrow(run, schema)
