"""Byte-level BPE over rank files, with a hierarchical-bitmap rank queue.

A text is split by the vocabulary's pattern; each piece starts as single bytes in
a linked list.  Every adjacent pair whose joined bytes have a rank lies in that
rank's bucket of list positions (one position, or a heap of several), and a bitmap
of two levels marks the ranks whose buckets hold something: a bit per rank in
words of 256, a bit per word above.  Find-first-set from the top level down gives
the lowest rank, its bucket the leftmost position.  Entries that no longer match
(the pair was joined or changed) are skipped when they are met.  A piece of n
bytes takes O(n log n) at worst, so very long pieces are no special case.

Pieces seen before are kept, as little-endian uint32 bytes, in a memory of at
most ``MOST_PIECES`` per worker; when that is full, the half met first (the frequent
ones) stays.  Decoding joins the bytes of the ids.

Defined results: null or empty texts have no ids; null ids are carried; equal ranks are
taken from the left; texts of any length are encoded whole; equal rows get equal results;
an empty table gives no rows.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paritas.llm.common import arrow_schema, batches_out, small_batches, text_batches

#: Pieces kept per Python worker (about 200 bytes each), and the longest one kept.
MOST_PIECES, LONGEST_KEPT = 1_000_000, 64
BIT = [1 << i for i in range(256)]
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBPE(dict):
    """Maps a piece of text to its ids' bytes; missing pieces are encoded and kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n == 2:
            return [self.ranks[piece[:1]], self.ranks[piece[1:]]]
        get, words, top, buckets = self.ranks.get, self.words, 0, {}
        enter = buckets.setdefault
        after = list(range(1, n + 1))  # start of the next symbol; a symbol at i is piece[i:after[i]]
        before = list(range(-1, n - 1))
        pair = [get(piece[i : i + 2]) for i in range(n - 1)]  # rank of the symbol at i with the next
        pair.append(None)
        fresh = [(r, i) for i, r in enumerate(pair) if r is not None]
        while True:
            for rank, at in fresh:
                held = enter(rank, at)
                if held == at:
                    word = rank >> 8
                    words[word] |= BIT[rank & 255]
                    top |= 1 << word
                elif type(held) is list:
                    heappush(held, at)
                else:
                    buckets[rank] = [held, at] if held < at else [at, held]
            if not top:
                break
            fresh = []
            word = (top & -top).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = (word << 8) + low.bit_length() - 1
            i = buckets[rank]
            if type(i) is list and len(i) > 1:
                i = heappop(i)
            else:
                if type(i) is list:
                    i = i[0]
                del buckets[rank]
                words[word] = bits = bits ^ low
                if not bits:
                    top ^= 1 << word
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            pair[j] = pair[i] = None
            if end < n:
                before[end] = i
                new = get(piece[i : after[end]])
                if new is not None:
                    pair[i] = new
                    fresh.append((new, i))
            h = before[i]
            if h >= 0:
                new = pair[h] = get(piece[h:end])
                if new is not None:
                    fresh.append((new, h))
        out = []
        i = 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece.encode())).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_PIECES:
                first = list(islice(self.items(), MOST_PIECES // 2))
                self.clear()
                self.update(first)
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian uint32 bytes."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """This worker's encoder for a rank file (lines of base64 bytes and rank)."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = ByteBPE(ranks, pattern)
    return _loaded[path, pattern]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, digest both; null texts are empty, null ids are carried."""
    small_batches(docs.sparkSession)
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        for batch in batches:
            for rows, texts in text_batches(batch, "__text"):
                n, first, second = [], [], []
                for text in texts:
                    ids = bpe.encode(text)
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield batches_out({"doc_id": rows.column("__id"), "n_tokens": n, "ids_sha256": first, "decoded_sha256": second}, schema)

    return docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text")).mapInArrow(run, SCHEMA)
