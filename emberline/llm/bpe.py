"""Byte-level BPE of whole texts with a public vocabulary, and back.

A text is cut into pieces by the vocabulary's pattern. Within a piece, a priority queue holds
the mergeable neighbours by rank over a doubly linked list of symbols; a popped pair whose
symbols have changed since is stale and skipped. This is O(n log n) even for a piece of a
hundred thousand equal characters. Since pieces never reach across a space that is followed
by a non-space character, ids are remembered for such chunks of text, in a bounded cache.
"""

from __future__ import annotations

import array
import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Entries of each cache of a worker; a full cache starts anew.
CACHE = 150_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id, which is the merge rank as well."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Odd(Exception):
    """A chunk that doesn't start with a non-space character."""


class _Chunks(dict):
    """Ids of chunks of text; `lead` is put before a chunk that is not yet known."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if not chunk or chunk[0].isspace():
            raise _Odd
        if len(self) >= CACHE:
            self.clear()
        ids = tuple(self.encoder.by_pieces(self.lead + chunk))
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.find = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.first, self.later = _Chunks(self, ""), _Chunks(self, " ")

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        end = list(range(1, n + 1))  # end[s]: where the symbol that starts at s ends; 0: gone
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                if (r := ranks.get(piece[a : end[c]])) is not None:
                    heapq.heappush(heap, (r, a, c, end[c]))
            if (p := before[a]) >= 0 and (r := ranks.get(piece[p:c])) is not None:
                heapq.heappush(heap, (r, p, a, c))
        out, s = [], 0
        while s < n:
            out.append(ranks[piece[s : end[s]]])
            s = end[s]
        return tuple(out)

    def by_pieces(self, text: str) -> list[int]:
        known, out = self.pieces, []
        for p in self.find(text):
            ids = known.get(p)
            if ids is None:
                ids = self.merge(p.encode("utf-8", "surrogatepass"))
                if len(p) < 40:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a text in consecutive groups."""
        if not text:
            return []
        chunks = text.split(" ")
        try:
            if len(chunks) == 1:
                return [self.first[text]]
            later = self.later
            head = chunks[0]
            del chunks[0]
            return [self.first[head], *[later[c] for c in chunks]]
        except _Odd:
            return [tuple(self.by_pieces(text))]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text or "")))


def decode(ids: list[int], words: dict[int, bytes]) -> str:
    """The text of ids: their vocabulary strings put together."""
    return b"".join(map(words.__getitem__, ids)).decode("utf-8", "replace")


_READY: dict[str, Encoder] = {}


def _encoder(vocabulary: str, shared) -> Encoder:
    """A worker's encoder for the vocabulary; its caches live on from task to task."""
    if vocabulary not in _READY:
        _READY[vocabulary] = Encoder(shared.value)
    return _READY[vocabulary]


def _texts(column: pa.Array) -> Iterator[str | None]:
    for i in range(0, len(column), 512):
        yield from column[i : i + 512].to_pylist()


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of every text; result: `key`, ids (array<int>).

    The empty and the null text both have the empty list. Strings that look like special
    tokens are plain text; no special token is ever added. The vocabulary, of fixed size, is
    read once by the driver and broadcast; there is no shuffle and every text is encoded whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, shared)
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                ids, ends = array.array("i"), [0]
                for t in _texts(b.column(1)[lo : lo + 2_000]):
                    if t:
                        ids.extend(chain.from_iterable(enc.parts(t)))
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + 2_000], lists], names=[key, "ids"])
                lo += 2_000

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`df` without its text column and with n_tokens, the length of the text's ids."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, shared)
        for b in batches:
            counts = [sum(map(len, enc.parts(t))) if t else 0 for t in _texts(b.column(len(rest)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(counts, pa.int64())], names=[*[f.name for f in rest], "n_tokens"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "n_tokens bigint"])
    return df.select(*[f.name for f in rest], text).mapInArrow(run, schema)
