"""Byte-level BPE encoding over overlapping chunks, and decoding."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, arrow_schema, pieces, texts

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 32_768, 512
#: Pre-tokens that a worker remembers before it begins anew.
MEMO = 800_000
#: Bytes up to which a pre-token is merged without a heap.
SHORT = 32

ENCODED = "doc_id long,n_tokens long,ids binary,decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: its adjacent parts are merged, lowest rank first and leftmost among equals.

    Parts are a linked list and possible merges a heap, so a pre-token of n bytes takes n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= SHORT:
        return _merge_short(piece, ranks)
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by looking through all pairs each time, which is faster for few."""
    get, never = ranks.get, len(ranks) + (1 << 30)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) != never:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], never)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], never)
    return [ranks[p] for p in parts]


def split_chunks(text: str, pattern: regex.Pattern, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """What ``pattern.findall(text)`` gives, from chunks that are split one by one.

    Chunk k begins at k * size and reaches ``overlap`` characters into the next. Each is split by itself.
    Where a match of a chunk begins at a place at which a match of what came before begins too, both splits
    agree from there on, for the pattern looks ahead but never back: there they are stitched. The last two
    matches before a cut don't count, as the cut may have changed them. Where no common place is found
    (a pre-token longer than the overlap), the part before is read on over one chunk more, then two, four and so on.
    """
    if len(text) <= size + overlap:
        return pattern.findall(text)
    chunks = [_split(text, at, at + size + overlap, pattern) for at in range(0, len(text), size)]
    out: list[str] = []
    base, (starts, found), k, more = 0, chunks[0], 1, 1
    while k < len(chunks):
        common = _first_common(starts, chunks[k][0])
        if common:
            i, j = common
            out += found[:i]
            base, starts, found, more = starts[i], chunks[k][0][j:], chunks[k][1][j:], 1
            k += 1
        else:
            k = min(k + more, len(chunks))
            more *= 2
            starts, found = _split(text, base, k * size + overlap if k < len(chunks) else len(text), pattern)
    return out + found


def _split(text: str, begin: int, stop: int, pattern: regex.Pattern) -> tuple[list[int], list[str]]:
    """Starts and texts of the matches in a chunk, without the last two where the text goes on."""
    found = pattern.findall(text[begin:stop])
    starts, at = [], begin
    for x in found:
        starts.append(at)
        at += len(x)
    return (starts[:-2], found[:-2]) if stop < len(text) else (starts, found)


def _first_common(left: list[int], right: list[int]) -> tuple[int, int] | None:
    i = j = 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            return i, j
        if left[i] < right[j]:
            i += 1
        else:
            j += 1
    return None


class RankVocabulary:
    """Ids and bytes of a vocabulary of ranks; ``pattern`` splits a text before the merges."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.memo = Memo(self._ids, MEMO)

    def _ids(self, pre: str) -> bytes:
        return array("I", merge(pre.encode(), self.ranks)).tobytes()

    def encode(self, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, split_chunks(text, self.pattern, size, overlap)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I")))


@cache
def rank_vocabulary(path: str, pattern: str) -> RankVocabulary:
    return RankVocabulary(path, pattern)


def _encoder(path: str, pattern: str, size: int, overlap: int):
    schema = arrow_schema(ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_vocabulary(path, pattern)
        for batch in pieces(batches):
            ids = [vocabulary.encode(t, size, overlap) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(vocabulary.decode, ids), pa.binary())], schema=schema
            )

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode every text to ids, and decode the ids again.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes). A null or empty text has no
    ids. Special tokens have no meaning. Repeated rows give repeated results; an empty table gives no rows.
    Columns other than doc_id and text don't matter. One pass without a shuffle; a text of any length is
    split chunk by chunk, and a worker's memory of pre-tokens is bounded.
    """
    return texts(docs).mapInArrow(_encoder(ranks_path, pattern, chunk, overlap), ENCODED)
