"""Packing documents into token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_schema, pieces, texts
from .vocab import json_vocabulary

#: Tokens of a window that a group leaves free on average, so that differencing, which doesn't balance to the token, seldom needs another window.
SLACK = 8
#: Windows in a group of pieces that are packed together.
WINDOWS = 48
#: Times that pieces are cut before another window is taken.
ROUNDS = 12
#: Words that a worker remembers, at about 200 bytes each: with 2 workers and a JVM of 1,800 MB beside them, an executor stays below 3,000 MB. Fewer take more time, and leave memory where other stages keep theirs.
MEMO = 500_000

PIECE = "doc_id long,start long,length long,ids binary,doc_tokens long,sequence_id long,offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The indices of ``sizes`` in k windows with near-equal sums.

    A partial partition is k sums, less their minimum, largest first, and what is in each. The two with the
    largest imbalances are merged, the largest window of one with the smallest of the other, until one is left.
    """
    heap: list = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [size] + [0] * (k - 1), [i] + [None] * (k - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, had = heapq.heappop(heap)
        _, i, b, has = heap[0]
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        held = [y if x is None else x if y is None else (x, y) for x, y in zip(had, reversed(has), strict=True)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        least = sums[order[-1]]
        heapq.heapreplace(heap, (least - sums[order[0]], i, [sums[j] - least for j in order], [held[j] for j in order]))
    out = []
    for nest in heap[0][3] if heap else [None] * k:
        flat, todo = [], [nest]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(reversed(x))
            elif x is not None:
                flat.append(x)
        out.append(sorted(flat))
    return out


def windows(sizes: list[int], capacity: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """Pieces (item, start, size) of the items, and the pieces of each of near-equal windows of at most ``capacity``.

    Items stay whole where they fit. Differencing spreads them over the least possible number of windows; what a window then has too much is cut off its
    largest piece, and all pieces are spread anew. Where ``ROUNDS`` of this don't bring every window to its capacity, there is one window more.
    """
    pieces_ = [(i, 0, size) for i, size in enumerate(sizes)]
    k = max(1, -(-sum(sizes) // capacity))
    rounds = 0
    while True:
        parts = differencing([size for _, _, size in pieces_], k)
        over = [(sum(pieces_[i][2] for i in p) - capacity, p) for p in parts]
        over = [(e, p) for e, p in over if e > 0]
        if not over:
            return pieces_, [p for p in parts if p]
        rounds += 1
        if rounds % ROUNDS == 0:
            k += 1
            continue
        for excess, p in over:
            i = max(p, key=lambda j: pieces_[j][2])
            item, start, size = pieces_[i]
            left = size - excess if excess < size else size - size // 2
            if left < size:
                pieces_[i] = item, start, left
                pieces_.append((item, start + left, size - left))


def _packer(path: str, end_id: int, capacity: int, per_group: int, slack: int, memo: int):
    schema = arrow_schema(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = json_vocabulary(path, memo=memo)
        end = array("I", [end_id]).tobytes()
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        open_: list[tuple] = []
        held = 0
        full = per_group * (capacity - slack)

        def close():
            nonlocal sequence, held
            cut, parts = windows([p[2] for p in open_], capacity)
            for w in parts:
                at = 0
                for i, start, size in map(cut.__getitem__, w):
                    d, first, _, ids, n = open_[i]
                    rows.append((d, first + start, size, ids[4 * start : 4 * (start + size)], n, sequence, at))
                    at += size
                sequence += 1
            open_.clear()
            held = 0

        def record():
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in pieces(batches):
            for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = vocabulary.encode(t) + end
                n, at = len(ids) // 4, 0
                while n - at >= capacity:
                    rows.append((d, at, capacity, ids[4 * at : 4 * (at + capacity)], n, sequence, 0))
                    sequence += 1
                    at += capacity
                while at < n:
                    size = min(n - at, full - held)
                    open_.append((d, at, size, ids[4 * at : 4 * (at + size)], n))
                    at += size
                    held += size
                    if held == full:
                        close()
            if len(rows) > 2000:
                yield record()
        if open_:
            close()
        if rows:
            yield record()

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, capacity: int = 1024, per_group: int = WINDOWS, slack: int = SLACK, memo: int = MEMO) -> DataFrame:
    """Cut every document into pieces and put these in sequences of at most ``capacity`` tokens.

    Whole windows of a document are sequences by themselves. The rests of documents are packed by differencing in groups
    as full as ``per_group`` windows less ``slack`` tokens each; only what can't fit whole is cut: at a window's capacity, and at the end of a group. Groups form as a task reads its rows: no shuffle, and a group has a fixed size
    whatever the corpus. A task repeated after a loss reads the same rows and makes the same sequences.

    Returns a row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. A null or empty text is the end id alone. Repeated rows are packed each. An empty
    table gives no rows. Columns other than doc_id and text don't matter.
    """
    return texts(docs).mapInArrow(_packer(tokenizer_path, end_id, capacity, per_group, slack, memo), PIECE)
