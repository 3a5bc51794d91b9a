"""Token ids in files: one id array over all documents, its document boundaries Elias-Fano coded."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, new_path, pieces, texts
from .vocab import json_vocabulary

#: A block of the id array is closed at so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: One position is kept for so many ones of the upper bits.
HINT = 256

BLOCK = "shard int,in_shard long,first_doc long,n_docs long,n_ids long,n_null long,width int,ids binary,ends binary,doc_ids binary"


class EliasFano:
    """A sequence of n integers from 0 that never falls, in about 2 + log2(max / n) bits each.

    The low bits lie side by side; the high bits are unary: the i-th number sets bit (high + i). ``select``
    finds the i-th set bit from a kept position nearby; ``at_most`` counts the numbers up to a bound.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, hints: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.hints = n, low_bits, low, high, hints

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits((v[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::HINT].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.hints.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b = np.frombuffer(data, "<u4", 4).tolist()
        return cls(n, bits, np.frombuffer(data, np.uint8, a, 16), np.frombuffer(data, np.uint8, b, 16 + a), np.frombuffer(data, "<u4", offset=16 + a + b))

    def _low(self, i: int) -> int:
        at, out = i * self.low_bits, 0
        for k in range(self.low_bits):
            out |= (int(self.low[at + k >> 3]) >> (at + k & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """The i-th number, without the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.hints[i // HINT]), i % HINT
        byte = at >> 3
        bits = int(self.high[byte]) & (0xFF << (at & 7) & 0xFF)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return (byte * 8 + (bits & -bits).bit_length() - 1 - i << self.low_bits) | self._low(i)

    def at_most(self, bound: int) -> int:
        """How many numbers are ``bound`` or less: the document that holds a position, by binary search over select."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.select(mid) <= bound else (lo, mid)
        return lo

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        out = ones - np.arange(self.n, dtype=np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, -1).astype(np.uint64)
            out |= (low << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out


def _blocks(path: str, end_id: int, width: int, block_ids: int):
    code = "H" if width == 2 else "I"
    schema = arrow_schema(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = json_vocabulary(path, code)
        end = array(code, [end_id]).tobytes()
        shard, before = TaskContext.get().partitionId(), 0
        docs: list = []
        ids: list[bytes] = []
        held = 0

        def flush():
            nonlocal before, held
            known = [d for d in docs if d is not None]
            ends = np.cumsum([len(x) // width for x in ids])
            row = [shard, before, known[0] if known else None, len(docs), int(ends[-1]), len(docs) - len(known), width, b"".join(ids)]
            first = known[0] if known else 0
            row += [EliasFano.of(ends).to_bytes(), EliasFano.of(np.array([d - first for d in known], np.uint64)).to_bytes()]
            before += int(ends[-1])
            docs.clear()
            ids.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema, strict=True)], schema=schema)

        for batch in pieces(batches):
            for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                got = vocabulary.encode(t) + end
                if docs and held + len(got) // width > block_ids:
                    yield flush()
                docs.append(d)
                ids.append(got)
                held += len(got) // width
        if docs:
            yield flush()

    return run


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes of an id: two where the vocabulary and the end id allow it, else four."""
    from tokenizers import Tokenizer

    top = max([end_id, *Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()])
    return 2 if top < 1 << 16 else 4


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, *, width: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write the ids of all documents, in ascending doc_id order, to files at ``path``.

    The texts are range-partitioned by doc_id and sorted, so a task writes one stretch of the id array as
    blocks: rows of Parquet with the ids as little-endian integers of ``width`` bytes (None: as the vocabulary needs), and the document
    ends and ids Elias-Fano coded. Spark's commit protocol publishes whole files only, so lost executors
    and repeated tasks leave nothing behind. Boundaries can be read without the ids (column pruning).

    A null text is empty and holds the end id alone. Rows with one doc_id stand side by side, ordered by
    text. A null doc_id comes first. An empty table gives an empty store. Columns other than doc_id and text don't matter.
    """
    width = width or id_width(tokenizer_path, end_id)
    ranged = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = ranged.mapInArrow(_blocks(tokenizer_path, end_id, width, block_ids), BLOCK)
    blocks.write.option("parquet.block.size", 16 << 20).parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("doc_id long,start long,n_tokens long,ids binary")
    for batch in batches:
        for row in batch.to_pylist():
            ends = EliasFano.from_bytes(row["ends"]).all().astype(np.int64)
            known = EliasFano.from_bytes(row["doc_ids"]).all().astype(np.int64) + (row["first_doc"] or 0)
            ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4").astype("<u4")
            starts = np.concatenate([[0], ends[:-1]])
            doc_ids = [None] * row["n_null"] + known.tolist()
            for at in range(0, len(ends), 4096):
                s, e = starts[at : at + 4096], ends[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[at : at + 4096], pa.int64()), pa.array(s + row["before"]), pa.array(e - s), pa.array([ids[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())], schema=schema
                )


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a store with ``before``, the number of ids in front of each.

    The driver sums one number for each task of the writer (never documents) and sends these sums back: as
    many rows as the writer had tasks, which Spark's scheduler bounds. Within a shard, blocks know their place.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    before, rows = 0, []
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        rows.append((r["shard"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "shard int, shard_start long")
    return blocks.join(F.broadcast(starts), "shard").withColumn("before", F.col("shard_start") + F.col("in_shard"))


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    return _placed(spark, path).select("before", "first_doc", "n_null", "width", "ids", "ends", "doc_ids").mapInArrow(_documents, "doc_id long,start long,n_tokens long,ids binary")


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("position long,doc_id long,start long,n_tokens long")
    for batch in batches:
        out, last, ends, known = [], None, None, None
        for r in batch.to_pylist():
            if r["before"] != last:
                last, ends, known = r["before"], EliasFano.from_bytes(r["ends"]), EliasFano.from_bytes(r["doc_ids"])
            i = ends.at_most(r["position"] - last)
            start = ends.select(i - 1) if i else 0
            doc = None if i < r["n_null"] else known.select(i - r["n_null"]) + (r["first_doc"] or 0)
            out.append((r["position"], doc, start + last, ends.select(i) - start))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], schema=schema)


def locate(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """For each ``position`` in the id array the document that holds it: position, doc_id, start, n_tokens. Positions beyond the end give no row.

    Ids aren't read, and of a block's boundaries only those that a search touches are decoded (``at_most`` and ``select``). Positions meet
    blocks by equal stretches of the array, so neither side is collected.
    """
    blocks = _placed(spark, path).select("before", "n_ids", "first_doc", "n_null", "ends", "doc_ids")
    slot = lambda c: F.floor(c / BLOCK_IDS).cast("long")
    spread = blocks.withColumn("slot", F.explode(F.sequence(slot(F.col("before")), slot(F.col("before") + F.col("n_ids") - 1))))
    asked = positions.select("position").withColumn("slot", slot(F.col("position")))
    met = asked.join(spread, "slot").where((F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("n_ids")))
    return met.select("position", "before", "first_doc", "n_null", "ends", "doc_ids").mapInArrow(_located, "position long,doc_id long,start long,n_tokens long")


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int, *, width: int | None = None) -> DataFrame:
    """Write a store in the shared folder and read it back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_store(docs, path, tokenizer_path, end_id, width=width)
    return read_token_store(docs.sparkSession, path)
