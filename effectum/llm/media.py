"""Media columns: payloads in progressive JPEG files, and files as coefficient arrays and RGB tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import arrow_schema, bounded, materialise, pieces, texts

#: Bytes of text that are encoded, and of files that are decoded, at once.
ENCODE_BYTES, DECODE_BYTES = 3 << 19, 4 << 20
#: MCUs down, from which an image gets wider (the format ends at 65,535 pixels).
DOWN = 4000
#: The bytes that get small coefficients, the most frequent first; all others follow in order.
FREQUENT = b" \x00etaonirshldcumpbgfvwy.,\n'-xqkjzTIASEORNHL0123456789"

#: How tables are written: small row groups, so that a task holds little, and compressed for repeated headers.
STORED = {"parquet.block.size": 16 << 20, "compression": "zstd"}

MEDIA = "doc_id long,n_bytes long,media binary"
DECODED = "doc_id long,n_bytes long,payload binary,media binary,width int,height int,rgb binary,feature string"
PLANES = "doc_id long,n_bytes long,payload binary,media binary,width int,height int,green binary,cells binary,rest binary,feature string"


def _code() -> tuple[np.ndarray, np.ndarray]:
    """The coefficient of each byte, 0, 1, -1, 2, -2, ... in the order of frequency, and back (by coefficient + 128)."""
    order = list(dict.fromkeys([*FREQUENT, *range(256)]))
    value = np.zeros(256, np.int16)
    for rank, b in enumerate(order):
        value[b] = (rank + 1) // 2 * (1 if rank % 2 else -1)
    back = np.zeros(257, np.uint8)
    back[value.astype(int) + 128] = np.arange(256)
    return value, back


_VALUE, _BACK = _code()


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload, whose length must be a positive multiple of 64: 64 bytes are the coefficients of a block."""
    images, comments = [], []
    for p in payloads:
        blocks = len(p) // 64
        mcus = -(-blocks // 6)
        cols = -(-mcus // DOWN)
        rows = -(-mcus // cols)
        x = np.zeros((rows * cols * 6, 64), np.int16)
        x[:blocks] = _VALUE[np.frombuffer(p, np.uint8)].reshape(-1, 64)
        x = x.reshape(rows, cols, 6, 64)
        luma = x[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * rows, 2 * cols, 64)
        images.append([luma, x[:, :, 4], x[:, :, 5]])
        comments.append(str(blocks).encode())
    return jpeg.encode(images, comments)


def payload_of(image: jpeg.Image, coef: list[np.ndarray]) -> bytes:
    rows, cols = coef[1].shape[:2]
    luma = coef[0].reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64)
    x = np.concatenate([luma, coef[1][:, :, None], coef[2][:, :, None]], 2).reshape(-1, 64)
    return _BACK[x[: int(image.comment)].ravel() + 128].tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, sums of the channels, and of each quarter's height the sum of all: whole numbers of the tensor."""
    sums = rgb.sum((0, 1), dtype=np.int64)
    bands = [int(b.sum(dtype=np.int64)) for b in np.array_split(rgb, 4)]
    return f"{rgb.shape[1]}x{rgb.shape[0]} rgb {' '.join(map(str, sums))} bands {' '.join(map(str, bands))}"


def planes(rgb: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A tensor without loss, in a form that compresses better: its green; red and blue less green (modulo 256) at the first of each 2 x 2 pixels;
    and what these differ from the first's at the other three, which is mostly zero where chroma was repeated."""
    height, width, _ = rgb.shape
    green = rgb[..., 1]
    cells, rest = [], []
    for c in (0, 2):
        x = rgb[..., c] - green
        first = x[::2, ::2].copy()
        x -= first.repeat(2, 0).repeat(2, 1)[:height, :width]
        cells.append(first.tobytes())
        rest += [x[::2, 1::2].tobytes(), x[1::2].tobytes()]
    return green.tobytes(), b"".join(cells), b"".join(rest)


def tensor_of(width: int, height: int, green: bytes, cells: bytes, rest: bytes) -> np.ndarray:
    """The tensor of its ``planes``."""
    down, across = -(-height // 2), -(-width // 2)
    out = np.empty((height, width, 3), np.uint8)
    out[..., 1] = np.frombuffer(green, np.uint8).reshape(height, width)
    each = np.frombuffer(cells, np.uint8).reshape(2, down, across)
    others = np.frombuffer(rest, np.uint8).reshape(2, height * width - down * across)
    right = down * (width // 2)
    for c, first, other in zip((0, 2), each, others, strict=True):
        x = first.repeat(2, 0).repeat(2, 1)[:height, :width]
        x[::2, 1::2] += other[:right].reshape(down, width // 2)
        x[1::2] += other[right:].reshape(height // 2, width)
        out[..., c] = x + out[..., 1]
    return out


def pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 or 64 * (not data))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(MEDIA)
    for batch in pieces(batches, ENCODE_BYTES):
        raw = [t.encode() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(r) for r in raw], pa.int64()), pa.array(encode_payloads(list(map(pad, raw))), pa.binary())], schema=schema)


def _decode(ddl: str, tensors: bool = True):
    schema = arrow_schema(ddl)
    forms = [f for f in schema if f.name in ("rgb", "green", "cells", "rest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, DECODE_BYTES):
            files = batch["media"].to_pylist()
            images = [jpeg.parse(f) for f in files]
            payload, stored, text = [], [], []
            for im, coef in zip(images, jpeg.coefficients(images), strict=True):
                payload.append(payload_of(im, coef))
                tensor = jpeg.pixels(im, coef)
                text.append(feature(tensor))
                stored.append((None,) if not tensors else planes(tensor) if len(forms) == 3 else (tensor.tobytes(),))
            columns = [pa.array(payload, pa.binary()), batch["media"], pa.array([im.width for im in images], pa.int32()), pa.array([im.height for im in images], pa.int32())]
            columns += [pa.array([t[k] for t in stored], pa.binary()) for k in range(len(forms))] + [pa.array(text)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *columns], schema=schema)

    return run


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a media column: the UTF-8 of each text, filled with zeros to a positive multiple of 64, as the coefficients of a progressive JPEG.

    A null text is empty: 64 zeros. Equal texts give equal files. Repeated rows give repeated files; an empty table gives no rows; other columns don't matter.
    """
    return texts(docs).mapInArrow(_encode, MEDIA)


def read_media(media: DataFrame, *, tensors: bool = True) -> DataFrame:
    """Each file's payload, size, full-resolution RGB tensor (row by row, three bytes a pixel; null unless asked for) and a feature of the tensor."""
    return bounded(media).select("doc_id", "n_bytes", "media").mapInArrow(_decode(DECODED, tensors), DECODED)


def _rgb(width: pa.Array, height: pa.Array, green: pa.Array, cells: pa.Array, rest: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (width, height, green, cells, rest)), strict=True)
    return pa.array([tensor_of(*row).tobytes() for row in rows], pa.binary())


def store_tensors(media: DataFrame) -> DataFrame:
    """Decode all files and write their tensors to a table in the shared folder: doc_id, n_bytes, width, height, rgb, feature, and digests of what was decoded.

    The tensors are written as they are made, a batch at a time, without loss as their ``planes``; rgb is put together of these when it is read.
    The payload and the file are not written again, only their sizes and digests (payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256).
    """
    made = bounded(media).select("doc_id", "n_bytes", "media").mapInArrow(_decode(PLANES), PLANES)
    digests = {
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_sha256": F.sha2("payload", 256),
        "tail_crc32": F.crc32(F.substring("payload", -64, 64)),
        "media_bytes": F.octet_length("media").cast("long"),
        "media_sha256": F.sha2("media", 256),
    }
    made = made.withColumns(digests).drop("payload", "media")
    rgb = F.arrow_udf(_rgb, "binary")("width", "height", "green", "cells", "rest").alias("rgb")
    return materialise(made, "tensors", **STORED).select("doc_id", "n_bytes", "width", "height", rgb, "feature", *digests)


def stored_texts(docs: DataFrame) -> DataFrame:
    """Write the files of all texts to a table in the shared folder, read them back, and write and return the table of their tensors (``store_tensors``)."""
    return store_tensors(materialise(store_texts(docs), "media", **STORED))
