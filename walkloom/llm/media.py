"""Media columns: payloads as progressive JPEG files, and files as RGB tensors.

`encode_media` stores each text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, in the coefficients of
one progressive file. `decode_media` reads any column of progressive files: it accumulates the scans, gives the
full-resolution RGB tensor and its features, and the payload where the file was written by encode_media.

Defined cases: null and empty texts are a payload of 64 zero bytes with n_bytes 0; null, empty and
broken files, files that are not progressive, and files of more than `max_pixels` pixels give null columns beside their
id and bytes; a comment that only looks like encode_media's gives no payload; texts are stored whole, and a task holds
one batch of about 8 MB or the largest single file with its tensor; rows repeated or without an id are handled like any
others; ids must be numbers or read as such; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm.jpeg import Progressive, coefficients_to_payload, encode_payload

_BATCH = 8 << 20
#: What reading a damaged file may raise.
DAMAGE = (ValueError, LookupError, ArithmeticError, AttributeError, TypeError, StopIteration, struct.error)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at, held = [], 0, 0
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                b = t.as_py() or b""
                out.append(encode_payload(b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b)), b"bytes=%d" % len(b)))
                held += len(b)
                if held > _BATCH or i + 1 == batch.num_rows:
                    yield pa.record_batch([batch.column(0).slice(at, i + 1 - at), pa.array(out, pa.binary())], names=["id", "media"])
                    out, at, held = [], i + 1, 0

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, media binary")


def describe(image: np.ndarray) -> str:
    """Size, mean and spread by channel, and the share of steps between neighbours by channel over 64."""
    flat = image.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(0, dtype=np.int64)
    square = (flat.astype(np.uint16) ** 2).sum(0, dtype=np.int64)
    spread = np.sqrt(np.maximum(0, square / n - (total / n) ** 2))
    return f"{image.shape[1]}x{image.shape[0]} mean " + ",".join(f"{x / n:.2f}" for x in total.tolist()) + " sd " + ",".join(f"{x:.2f}" for x in spread.tolist())


def decode_file(data: bytes | None, tensor: bool = True, max_pixels: int = 1 << 25) -> tuple:
    """(n_bytes, payload, height, width, feature, rgb) of one file; all null if it cannot be read."""
    if not data:
        return (None,) * 6
    try:
        p = Progressive(data, max_pixels)
        n, payload = None, None
        if p.note.startswith(b"bytes=") and p.note[6:].isdigit():
            n, payload = int(p.note[6:]), coefficients_to_payload(p)
            size = max(64, -(-n // 64) * 64)
            n, payload = (n, payload[:size]) if size <= len(payload) else (None, None)
        rgb = p.rgb()
        return n, payload, p.height, p.width, describe(rgb), rgb.tobytes() if tensor else None
    except DAMAGE:
        return (None,) * 6


def decode_media(media: DataFrame, id_col: str = "id", media_col: str = "media", tensor: bool = True, max_pixels: int = 1 << 25) -> DataFrame:
    """(id, media, n_bytes, payload, height, width, feature, rgb); rgb (rows of 3-byte pixels) is null unless tensor."""
    schema = pa.schema([("id", pa.int64()), ("media", pa.binary()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("feature", pa.string()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at, held = [], 0, 0
            for i, m in enumerate(batch.column(1)):
                data = m.as_py()
                out.append(decode_file(data, tensor, max_pixels))
                held += len(data or b"") * (1 + 2 * tensor)
                if held > _BATCH or i + 1 == batch.num_rows:
                    cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[2:], strict=True)]
                    yield pa.record_batch([batch.column(0).slice(at, i + 1 - at), batch.column(1).slice(at, i + 1 - at), *cols], schema=schema)
                    out, at, held = [], i + 1, 0

    kinds = "id long, media binary, n_bytes long, payload binary, height int, width int, feature string, rgb binary"
    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, kinds)
