"""Media columns: texts kept losslessly as WebP images, and images decoded into pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import fresh, table
from inkgauge.llm.webp import decode_many
from inkgauge.llm.webp_write import encode

#: Samples of a payload row: 16 pixels of four channels.
ROW = 64
#: Rows of one file: its pixels go in step with other files', so long texts become many files.
ROWS = 64
#: Bytes of media that one output batch holds before it is sent on.
BATCH_BYTES = 4 << 20


def payload(text: str | None) -> bytes:
    """UTF-8, zeros appended up to a positive multiple of ROW."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW))


def images(samples: bytes) -> bytes:
    """WebP files one after another, each 16 pixels wide and ROWS high at most."""
    found = np.frombuffer(samples, np.uint8)
    return b"".join(encode(found[a : a + ROW * ROWS].reshape(-1, ROW // 4, 4)) for a in range(0, len(found), ROW * ROWS))


def files(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + size]
        at += size


def _batched(rows: Iterator[tuple[int, dict]], batch: pa.RecordBatch, names: dict[str, pa.DataType], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (number in batch, new columns) put beside the columns to keep, sent on every BATCH_BYTES."""

    def sent():
        at = pa.array(index, pa.int64())
        cols = [batch.column(c).take(at) for c in keep] + [pa.array([r[n] for r in made], t) for n, t in names.items()]
        return pa.record_batch(cols, names=[*keep, *names])

    index, made, size = [], [], 0
    for i, row in rows:
        index.append(i)
        made.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes))
        if size > BATCH_BYTES:
            yield sent()
            index, made, size = [], [], 0
    if index:
        yield sent()


def store(docs: DataFrame, *, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with text_col replaced by n_bytes, payload_bytes and media_col (the stored WebP files).

    Null texts are the empty text, stored as one row of zeros. Other columns pass through; those
    that clash with the new ones are replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, media_col, "n_bytes", "payload_bytes")]
    (inner,) = fresh(docs.select(*keep), "_text")

    def run(batches):
        for batch in batches:
            texts = batch.column(inner)

            def rows(texts=texts):
                for i, scalar in enumerate(texts):
                    text = scalar.as_py()
                    body = payload(text)
                    yield i, {"n_bytes": len((text or "").encode()), "payload_bytes": len(body), media_col: images(body)}

            yield from _batched(rows(), batch, {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), media_col: pa.binary()}, keep)

    chosen = docs.select(*keep, F.col(text_col).alias(inner))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_bytes long", "payload_bytes long", f"`{media_col}` binary"])
    return chosen.mapInArrow(run, schema)


def decode_media(df: DataFrame, *, media_col: str = "media", pixels: bool = True) -> DataFrame:
    """df with width, height, pixels (RGBA bytes, row by row), media_error and digests of what was read.

    Media may be several files one after another of one width; their rows are put together. Null
    and broken media give nulls and a message in media_error instead of failing the job. With
    pixels=False the arrays themselves are left out. Columns that clash with the new ones are replaced.
    """
    new = {"width": pa.int64(), "height": pa.int64(), "samples_sha256": pa.string(), "samples_tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media_error": pa.string()}
    if pixels:
        new["pixels"] = pa.binary()
    keep = [c for c in df.columns if c not in new and (pixels or c != media_col)]
    (inner,) = fresh(df.select(*keep), "_media")

    def row(media: bytes | None, found: list) -> dict:
        out = dict.fromkeys(new)
        if media is None:
            return out | {"media_error": "null"}
        out |= {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
        wrong = [x for x in found if isinstance(x, Exception)]
        if wrong or not found or len({x.shape[1] for x in found}) > 1:
            return out | {"media_error": str(wrong[0]) if wrong else "files of several widths" if found else "no file"}
        image = found[0] if len(found) == 1 else np.concatenate(found)
        raw = image.tobytes()
        out |= {"width": image.shape[1], "height": image.shape[0], "samples_sha256": hashlib.sha256(raw).hexdigest(), "samples_tail_crc32": zlib.crc32(raw[-ROW:])}
        return out | {"feature": feature(image)} | ({"pixels": raw} if pixels else {})

    def read(rows: list[tuple[int, bytes | None]]) -> Iterator[tuple[int, dict]]:
        """All files of some rows are decoded together."""
        split = [list(files(media)) if media is not None else [] for _, media in rows]
        decoded = iter(decode_many([f for found in split for f in found]))
        for (i, media), found in zip(rows, split, strict=True):
            yield i, row(media, [next(decoded) for _ in found])

    def together(column) -> Iterator[tuple[int, dict]]:
        rows, size = [], 0
        for i, scalar in enumerate(column):
            rows.append((i, scalar.as_py()))
            size += len(rows[-1][1] or b"")
            if size > BATCH_BYTES:
                yield from read(rows)
                rows, size = [], 0
        yield from read(rows)

    def run(batches):
        for batch in batches:
            yield from _batched(together(batch.column(inner)), batch, new, keep)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    chosen = df.select(*keep, F.col(media_col).alias(inner))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{n} {kinds[t]}" for n, t in new.items())])
    return chosen.mapInArrow(run, schema)


def feature(image: np.ndarray) -> str:
    """Size, the channels' sums and a 16-bin histogram of all samples."""
    sums = ",".join(map(str, image.reshape(-1, 4).sum(0, dtype=np.int64)))
    bins = ",".join(map(str, np.bincount(image.reshape(-1) >> 4, minlength=16)))
    return f"{image.shape[1]}x{image.shape[0]};sum={sums};hist={bins}"


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every text of documents stored as WebP, read back from the stored bytes."""
    stored = store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = decode_media(stored, pixels=False)
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", F.col("samples_sha256").alias("payload_sha256"),
        F.col("samples_tail_crc32").alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
