"""Media columns: texts' bytes stored as FLAC streams, read back, verified and cut into PCM blocks.

``encode_media`` turns a text (or binary) column into a media column; ``pcm_blocks`` decodes it into one
row per frame with its sample offset, so that any block can be sought; ``media_features``
decodes it and returns digests and integer features per row.  All three are maps over Arrow batches
without a shuffle, and work through about a megabyte at a time.  The query writes the media column to a table
in the shared folder and reads that table.

The feature string holds, over the decoded signed samples: frames, sum, energy, sign changes and peak.

Defined results: a null or empty text is 576 bytes of 255; equal texts give equal streams; a
stream whose checksums fail ends the job with an error; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac, textscan
from .common import renamed, stored, table

_CHUNK = 1 << 20
#: How the media table is written: streams of equal texts, seek tables and padding frames repeat bytes within a page.
_TABLE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = textscan.column_bytes(batch["text"])
        media: list[bytes] = []
        for lo, hi in textscan.row_chunks(offsets, _CHUNK):
            lens = np.diff(offsets[lo : hi + 1])
            frames = np.maximum(-(-lens // flac.BLOCK), 1)
            payload = np.full(int(frames.sum()) * flac.BLOCK, 255, np.uint8)
            shift = np.repeat((np.cumsum(frames) - frames) * flac.BLOCK - (offsets[lo:hi] - offsets[lo]), lens)
            payload[np.arange(int(lens.sum())) + shift] = buf[offsets[lo] : offsets[hi]]
            media += flac.encode(payload, frames)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    column, held, size, first = batch["media"], [], 0, 0
    for i in range(len(batch) + 1):
        if held and (i == len(batch) or size > _CHUNK):
            for j, (stream, (samples, at)) in enumerate(zip(held, flac.decode(held), strict=True)):
                yield first + j, stream, samples, at
            held, size, first = [], 0, i
        if i < len(batch):
            held.append(column[i].as_py())
            size += len(held[-1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, stream, samples, at in _decoded(batch):
            pcm = samples.astype(np.int32) - 128
            payload = samples.tobytes()
            feature = f"frames={len(at)};sum={pcm.sum(dtype=np.int64)};energy={np.einsum('i,i->', pcm, pcm, dtype=np.int64)};turns={np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0))};peak={np.abs(pcm).max()}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names])


def _blocks(batches: Iterator[pa.RecordBatch], frames: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        for i, _, samples, at in _decoded(batch):
            starts = at[::frames]
            blocks = [samples[a : a + frames * flac.BLOCK].tobytes() for a in starts]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(starts), pa.int64()), pa.array(starts.astype(np.int64)), pa.array([len(b) for b in blocks], pa.int64()), pa.array(blocks, pa.binary())], ["doc_id", "sample_offset", "n_samples", "pcm"])


def encode_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column."""
    docs = renamed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(media: DataFrame, *, frames: int = 64) -> DataFrame:
    """One row per block of ``frames`` frames: doc_id, sample_offset, n_samples, pcm (unsigned bytes)."""
    return media.select("doc_id", "media").mapInArrow(lambda it: _blocks(it, frames), "doc_id long, sample_offset long, n_samples long, pcm binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all of ``documents``: the media column is written to a table, and the features come from its reread bytes."""
    return media_features(stored(encode_media(table(spark, sf_dir, "documents")), "media", **_TABLE))
