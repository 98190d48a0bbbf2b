"""Language ID: per-language variable-order byte context trees with escapes and symbol exclusion.

Each language's tree holds the counts of all 4-byte grams of a bounded sample of its texts
(``SAMPLE`` texts a language; the hash of the id chooses).  With frozen statistics the code length
of a text under each tree is exact: the sum of one precomputed cost per byte.  The language with the
shortest code wins; ``score`` is its share of the likelihoods, 2 ** -bits.

One scan scores all texts without a shuffle; the broadcast holds the grams of the samples.

Defined results: a null text, and one without any letter, gets ``und`` with score 0; ties go to
the language that sorts first; without any training text every text is ``und``; rows with a null id
are trained on and not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ppm, textscan
from .common import Latest, crc_bucket, renamed, table
from .sampling import per_class

ORDER, SAMPLE = 3, 1500
_rows = Latest()


def _grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    counters: dict[str, ppm.GramCounter] = {}
    for batch in batches:
        labels = np.asarray(batch["lang"].to_pylist(), object)
        for lang in sorted(set(labels)):
            buf, offsets = textscan.column_bytes(batch["text"].filter(pa.array(labels == lang)))
            counter = counters.setdefault(lang, ppm.GramCounter(order))
            for lo, hi in textscan.row_chunks(offsets):
                counter.add(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
    for lang, counter in counters.items():
        keys, n = counter.total()
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])


def train(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The gram counts of every language, from columns doc_id, text, lang."""
    known = docs.where("lang is not null and text is not null")
    chosen = per_class(known.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), "lang", "doc_id", sample)
    counts = chosen.select("lang", "text").mapInArrow(lambda it: _grams(it, order), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    return {str(k): (g["key"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy(np.int64)) for k, g in counts.groupby("lang", sort=True)}


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    seen = np.concatenate([[0], np.cumsum(plain)])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _predict(batches: Iterator[pa.RecordBatch], order: int, trees) -> Iterator[pa.RecordBatch]:
    langs = list(trees.value)
    rows = _rows.get(trees, lambda x: ppm.ContextRows(list(x.values()), order)) if langs else None
    for batch in batches:
        buf, offsets = textscan.column_bytes(batch["text"])
        best, share = [], []
        for lo, hi in textscan.row_chunks(offsets):
            b, o = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            letters = has_letter(b, o)
            if not langs:
                letters[:] = False
                bits = np.zeros((hi - lo, 1))
            else:
                bits = rows.costs(b, o)
            least = bits.argmin(1)
            p = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            best += [langs[i] if ok else "und" for i, ok in zip(least, letters, strict=True)]
            share.append(np.where(letters, p, 0.0))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(best, pa.string()), pa.array(np.concatenate(share) if share else np.zeros(0))], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2, order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; ``lang`` is read for training only, off the held-out rows."""
    docs = renamed(docs, {"doc_id": id_col, "text": text_col, "lang": lang_col}).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("held_out", F.coalesce(crc_bucket("doc_id", modulus) == held, F.lit(False)))
    trees = docs.sparkSession.sparkContext.broadcast(train(docs.where("not held_out"), order, sample))
    return docs.select("doc_id", "text", "held_out").mapInArrow(lambda it: _predict(it, order, trees), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all of ``documents``; rows with crc32(doc_id) mod 4 = 2 are held out."""
    return identify(table(spark, sf_dir, "documents"))
