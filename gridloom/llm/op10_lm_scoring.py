"""LM scoring: prediction by partial matching over bytes, pretrained on the whole training part.

The model's text is the document with A-Z lower-cased and its words joined by single spaces;
``score`` is the log10 probability of that text and its end under a byte-context trie of order 5 with
escape estimation and symbol exclusion (``ppm``).  ``base_score`` is the add-one unigram model.

Plan
----
1. One scan counts, per partition, word hashes and byte grams of training texts; one
   shuffle adds them up.  Nothing is capped: both grow with the corpus.
2. The grams go to the executors in slices of at most ``SLICE`` grams, dealt by the last two
   bytes of their contexts (plus the short contexts, at most 2**24 grams, which every slice needs).
   A position is scored by the slice that owns its context, so the slices' sums add up exactly and the memory
   of driver and executors is bounded by one slice.  Where there are several, a task holds ``HOLD`` bytes of
   texts and builds every slice's tree once for all of them.
3. The second scan scores the texts.  Counts of the ``FREQUENT`` most frequent words are
   at hand there; the other words of a document leave as distinct (word, times) and meet their
   counts in a shuffled join, with no limit to the vocabulary.

Words are known by 64-bit hashes of their bytes.  Defined results: a null or empty text is the
end token alone; a null id is held in (not held out); repeated rows are scored alike; an empty table
gives no rows, and without any training text every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ppm, textscan
from .common import Latest, crc_bucket, renamed, stored, table, tidy

ORDER, SLICE, FREQUENT = 5, 4_000_000, 1 << 17
#: Bytes of texts that a task holds while the slices take turns.
HOLD = 1 << 26
_built = Latest()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: lo, hi, normalised bytes and offsets, word hashes and each row's first word."""
    buf, offsets = textscan.column_bytes(batch["text"])
    for lo, hi in textscan.row_chunks(offsets):
        b = textscan.lower_ascii(buf[offsets[lo] : offsets[hi]])
        starts, ends, first = textscan.space_words(b, offsets[lo : hi + 1] - offsets[lo])
        norm, at = ppm.normalised(b, offsets, starts, ends, first)
        yield lo, hi, norm, at, textscan.span_hashes(b, starts, ends), first


def _counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Per partition: (0, word, times) and (1, gram, times)."""
    grams, words, times, pending, rows = ppm.GramCounter(order), [], [], 0, 0
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo, hi, norm, at, hashes, _ in _texts(batch):
                rows += hi - lo
                grams.add(norm, at)
                k, c = ppm.count(hashes)
                words.append(k)
                times.append(c)
                pending += len(k)
                if pending > 4_000_000:
                    k, c = ppm.merge(words, times)
                    words, times, pending = [k], [c], 0
        out = [(0, *ppm.merge(words, times)), (1, *grams.total()), (2, np.zeros(1, np.uint64), np.array([rows]))]
    for kind, k, c in out:
        for i in range(0, len(k), 1 << 16):
            k1, c1 = k[i : i + (1 << 16)].view(np.int64), c[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k1), kind, np.int32)), pa.array(k1), pa.array(c1)], ["kind", "key", "n"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's (key, n) as one compressed row: sorted keys as differences, then the counts."""
    keys, counts = [], []
    for batch in batches:
        keys.append(batch["key"].to_numpy(zero_copy_only=False).view(np.uint64))
        counts.append(batch["n"].to_numpy(zero_copy_only=False))
    if keys:
        k, c = ppm.merge(keys, counts)
        body = np.diff(k, prepend=np.uint64(0)).tobytes() + c.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([len(k)], pa.int64()), pa.array([pa.compress(body, "zstd", asbytes=True)], pa.binary())], ["n", "body"])


def _collected(pairs: DataFrame) -> list[tuple[int, bytes]]:
    return [(r.n, bytes(r.body)) for r in pairs.select("key", "n").mapInArrow(_pack, "n long, body binary").collect()]


def _unpacked(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n, body in parts:
        flat = np.frombuffer(pa.decompress(body, 16 * n, "zstd"), np.uint64)
        keys.append(np.cumsum(flat[:n], dtype=np.uint64))
        counts.append(flat[n:].view(np.int64))
    return ppm.merge(keys, counts)


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words above the least count that at most ``most`` words reach."""
    spread = words.groupBy("n").agg(F.count("*").alias("k"))
    from_top = F.sum("k").over(Window.orderBy(F.desc("n")))
    least = spread.withColumn("above", from_top).where(F.col("above") <= most).agg(F.min("n")).first()[0]
    return words.where(F.col("n") >= least) if least is not None else words.where("false")


def _slices(grams: DataFrame, order: int, limit: int) -> list[np.ndarray]:
    """For each slice, which of the 65,536 two-byte context ends it owns."""
    end = F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF).alias("end")
    sizes = grams.groupBy(end).count().toPandas().sort_values("end")
    slices, room = [np.zeros(1 << 16, bool)], limit
    for e, n in zip(sizes["end"], sizes["count"], strict=True):
        if n > room and room < limit:
            slices.append(np.zeros(1 << 16, bool))
            room = limit
        slices[-1][e] = True
        room -= n
    slices[-1][np.setdiff1d(np.arange(1 << 16), sizes["end"].to_numpy())] = True
    return slices


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Groups of (batch, its runs of rows) with about ``most`` bytes of texts each."""
    held, size = [], 0
    for batch in batches:
        runs = list(_texts(batch))
        held.append((batch, runs))
        size += sum(len(norm) for _, _, norm, *_ in runs)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _score(batches: Iterator[pa.RecordBatch], order: int, models: list, frequent, seen_at_all: bool, hold: int = HOLD) -> Iterator[pa.RecordBatch]:
    """Each slice's tree is built once for all texts that are held, not for every run of rows; the last one built serves the next group first."""
    from pyspark import TaskContext

    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    words, times = _unpacked(frequent.value)
    index, log_c = textscan.HashIndex(words), np.log10(times + 1.0)
    turn = list(enumerate(models))
    with np.errstate(over="ignore"):
        for held in _held(batches, hold if len(models) > 1 else 1):
            bits = [np.zeros(len(batch)) for batch, _ in held]
            for i, (bc, own) in turn:
                tree = _built.get(bc, lambda parts: ppm.ContextTree(*_unpacked(parts), order), i)
                for out, (_, runs) in zip(bits, held, strict=True):
                    for lo, hi, norm, at, *_ in runs:
                        out[lo:hi] += tree.costs(norm, at, own if len(models) > 1 else None)
            turn.reverse()
            for out, (batch, runs) in zip(bits, held, strict=True):
                if not len(batch):
                    continue
                n_tokens, known, total, rare, rare_n, size = [], [], [], [], [], []
                for lo, hi, _, _, hashes, first in runs:
                    n = np.diff(first)
                    n_tokens.append(n + 1)
                    at_ = index.get(hashes)
                    hit = at_ >= 0
                    row = np.repeat(np.arange(hi - lo), n)
                    known.append(np.bincount(row[hit], minlength=hi - lo) + int(seen_at_all))
                    total.append(np.bincount(row[hit], log_c[at_[hit]], hi - lo).astype(np.float64))
                    left_row, left = row[~hit], hashes[~hit]
                    o = np.lexsort((left, left_row))
                    left_row, left = left_row[o], left[o]
                    new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (left_row[1:] != left_row[:-1])])) if len(left) else np.zeros(0, np.int64)
                    rare.append(left[new].view(np.int64))
                    rare_n.append(np.diff(np.concatenate([new, [len(left)]])))
                    size.append(np.bincount(left_row[new], minlength=hi - lo))
                cat = np.concatenate
                edges = pa.array(cat([[0], np.cumsum(cat(size))]), pa.int32())
                rid = base + np.arange(len(batch), dtype=np.int64)
                base += len(batch)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid), batch["doc_id"], batch["held_out"], pa.array(cat(n_tokens).astype(np.int64)), pa.array(cat(known).astype(np.int64)), pa.array(cat(total)), pa.array(-out * np.log10(2.0)),
                        pa.ListArray.from_arrays(edges, pa.array(cat(rare))), pa.ListArray.from_arrays(edges, pa.array(cat(rare_n).astype(np.int32))),
                    ],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare", "times"],
                )


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, order: int = ORDER, slice_grams: int = SLICE, frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The training part is the rows whose crc32(id) mod ``modulus`` is not ``held``.
    """
    spark = docs.sparkSession
    docs = renamed(docs, {"doc_id": id_col, "text": text_col})
    docs = docs.withColumn("held_out", F.coalesce(crc_bucket("doc_id", modulus) == held, F.lit(False)))
    parts = docs.where("not held_out").select("text").mapInArrow(lambda it: _counts(it, order), "kind int, key long, n long")
    counts = stored(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words, grams = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    sums = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("k")).toPandas().set_index("kind")
    texts = int(sums["n"].get(2, 0))
    tokens = int(sums["n"].get(0, 0)) + texts
    distinct = int(sums["k"].get(0, 0)) + (texts > 0)
    known = spark.sparkContext.broadcast(_collected(_frequent(words, frequent)))
    slices = _slices(grams, order, slice_grams)
    models = []
    for own in slices:
        if len(slices) == 1:
            parts = _collected(grams)
        else:
            ends = F.broadcast(spark.createDataFrame([(int(e),) for e in np.flatnonzero(own)], "end int"))
            ended = grams.withColumn("end", F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF).cast("int"))
            short = ended.join(ends, "end", "left_anti").groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n"))
            parts = _collected(ended.join(ends, "end", "left_semi").select("key", "n")) + _collected(short)
        models.append((spark.sparkContext.broadcast(parts), own))
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<long>, times array<int>"
    some = texts > 0
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = stored(docs.mapInArrow(lambda it: tidy(_score(it, order, models, known, some)), schema), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    found = rare.join(words, "key").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    every = float(np.log10(tokens + distinct + 1))
    end_log = float(np.log10(texts + 1))
    return scored.drop("rare", "times").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over all of ``documents``; rows with crc32(doc_id) mod 7 = 2 are held out."""
    return score(table(spark, sf_dir, "documents"))
