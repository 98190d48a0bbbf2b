"""Token-ID output: texts as token ids in patched frame-of-reference files, in id order.

Plan
----
1. Rows are range-partitioned and sorted by id.  Each partition becomes one run of segments (files of
   about ``SEGMENT`` ids, whole documents each), written through Spark to a table in the shared folder, so
   that any store Spark can write works.  A segment row holds the file image, the ids of its documents and their
   starts within the partition.
2. The segments are read back.  What precedes a partition is the sum over the partitions
   before it: one row each.

Tokenizing: a text is cut into pieces where the tokenizer's own pattern always cuts; each distinct piece is
encoded once per task by the tokenizers library and kept in a vectorised map (emptied when it grows past
``CACHE`` pieces).

Defined results: a null or empty text is the end id alone; rows with equal ids follow each other in
a fixed order of their texts' hashes; a null id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor, textscan
from .common import renamed, stored, table, tidy

SEGMENT, CACHE, END_ID = 1 << 18, 1 << 19, 1
_MARK, _MARK_TEXT = 49407, "<|endoftext|>"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127], _CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 3, 1, 1, 2


def pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, the pieces' starts and ends, each row's first piece, and which pieces are plain letters.

    A piece ends at white space and wherever letters (ASCII and Latin-1), ASCII digits and ASCII signs
    meet: the tokenizer's own pattern ends a match there, except after an apostrophe.  Rows near the text of a
    special token are cut at white space only.
    """
    whole = b"<|" in buf.tobytes()
    if whole:
        return buf, *textscan.space_words(buf, offsets), None
    low = textscan.lower_ascii(buf)
    kind = _CLASS[low]
    lead = np.flatnonzero(low[:-1] == 0xC3)
    tail = low[lead + 1]
    letter = (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)
    lead, tail = lead[letter], tail[letter]
    low[lead + 1] = np.where(tail < 0x9F, tail + 0x20, tail)
    kind[lead] = kind[lead + 1] = 1
    change = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ~((low[:-1] == 39) & (kind[1:] == 1))
    starts, ends, first = textscan.space_words(low, offsets, np.flatnonzero(change) + 1)
    odd = np.concatenate([[0], np.cumsum(kind != 1)])
    return low, starts, ends, first, odd[ends] == odd[starts]


class PieceCache:
    """Token ids of pieces, encoded once each.

    Plain letter pieces need neither normalisation nor the split pattern, so a tokenizer of the same
    model that only splits at blanks encodes thousands in one call; each ends with the one token that carries the
    end-of-word mark.  All other pieces go through the whole tokenizer, joined by its end marker.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.marked = self.tokenizer.token_to_id(_MARK_TEXT) == _MARK
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index = textscan.HashIndex()
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a piece without an end-of-word token")
        return ids, np.diff(ends, prepend=0)

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[list[int]] = []
        safe = [w for w in words if self.marked and "<|" not in w]
        joined = np.array(self.tokenizer.encode(_MARK_TEXT.join(safe), add_special_tokens=False).ids if safe else [], np.int64)
        cuts = np.concatenate([[-1], np.flatnonzero(joined == _MARK), [len(joined)]])
        nth = 0
        for w in words:
            if self.marked and "<|" not in w:
                parts.append(joined[cuts[nth] + 1 : cuts[nth + 1]].tolist())
                nth += 1
            else:
                parts.append(self.tokenizer.encode(w, add_special_tokens=False).ids)
        return np.array([i for p in parts for i in p], np.int64), np.array([len(p) for p in parts], np.int64)

    def _learn(self, keys: np.ndarray, words: list[str], encode) -> None:
        for i in range(0, len(words), 8192):
            flat, lens = encode(words[i : i + 8192])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens)])
            self.used += len(flat)
        self.index.add(keys)

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each closed by ``end_id``, and how many ids each row has."""
        buf, starts, ends, first, plain = pieces(buf, offsets)
        keys = textscan.span_hashes(buf, starts, ends)
        if self.index.n > CACHE:
            self.clear()
        at = self.index.get(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            where = missing[where]
            data = buf.tobytes()
            simple = np.zeros(len(where), bool) if plain is None else plain[where]
            for which, encode in ((simple, self._plain), (~simple, self._other)):
                spot = where[which]
                self._learn(new[which], [data[a:z].decode("utf-8") for a, z in zip(starts[spot].tolist(), ends[spot].tolist(), strict=True)], encode)
            at = self.index.get(keys)
        lens = (self.starts[1:] - self.starts[:-1])[at] if len(at) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(lens)])
        n = before[first[1:]] - before[first[:-1]] + 1
        row_of_piece = np.repeat(np.arange(len(n)), np.diff(first))
        out = np.full(int(n.sum()), end_id, np.uint32)
        many = np.arange(int(before[-1]))
        source = many + np.repeat(self.starts[at] - before[:-1], lens)
        out[many + np.repeat(row_of_piece, lens)] = self.ids[source]  # one end id for every row before
        return out, n


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, segment: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    cache, part = PieceCache(path), TaskContext.get().partitionId() if TaskContext.get() else 0
    names: list[int | None] = []
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    start, number = 0, 0

    def close() -> pa.RecordBatch:
        nonlocal start, number, names, held, sizes
        ids, lens = np.concatenate(held), np.concatenate(sizes).astype(np.int64)
        row = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start]), pa.array([len(ids)]), pa.array([names], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([pfor.encode(ids)], pa.binary())],
            ["part", "segment", "start", "n_ids", "doc_ids", "lengths", "image"],
        )
        start, number, names, held, sizes = start + len(ids), number + 1, [], [], []
        return row

    with np.errstate(over="ignore"):
        for batch in batches:
            buf, offsets = textscan.column_bytes(batch["text"])
            ids = batch["doc_id"].to_pylist()
            for lo, hi in textscan.row_chunks(offsets, segment):
                out, n = cache.encode(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end_id)
                held.append(out)
                sizes.append(n)
                names += ids[lo:hi]
                if sum(map(len, held)) >= segment:
                    yield close()
        if names:
            yield close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            ids = pfor.decode(batch["image"][i].as_py()).astype("<u4")
            lens = np.asarray(batch["lengths"][i].values)
            ends = np.cumsum(lens)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * (z - n) : 4 * z]) for z, n in zip(ends.tolist(), lens.tolist(), strict=True)]
            start = int(batch["start"][i].as_py()) + ends - lens
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lens), batch["part"][i].as_py(), np.int32)), batch["doc_ids"][i].values, pa.array(start), pa.array(lens), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, segment: int = SEGMENT) -> DataFrame:
    """The table of written segments: part, segment, start (in the part), n_ids, doc_ids, lengths, image."""
    path = tokenizer or tokenizer_path()
    docs = renamed(docs, {"doc_id": id_col, "text": text_col}).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = "part int, segment int, start long, n_ids long, doc_ids array<long>, lengths array<long>, image binary"
    return stored(ordered.mapInArrow(lambda it: tidy(_segments(it, path, end_id, segment)), schema), "tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = segments.select("part", "start", "doc_ids", "lengths", "image").mapInArrow(lambda it: tidy(_read(it)), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over all of ``documents`` with the 49,408-piece tokenizer and end id 1."""
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
