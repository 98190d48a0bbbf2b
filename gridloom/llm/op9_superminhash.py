"""Near duplicates: SuperMinHash signatures, banding, exact verification and components.

Plan
----
1. One scan computes, per text, its set size, a 128-bit print of its shingle set and its
   band keys.  Texts with equal sets are one class, named by its smallest doc_id.
2. Band keys of class representatives meet in buckets.  Every bucket member is compared
   with the bucket's smallest member on full sets; the links found are joined to components.
3. Buckets that still hold several components are compared completely across components: a
   component as large as a block has blocks of its own, smaller ones share blocks; every pair of blocks
   that can hold two components is one group, and only a spanning forest of the links found there leaves the
   group.  So no list of all pairs of a large group ever exists, none of its open pairs is skipped, and a
   large component beside a few strangers costs its size, not its square.  A block is bounded by rows and by shingles.
4. Components of all links; every document gets its class's component.

Bands and rows follow from the similarity (``banding``): a pair exactly at it shares no band with
probability 7e-7 at 0.85 (30 bands of 6) and 6e-7 at 0.80 (36 bands of 5).

Defined results: null, empty and blank texts have an empty set, link with nothing and stay;
a text of fewer words than a shingle has one shingle, the whole sequence; rows that share a doc_id are
one document, linked when any of their texts is; rows without doc_id link with nothing and
have no component; an empty table gives no rows; columns besides the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import superminhash, textscan
from .common import discard, renamed, stored, table, tidy
from .components import connected_components

#: Places of a signature, and the share of links at the least similarity that banding may miss.
PLACES, MISSED = 180, 1e-6
#: Members of a block, and its shingles (a longer text is a block alone); a group of step 3 holds two blocks.
BLOCK, WEIGHT = 256, 1 << 18
_WORDS = tuple(np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D, 0xD1B54A32D192ED03))


def banding(percent: int) -> tuple[int, int]:
    """Rows of a band and number of bands: the longest bands that miss at most ``MISSED`` of the links at ``percent``."""
    for rows in range(6, 1, -1):
        if (1 - (percent / 100) ** rows) ** (PLACES // rows) <= MISSED:
            return rows, PLACES // rows
    return 1, PLACES


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    for lo, hi in textscan.row_chunks(offsets):
        o = offsets[lo : hi + 1] - offsets[lo]
        b = textscan.lower_ascii(buf[offsets[lo] : offsets[hi]])
        starts, ends, first = textscan.space_words(b, o)
        h = textscan.span_hashes(b, starts, ends)
        n = max(len(h) - words + 1, 0)
        grams = np.zeros(n, np.uint64)
        for i in range(words):
            grams = textscan.mix64(grams + h[i : i + n] * _WORDS[i % 5])
        for i in range(hi - lo):
            a, z = int(first[i]), int(first[i + 1])
            if z - a >= words:
                yield np.unique(grams[a : z - words + 1])
            elif z > a:
                g = np.uint64(z - a)
                for w in h[a:z]:
                    g = textscan.mix64(np.atleast_1d(g * _WORDS[0] ^ w))[0]
                yield np.array([g], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _prints(batches: Iterator[pa.RecordBatch], words: int, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            n, h1, h2, keys = [], [], [], []
            for s in shingle_sets(*textscan.column_bytes(batch["text"]), words):
                n.append(len(s))
                a = textscan.mix64(s + np.uint64(17)).sum(dtype=np.uint64)
                b = textscan.mix64(s * _WORDS[1] + np.uint64(29)).sum(dtype=np.uint64)
                h1.append(a)
                h2.append(b)
                keys.append(superminhash.bands(superminhash.signature(s, rows * bands), rows, bands) if len(s) else np.zeros(0, np.int64))
            size = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))),
                ],
                ["doc_id", "n", "h1", "h2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(*textscan.column_bytes(batch["text"]), words)]
            size = np.cumsum([0, *map(len, sets)])
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(size, pa.int32()), values)], ["id", "grams"])


def _forest(key, left, percent: int):
    """Links of a group of two blocks, or of one block with itself, as a spanning forest over its known components."""
    import pandas as pd

    ids, comp = left["id"].to_numpy(), left["comp"].to_numpy()
    sets = [np.asarray(x, np.int64).view(np.uint64) for x in left["grams"]]  # sorted as unsigned
    second = left["side"].to_numpy() == 1
    same = key[1] == key[2]
    others = np.flatnonzero(second) if not same else np.arange(len(ids))
    length = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([sets[i] for i in others]) if len(others) else np.zeros(0, np.uint64)
    cuts = np.concatenate([[0], np.cumsum(length[others])])[:-1]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in np.arange(len(ids)) if same else np.flatnonzero(~second):
        if not len(others):
            break
        place = np.searchsorted(sets[i], flat)
        place[place == length[i]] = 0
        both = np.add.reduceat(sets[i][place] == flat, cuts, dtype=np.int64)
        for j in others[100 * both >= percent * (length[i] + length[others] - both)]:
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _groups(tagged: DataFrame) -> DataFrame:
    """band, p, q, side, id, comp: the members of every pair of blocks (p <= q) that can hold two components."""
    open_ = (
        tagged.groupBy("band")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
        .where("lo < hi")
        .groupBy("k", "who")  # buckets of the same members are compared once
        .agg(F.min("band").alias("band"))
        .select("band")
    )
    inside = stored(tagged.join(open_, "band").select("band", "rep", "n", "comp"), "open")
    needs = lambda: F.greatest(F.ceil(F.sum("k") / BLOCK), F.ceil(F.sum("n") / WEIGHT)).cast("int")
    shares = inside.groupBy("band", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    shares = shares.withColumn("pure", (F.col("k") >= BLOCK) | (F.col("n") >= WEIGHT)).withColumn("owner", F.when(F.col("pure"), F.col("comp")).otherwise(0))
    owners = shares.groupBy("band", "pure", "owner").agg(needs().alias("blocks"))
    ahead = Window.partitionBy("band").orderBy("pure", "owner").rowsBetween(Window.unboundedPreceding, -1)  # a row a block at most
    layout = owners.withColumn("start", F.coalesce(F.sum("blocks").over(ahead), F.lit(0)).cast("int")).withColumn("total", F.sum("blocks").over(Window.partitionBy("band")).cast("int"))
    placed = stored(shares.select("band", "comp", "pure", "owner").join(layout, ["band", "pure", "owner"]).drop("owner"), "layout")
    last = F.col("start") + F.col("blocks")
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda j: ~F.col("pure") | (j < F.col("start")) | (j >= last))
    dealt = (
        inside.join(placed, ["band", "comp"])
        .withColumn("block", F.col("start") + F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(others))
    )
    return dealt.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("side"), F.col("rep").alias("id"), "comp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows: int | None = None, bands: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked doc_id) and kept.

    Two documents are linked when 100 * intersection >= percent * union of their
    distinct ``words``-word shingles, confirmed on the full sets.
    """
    if rows is None or bands is None:
        rows, bands = banding(percent)
    docs = renamed(docs, {"doc_id": id_col, "text": text_col}).withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = stored(docs.mapInArrow(lambda it: tidy(_prints(it, words, rows, bands)), "doc_id long, n long, h1 long, h2 long, bands array<long>"), "prints")
    known = prints.where("n > 0 and doc_id is not null")
    same = ["n", "h1", "h2"]
    copied = stored(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "copied")
    classes = known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    members = stored(classes.select("rep", "n", F.explode("bands").alias("band")), "bands")
    buckets = members.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("size")).where("size > 1")
    entries = stored(members.join(buckets, "band").select("band", "rep", "n", "centre", "size"), "buckets")
    discard(members)

    wanted = entries.select(F.col("rep").alias("doc_id")).distinct()
    sets = stored(docs.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: tidy(_sets(it, words)), "id long, grams array<long>"), "sets")
    pairs = entries.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    linked = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
        .where(100 * F.least(F.size("ga"), F.size("gb")) >= percent * F.greatest(F.size("ga"), F.size("gb")))
        .withColumn("both", F.size(F.array_intersect("ga", "gb")))
        .where(100 * F.col("both") >= percent * (F.size("ga") + F.size("gb") - F.col("both")))
        .select("a", "b")
    )
    links = stored(linked, "links")
    first = stored(connected_components(links), "components")

    tagged = entries.where("size > 2").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    groups = _groups(tagged).join(sets, "id")

    def forest(key, rows):
        return _forest(key, rows, percent)

    rest = stored(groups.groupBy("band", "p", "q").applyInPandas(forest, "a long, b long"), "links")
    discard(entries, sets, first)
    # Texts of one doc_id, and classes that a doc_id shares, belong together.
    doubled = known.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id")
    shared = known.select("doc_id", *same).join(doubled, "doc_id", "left_semi").join(copied, same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    final = connected_components(links.unionByName(rest).unionByName(shared))

    named = known.select("doc_id", *same).join(copied, same, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    named = named.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = prints.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: 3-word shingles of ``documents`` at similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
