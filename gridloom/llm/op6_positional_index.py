"""Benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

Plan
----
1. Index: one scan tokenizes the documents and stores the postings (term, document key, position) of every
   term that a benchmark window uses, plus one row per document with its number of words.  The
   dictionary of those terms is broadcast when it has at most ``BROADCAST`` entries; a larger one is
   joined by shuffle.
2. Each window's terms are ordered by their number of postings.  The lists of its two rarest terms are
   shifted by their offsets and intersected on (document, start).
3. The surviving (document, start, window) are compared word by word with the texts they point
   to: exact phrase matches.  ``proximity_matches`` returns, from the same index, the places where the two rarest
   terms of a window stand within some words of their distance.
4. Words inside any occurrence are counted as the union of intervals per document.

A document's key is the hash of its id and text, so rows with equal ids don't mix and repeated rows get equal
results.  Defined results: a null or wordless text has 0 words and no hit; a null id is an id like any other; very long
texts count whole; among equally rare terms of a window the first counts; benchmark rows without words are left out;
an empty benchmark contaminates nothing; an empty table gives no rows; columns besides the named ones are not read, so
their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import renamed, stored, table

#: Windows and terms are broadcast up to so many rows and bytes.
WINDOW, BROADCAST, BROADCAST_BYTES = 10, 1_000_000, 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of digits, lower-cased A-Z and everything outside ASCII; plain ASCII texts take the fast lower()."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, _APART), lambda w: w != "")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _sized(df: DataFrame, n: int, limit: int) -> DataFrame:
    return F.broadcast(df) if n <= limit else df


def _fit(df: DataFrame, words: Column, limit: int) -> tuple[int, int]:
    """The number of rows and the limit that holds for them: none where their texts exceed ``BROADCAST_BYTES``."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(words) + 48), F.lit(0))).first()
    return n, limit if size <= BROADCAST_BYTES else 0


def item_windows(bench: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words) and which items have them (wid, item_id)."""
    items = bench.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - length, F.lit(0))
    every = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, length))).alias("words"))
    every = every.withColumn("wid", F.xxhash64("words"))
    return every.select("wid", "words").dropDuplicates(["wid"]), every.select("wid", "item_id").distinct()


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, limit: int) -> DataFrame:
    """Postings (tid, key, doc_id, pos); tid 0 is the document's own row, its pos the number of words."""
    marked = F.lit(" ")  # no word holds a blank
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", words_of(F.col("text")).alias("words"))
    tokens = keyed.select("key", "doc_id", F.size("words").alias("n"), F.posexplode(F.concat(F.array(marked), "words")).alias("at", "word"))
    listed = terms.unionByName(docs.sparkSession.range(1).select(marked.alias("word"), F.lit(0).cast("long").alias("tid")))
    found = tokens.join(_sized(listed, n_terms, limit), "word")
    return found.select("tid", "key", "doc_id", F.when(F.col("tid") == 0, F.col("n")).otherwise(F.col("at") - 1).alias("pos"))


def rarest_terms(windows: DataFrame, terms: DataFrame, postings: DataFrame, n_terms: int, limit: int) -> DataFrame:
    """Per window its two rarest terms and their offsets: wid, len, tid1, off1, tid2, off2 (the first again in windows of one word)."""
    counts = postings.where("tid <> 0").groupBy("tid").agg(F.count("*").alias("n"))
    counted = stored(terms.join(counts, "tid"), "counted")  # so that the join by word reads plain exchanges, which can be split
    placed = windows.select("wid", F.size("words").alias("len"), F.posexplode("words").alias("off", "word"))
    ranked = placed.join(_sized(counted, n_terms, limit), "word").groupBy("wid", "len").agg(F.array_sort(F.collect_list(F.struct("n", "off", "tid"))).alias("r"))
    second = F.when(F.size("r") > 1, F.element_at("r", 2)).otherwise(F.element_at("r", 1))
    first = F.element_at("r", 1)
    return ranked.where(F.size("r") == F.col("len")).select("wid", "len", first["tid"].alias("tid1"), first["off"].alias("off1"), second["tid"].alias("tid2"), second["off"].alias("off2"))


def intersected(postings: DataFrame, anchors: DataFrame, n_windows: int, limit: int, slop: int = 0) -> DataFrame:
    """(key, start, wid) where a window's two rarest terms stand at their offsets, the second up to ``slop`` words off."""
    lists = postings.where("tid <> 0").select("tid", "key", "pos")
    first = lists.join(_sized(anchors, n_windows, limit), F.col("tid") == F.col("tid1")).select("key", (F.col("pos") - F.col("off1")).alias("start"), "wid", "len", "tid2", "off2").where("start >= 0")
    wanted = first.withColumn("p2", F.explode(F.sequence(F.col("start") + F.col("off2") - slop, F.col("start") + F.col("off2") + slop)) if slop else F.col("start") + F.col("off2"))
    second = lists.join(_sized(anchors.select(F.col("tid2").alias("tid")).distinct(), n_windows, limit), "tid", "left_semi")
    second = second.select("key", F.col("tid").alias("tid2"), F.col("pos").alias("p2")).distinct()
    return wanted.join(second, ["key", "tid2", "p2"], "left_semi").select("key", "start", "wid", "len").distinct()


def _prepared(docs: DataFrame, bench: DataFrame, length: int, limit: int):
    windows, owners = item_windows(bench, length)
    windows = stored(windows, "windows")
    terms = windows.select(F.explode("words").alias("word")).distinct()
    terms = stored(terms.select("word", F.xxhash64("word").alias("tid")), "terms")
    n_terms, most = _fit(terms, F.col("word"), limit)
    postings = stored(build_index(docs, terms, n_terms, most), "postings")
    n, limit = _fit(windows, F.array_join("words", " "), limit)
    return windows, owners, postings, rarest_terms(windows, terms, postings, n_terms, most), n, limit


def proximity_matches(docs: DataFrame, bench: DataFrame, *, slop: int = 3, length: int = WINDOW, limit: int = BROADCAST) -> DataFrame:
    """doc_id, start, item_id where the two rarest terms of an item's window stand at most ``slop`` words off their distance."""
    docs = renamed(docs, {"doc_id": "doc_id", "text": "text"})
    _, owners, postings, anchors, n, limit = _prepared(docs, renamed(bench, {"item_id": "item_id", "text": "text"}), length, limit)
    near = intersected(postings, stored(anchors, "anchors"), n, limit, slop)
    names = postings.where("tid = 0").select("key", "doc_id").distinct()
    return near.join(names, "key").join(owners, "wid").select("doc_id", "start", "item_id").distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = WINDOW, limit: int = BROADCAST, key_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and its ``row_key`` if ``key_col`` names it."""
    docs = renamed(docs, {"doc_id": id_col, "text": text_col})
    windows, owners, postings, anchors, n, limit = _prepared(docs, renamed(bench, {"item_id": item_col, "text": item_text_col}), length, limit)
    candidates = stored(intersected(postings, stored(anchors, "anchors"), n, limit), "candidates")
    # The same join at every size: the number of candidates grows with the documents, so it is never broadcast.
    texts = docs.withColumn("key", row_key(F.col("doc_id"), F.col("text"))).join(candidates.select("key").distinct().hint("merge"), "key", "left_semi").select("key", words_of(F.col("text")).alias("words"))
    phrases = windows.select("wid", F.col("words").alias("phrase"))
    checked = texts.join(candidates, "key").join(_sized(phrases, n, limit), "wid").where(F.slice("words", F.col("start") + 1, F.col("len")) == F.col("phrase"))
    hits = stored(checked.select("key", "start", "len", "wid").distinct(), "hits")

    by_start = Window.partitionBy("key").orderBy("start")
    spans = hits.groupBy("key", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.col("end") - F.greatest(F.col("start"), before), F.lit(0))).groupBy("key").agg(F.sum("new").alias("n_hit"))
    items = hits.select("key", "wid").distinct().join(_sized(owners, n, limit), "wid").groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    found = covered.join(items, "key")
    rows = postings.where("tid = 0").select("key", "doc_id", F.col("pos").cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    key = [F.col("key").alias(key_col)] if key_col else []
    return rows.join(found, "key", "left").select(*key, "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: windows of 10 words of ``benchmark`` against all of ``documents``."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH low AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (SELECT id AS item_id, w, least(len(w), 10) AS m FROM low WHERE side = 'b' AND len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
docs AS (SELECT id AS doc_id, w FROM low WHERE side = 'd'),
grams AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM grams JOIN windows USING (m, phrase)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
