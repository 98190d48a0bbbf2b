"""Line dedup: repeated runs of lines, found by prefix doubling over line-id sequences.

A document is its sequence of non-blank lines (cut at newlines, ASCII white space trimmed).  A run of
consecutive lines with at least ``min_words`` words that equals a run earlier in the order (doc_id, line) is a
later copy, and its lines are deleted.

Plan
----
1. One scan gives every line its id (a hash) and its number of words; the lines whose id occurs
   once can't belong to a repeated run and leave at once.  What remains falls into stretches of adjacent lines.
2. Prefix doubling: the rank of a suffix by its first line, then by its first 2, 4, 8 … lines; each
   doubling ranks the pairs (own rank, rank 2**k lines on).  Ranks are dense and follow the suffix array's
   order: distinct pairs are range-partitioned, sorted and numbered with one offset per partition, so hot
   lines are one pair only.  Doubling ends at the longest run that the next step asks for.
3. Suffixes with equal ranks are an interval of the suffix array whose common prefix is at least that long.  Every
   repeated run of enough words is the union of its shortest sufficient runs, read forward from a line or
   backward from it; each of those is named by its length and the ranks of the two blocks that cover
   it.  All but the first of a name are later copies.  The ranks of a level are the suffix array's order by that many
   lines; the whole array and its common-prefix lengths are not written out, as the runs need intervals of one length each.
4. The copies' lines, merged to maximal runs, leave the texts.

Defined results: null and empty texts have no lines and stay as they are; rows equal in id and
text count as one and get equal results; rows with equal ids and other texts are ordered by the texts'
hashes; null ids come first; an empty table gives no rows; other columns are kept as they are, except that one named like
an added column (``ADDED``) is replaced; very long texts count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import renamed, stored, table

MIN_WORDS = 50
_BLANK = " \t\x0b\x0c\r"
_AT = ["doc_id", "key"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_ids(docs: DataFrame) -> DataFrame:
    """doc_id, key, idx (among non-blank lines), raw (among all), line (its id), words."""
    numbered = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("raw"), F.btrim(x, F.lit(_BLANK)).alias("line")))
    # The key is made below the generator: above it, the whole text would be hashed again for every line.
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.filter(numbered, lambda x: x["line"] != "").alias("lines"))
    rows = keyed.select("doc_id", "key", F.posexplode("lines").alias("idx", "x"))
    return rows.select("doc_id", "key", "idx", F.col("x.raw").alias("raw"), F.xxhash64("x.line").alias("line"), F.size(F.split("x.line", r"[\x20\x09-\x0D]+")).alias("words")).distinct()


def dense_rank(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds the dense rank of the columns ``by`` over all rows, without sending them through one task."""
    distinct = rows.select(*by).distinct().repartitionByRange(*by).withColumn("__p", F.spark_partition_id())
    distinct = stored(distinct, "pairs")
    sizes = distinct.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__o"))
    numbered = distinct.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*by))).join(F.broadcast(offsets), "__p")
    return rows.join(numbered.select(*by, (F.col("__r") + F.col("__o")).cast("long").alias(name)), by)


def suffix_ranks(stretches: DataFrame, most: int) -> list[DataFrame]:
    """Per level k, (doc_id, key, stretch, idx, rank): the rank of each suffix by its first 2**k lines."""
    keep = [*_AT, "stretch", "idx", "rank"]
    levels = [stored(dense_rank(stretches, ["line"], "rank").select(*keep), "rank")]
    while 2 ** len(levels) <= most:
        k = len(levels)
        ahead = F.lead("one", 2 ** (k - 1)).over(Window.partitionBy(*_AT, "stretch").orderBy("idx"))
        pairs = levels[-1].withColumnRenamed("rank", "one").withColumn("two", ahead).where("two is not null")
        levels.append(stored(dense_rank(pairs, ["one", "two"], "rank").select(*keep), "rank"))
    return levels


def shortest_runs(stretches: DataFrame, min_words: int) -> DataFrame:
    """kind, doc_id, key, first, n: from each line the shortest forward (0) and backward (1) run of enough words."""
    own = Window.partitionBy(*_AT, "stretch")
    rows = stretches.withColumn("end", F.sum("words").over(own.orderBy("idx"))).withColumn("begin", F.col("end") - F.col("words"))
    rows = rows.withColumn("total", F.max("end").over(own))
    # Every line has a word, so frames of ``min_words`` words hold no more lines than that.
    within = F.max("idx").over(own.orderBy("begin").rangeBetween(0, min_words - 1))  # the last line that begins in reach
    stop = F.when(F.col("total") - F.col("begin") >= min_words, within)
    since = F.min("idx").over(own.orderBy("end").rangeBetween(1 - min_words, 0))  # the first line that ends in reach
    start = F.when(F.col("end") >= min_words, since)
    rows = rows.withColumn("stop", stop).withColumn("start", start)
    both = rows.select(*_AT, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("idx").alias("first"), F.col("stop").alias("last")), F.struct(F.lit(1).alias("kind"), F.col("start").alias("first"), F.col("idx").alias("last")))).alias("x"))
    both = both.select(*_AT, "x.kind", "x.first", (F.col("x.last") - F.col("x.first") + 1).alias("n"))
    return both.where("n is not null")


def later_copies(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """All lines, and the maximal deleted runs (doc_id, key, first, last)."""
    lines = stored(line_ids(docs), "lines")
    twice = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    by_doc = Window.partitionBy(*_AT).orderBy("idx")
    active = lines.join(twice, "line", "left_semi").withColumn("stretch", F.col("idx") - F.row_number().over(by_doc))
    active = stored(active.select(*_AT, "stretch", "idx", "line", "words"), "active")
    runs = stored(shortest_runs(active, min_words), "runs")
    most = runs.agg(F.max("n")).first()[0] or 0
    named = None
    for k, ranks in enumerate(suffix_ranks(active, most) if most else []):
        some = runs.where((F.col("n") >= 2**k) & (F.col("n") < 2 ** (k + 1)))
        one = ranks.select("key", F.col("idx").alias("first"), F.col("rank").alias("r1"))
        two = ranks.select("key", F.col("idx").alias("second"), F.col("rank").alias("r2"))
        part = some.withColumn("second", F.col("first") + F.col("n") - 2**k).join(one, ["key", "first"]).join(two, ["key", "second"])
        part = part.select("kind", *_AT, "first", "n", "r1", "r2")
        named = part if named is None else named.unionByName(part)
    if named is None:
        return lines, runs.select(*_AT, "first", F.col("first").alias("last")).where("false")
    name = ["kind", "n", "r1", "r2"]
    place = F.struct(*_AT, "first")
    named = stored(named, "named")
    origin = named.groupBy(*name).agg(F.min(place).alias("origin"), F.count("*").alias("times")).where("times > 1")
    copies = named.join(origin, name).where(place != F.col("origin")).select(*_AT, "first", (F.col("first") + F.col("n") - 1).alias("last"))
    spans = copies.groupBy(*_AT, "first").agg(F.max("last").alias("last"))
    earlier = F.max("last").over(Window.partitionBy(*_AT).orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(F.col("first") <= earlier + 1, 0).otherwise(1))
    grouped = opened.withColumn("run", F.sum("new").over(Window.partitionBy(*_AT).orderBy("first")))
    return lines, stored(grouped.groupBy(*_AT, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run"), "deleted")


#: Columns that ``dedup_lines`` adds; an input column of such a name is replaced.
ADDED = ("n_lines", "n_removed", "n_runs", "removed_words")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with later copies gone from the text, and n_lines, n_removed, n_runs, removed_words beside it."""
    slim = renamed(docs, {"doc_id": id_col, "text": text_col})
    lines, deleted = later_copies(slim, min_words)
    gone = deleted.withColumn("idx", F.explode(F.sequence("first", "last"))).withColumn("opens", (F.col("idx") == F.col("first")).cast("int"))
    gone = lines.join(gone.select("key", "idx", "opens"), ["key", "idx"])
    per_doc = gone.groupBy("key").agg(F.collect_list("raw").alias("__gone"), F.sum("opens").alias("__runs"), F.sum("words").alias("__words"))
    parts = _lines(F.col(f"`{text_col}`"))
    # The lines are bound to a variable, so that the text is split once, not once for every line.
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("__gone")), lambda i: F.element_at(p, i + 1)), "\n"))[0]
    rows = docs.withColumn("__key", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))).join(per_doc.withColumnRenamed("key", "__key"), "__key", "left")
    out = rows.withColumn("n_lines", F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(_BLANK)) != "")).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
    out = out.withColumn("n_runs", F.coalesce("__runs", F.lit(0)).cast("long")).withColumn("removed_words", F.coalesce("__words", F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(f"`{text_col}`")).otherwise(kept))
    return out.drop("__key", "__gone", "__runs", "__words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over all of ``documents``: runs of at least 50 words."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", "removed_words", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH raw AS (SELECT doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS raw, unnest(string_split(coalesce(text, ''), chr(10))) AS full_line FROM documents),
ln AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS idx, trim(full_line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM raw WHERE trim(full_line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM ln),
lc AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY idx) AS e FROM lw),
win AS (
  SELECT 0 AS kind, a.doc_id, a.idx AS f, min(b.idx) AS l FROM lc a JOIN lc b ON a.doc_id = b.doc_id AND b.idx >= a.idx AND b.idx <= a.idx + 50 AND b.e - a.e + a.w >= 50 GROUP BY ALL
  UNION ALL
  SELECT 1, a.doc_id, max(b.idx), a.idx FROM lc a JOIN lc b ON a.doc_id = b.doc_id AND b.idx <= a.idx AND b.idx >= a.idx - 50 AND a.e - b.e + b.w >= 50 GROUP BY a.doc_id, a.idx
),
named AS (SELECT kind, w.doc_id, f, l, string_agg(line, chr(10) ORDER BY idx) AS body FROM win w JOIN lc ON lc.doc_id = w.doc_id AND idx BETWEEN f AND l GROUP BY ALL),
copies AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, body ORDER BY doc_id, f) AS nth FROM named) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, l + 1)) AS idx FROM copies),
runs AS (SELECT doc_id, count(*) AS n_runs FROM (SELECT doc_id, idx, lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM gone) WHERE p IS NULL OR p < idx - 1 GROUP BY 1),
cut AS (SELECT doc_id, count(*) AS n_removed, sum(w) AS words FROM gone JOIN lc USING (doc_id, idx) GROUP BY 1),
kept AS (SELECT r.doc_id, string_agg(full_line, chr(10) ORDER BY r.raw) AS text FROM raw r LEFT JOIN (SELECT doc_id, raw FROM gone JOIN lc USING (doc_id, idx)) g ON g.doc_id = r.doc_id AND g.raw = r.raw WHERE g.raw IS NULL GROUP BY 1),
total AS (SELECT doc_id, count(*) AS n FROM lc GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(words, 0)::BIGINT AS removed_words, md5(coalesce(kept.text, '')) AS text_md5
FROM documents d LEFT JOIN total USING (doc_id) LEFT JOIN cut USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
