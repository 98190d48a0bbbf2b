"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations (DataFrame operations only).

Weights: source s with token share p(s) gets w(s) proportional to p(s) ** a.  The exponent a in [0, 1] is bisected, as
an expression over the one-row table of shares: the largest a whose entropy reaches ``target_entropy`` (a share of the
greatest possible one), then raised to the smallest a whose most repeated source stays within ``max_repeats``.  It is cut to nine
decimals, so that small differences of float libraries don't show.

Budgets: source s gets round(w(s) * budget) tokens.  Without a budget, the least repeated source is shown exactly once
and every row takes part.

Realisation: a source's rows are dealt to blocks of about ``BLOCK`` rows by a hash.  Each pass over a source is a
permutation of its blocks and, within each, of its rows, by hashes of the pass's number.  Running token sums over
blocks, then inside each block, give every row its place; rows whose end lies within the budget are
shown.  So a hot source is many small sorts, and only one row per block is sorted per source.

Row order: ``progress`` (the place as a share of the source's budget) mixes the sources at their weights in every
prefix.  Defined results: a null source is a source of its own, ``''``; a null or empty text has no tokens and is shown in every
complete pass; a source without tokens has no budget: its rows are shown once; rows equal in id, text
and source are drawn together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import renamed, stored, table

BLOCK, ENTROPY, REPEATS, STEPS = 1024, 0.97, 4.0, 50


def _spot(*parts: Column) -> Column:
    """A 60-bit hash that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def _powers(p: Column, a: Column) -> Column:
    return F.transform(p, lambda x: F.pow(x, a))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _entropy(p: Column, a: Column) -> Column:
    """Entropy of the weights p ** a, as log z - a * mean log p."""
    z = _total(_powers(p, a))
    mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + F.pow(x, a) * F.log(x)) / z
    return F.log(z) - a * mean


def _bisect(low: Column, high: Column, keep_low) -> Column:
    """Halves [low, high] STEPS times; ``keep_low(mid)`` tells whether the sought point lies at or above mid."""
    pair = F.struct(low.alias("lo"), high.alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = keep_low(mid)
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), pair, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def temperature(sources: DataFrame, target_entropy: float, max_repeats: float) -> DataFrame:
    """One row: the exponent, for sources (source, tokens) with tokens."""
    shares = sources.where("tokens > 0").agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t")).withColumn("n", F.size("t"))
    shares = shares.withColumn("p", F.transform("t", lambda x: x / _total(F.col("t"))))
    goal = F.lit(target_entropy) * F.log(F.col("n").cast("double"))
    p = F.col("p")
    by_entropy = F.when(_entropy(p, F.lit(1.0)) >= goal, F.lit(1.0)).otherwise(_bisect(F.lit(0.0), F.lit(1.0), lambda a: _entropy(p, a) >= goal))
    spread = F.array_max("p") / F.array_min("p")
    by_repeats = F.when(spread <= max_repeats, F.lit(0.0)).otherwise(_bisect(F.lit(0.0), F.lit(1.0), lambda a: F.pow(spread, F.lit(1.0) - a) > max_repeats))
    return shares.where("n > 0").select(F.round(F.greatest(by_entropy, by_repeats), 9).alias("exponent"))


def budgets(sources: DataFrame, *, target_entropy: float = ENTROPY, max_repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """source, tokens, rows, exponent, weight, budget per source; one row each."""
    with_a = sources.crossJoin(temperature(sources, target_entropy, max_repeats))  # one row on the right
    raw = F.pow(F.col("tokens") / F.col("all"), F.col("exponent"))
    rows = with_a.where("tokens > 0").crossJoin(sources.agg(F.sum("tokens").cast("double").alias("all"))).withColumn("raw", raw)
    z = rows.agg(F.sum("raw").alias("z"), F.max(F.col("tokens") / F.col("raw")).alias("most"))
    rows = rows.crossJoin(z).withColumn("weight", F.col("raw") / F.col("z"))
    whole = F.col("raw") * F.col("most") if budget is None else F.col("weight") * budget
    return rows.select("source", "tokens", "rows", "exponent", "weight", F.floor(whole + 0.5).cast("long").alias("budget"))


def draws(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float = ENTROPY, max_repeats: float = REPEATS, budget: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per shown row: doc_id, source, epoch, tokens, place (first token in its source), progress; and key, copies."""
    docs = renamed(docs, {"doc_id": id_col, "text": text_col, "source": source_col})
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    slim = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n.cast("long").alias("n"), F.xxhash64("doc_id", "text", "source").alias("key"))
    slim = stored(slim.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.sum("n").alias("n"), F.count("*").cast("int").alias("copies")), "rows")
    sources = stored(slim.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")), "sources")
    plan = stored(budgets(sources, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget), "plan")
    blocks = F.ceil(F.col("rows") / block).cast("long")
    dealt = slim.join(plan, "source").withColumn("block", F.pmod(_spot(F.lit("b"), F.col("doc_id")), blocks))
    passes = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("budget") / F.col("tokens")).cast("long") - 1)
    shown = dealt.where("budget > 0").withColumn("epoch", F.explode(passes))
    of_block = ["source", "epoch", "block"]
    totals = shown.groupBy(*of_block).agg(F.sum("n").alias("block_tokens"))
    order = Window.partitionBy("source", "epoch").orderBy(_spot(F.lit("o"), F.col("epoch"), F.col("block")), "block")
    starts = totals.select(*of_block, (F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")).alias("block_start"))
    within = Window.partitionBy(*of_block).orderBy(_spot(F.lit("r"), F.col("epoch"), F.col("doc_id")), "doc_id", "key")
    placed = shown.join(starts, of_block).withColumn("place", F.col("epoch") * F.col("tokens") + F.col("block_start") + F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = placed.where(F.col("place") + F.col("n") <= F.col("budget"))
    taken = placed.select("key", "doc_id", "source", "epoch", F.col("n").alias("tokens"), "place", (F.col("place") / F.col("budget")).alias("progress"), "copies")
    idle = slim.join(sources.where("tokens = 0").select("source"), "source", "left_semi")
    return taken.unionByName(idle.select("key", "doc_id", "source", F.lit(0).cast("long").alias("epoch"), F.col("n").alias("tokens"), F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("progress"), "copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows as often as they are shown, with their own columns."""
    names = {k: options.get(f"{k}_col", k if k != "id" else "doc_id") for k in ("id", "text", "source")}
    times = draws(docs, **options).groupBy("key").agg(F.count("*").cast("int").alias("__times"))
    key = F.xxhash64(*[F.col(f"`{names[k]}`") for k in ("id", "text", "source")])
    return docs.withColumn("__key", key).join(times.withColumnRenamed("key", "__key"), "__key").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__key", "__times", "__n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over all of ``documents``: 0.97 of the greatest entropy, at most 4 passes, as many tokens as there are."""
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    shown = draws(docs, budget=int(total))
    return shown.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "source", "epoch", "tokens", "place", "progress")


ORACLE = r"""
WITH RECURSIVE slim AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
src AS (SELECT source, sum(n)::BIGINT AS t, count(*) AS k FROM slim GROUP BY 1),
total AS (SELECT sum(t)::DOUBLE AS a, sum(t)::BIGINT AS budget, ln(count(*)::DOUBLE) AS most, max(t)::DOUBLE / min(t) AS spread FROM src),
step AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END, CASE WHEN up2 THEN m2 ELSE lo2 END, CASE WHEN up2 THEN hi2 ELSE m2 END
  FROM (SELECT i, lo, hi, lo2, hi2, (lo + hi) / 2 AS m, (lo2 + hi2) / 2 AS m2,
    (SELECT ln(sum(pow(t / a, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(t / a, (lo + hi) / 2) * ln(t / a)) / sum(pow(t / a, (lo + hi) / 2)) FROM src, total) >= 0.97 * (SELECT most FROM total) AS up,
    pow((SELECT spread FROM total), 1 - (lo2 + hi2) / 2) > 4 AS up2 FROM step WHERE i < 50)
),
alpha AS (SELECT round(greatest(
  CASE WHEN (SELECT ln(sum(t / a)) - sum(t / a * ln(t / a)) / sum(t / a) FROM src, total) >= 0.97 * (SELECT most FROM total) THEN 1.0 ELSE (lo + hi) / 2 END,
  CASE WHEN (SELECT spread FROM total) <= 4 THEN 0.0 ELSE (lo2 + hi2) / 2 END), 9) AS x FROM step WHERE i = 50),
plan AS (SELECT source, t, k, floor(pow(t / a, x) / (SELECT sum(pow(t / a, x)) FROM src, total, alpha) * budget + 0.5)::BIGINT AS b FROM src, total, alpha),
shown AS (SELECT doc_id, source, n, t, b, epoch, ('0x' || substr(md5('b:' || doc_id), 1, 15))::BIGINT % ceil(k / 1024.0)::BIGINT AS block FROM (SELECT *, unnest(range(0, ceil(b / t)::BIGINT)) AS epoch FROM slim JOIN plan USING (source))),
blocks AS (SELECT source, epoch, block, sum(bt) OVER (PARTITION BY source, epoch ORDER BY ('0x' || substr(md5('o:' || epoch || ':' || block), 1, 15))::BIGINT, block) - bt AS start FROM (SELECT source, epoch, block, sum(n) AS bt FROM shown GROUP BY ALL)),
placed AS (SELECT doc_id, s.source, s.epoch, n AS tokens, b, epoch * t + start + sum(n) OVER (PARTITION BY s.source, s.epoch, s.block ORDER BY ('0x' || substr(md5('r:' || epoch || ':' || doc_id), 1, 15))::BIGINT, doc_id) - n AS place FROM shown s JOIN blocks USING (source, epoch, block))
SELECT doc_id, source, epoch, tokens, place::BIGINT AS place, place / b AS progress FROM placed WHERE place + tokens <= b
"""
