"""A corpus pipeline of five stages, each by one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of
``documents``.  ``run`` writes each stage's rows as Parquet to the shared folder and reads them again.

1. toxicity: rows that the string-kernel classifier rejects go; all others stay.
2. near_duplicates: of each group of texts linked at similarity 0.8 on five-word shingles one row stays, the one with
   the least doc_id (rows without an id come last; ties go by a hash of the row).  Rows equal in every column are copies too;
   texts without words link with nothing and all stay.
3. decontamination: rows that hold a benchmark window of ten words go.
4. mixing: rows are repeated so that the sources approach the target weights; each row appears at least
   once, none more than twice.
5. tokens: the texts' token ids in files; one row per written document.

Every row gets its own decision, also one without an id or with an id that other rows have; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import op1_toxicity_kernel, op3_temperature_mix, op6_positional_index, op7_token_output, op9_superminhash
from gridloom.llm.common import discard, stored, table

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_toxicity_kernel.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("__row", F.xxhash64(*docs.columns))
    judged = op9_superminhash.near_duplicates(keyed, id_col="__row")
    judged = judged.select(F.col("doc_id").alias("__row"), "component_id", (F.col("n_shingles") == 0).alias("__blank")).distinct()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row", "__blank")
    first = keyed.select("__row", "doc_id").distinct().join(judged, "__row").groupBy("component_id").agg(F.min(place).alias("x"))
    survivors = stored(first.select("x.__row", "x.__blank"), "survivors")
    nth = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    return keyed.join(survivors, "__row").withColumn("__nth", nth).where("__nth = 1 or __blank").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = op6_positional_index.decontaminate(docs, table(spark, sf_dir, "benchmark"), key_col="__row")
    bad = stored(judged.where("contaminated").select("__row").distinct(), "contaminated")
    keyed = docs.withColumn("__row", op6_positional_index.row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(bad, "__row", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_temperature_mix.mix(docs, max_repeats=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_token_output.read_tokens(op7_token_output.write_tokens(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
