"""A corpus pipeline of five of the operators. run() applies STAGES to documents; each stage works on what the last one kept.

The quality and language models are fitted on the documents that they then judge: all labels and languages of a stage's input
are used, as here nothing is held out. Held-out figures are those of the queries op2 and op3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, remove
from millrace.llm.decontaminate import contaminated
from millrace.llm.lang_id import fit_languages, language_udf
from millrace.llm.mixing import mix_sources
from millrace.llm.near_dup import near_duplicates
from millrace.llm.quality import fit_quality, quality_udf

QUALITY_THRESHOLD = 0.3
LEAST_LANGUAGE_SHARE = 0.2


def _filtered(docs: DataFrame, value: F.Column, keep) -> DataFrame:
    """Rows where keep(value) holds, with the columns of docs."""
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), value.alias("value"))
    return scored.filter(keep(F.col("value"))).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, fitted on this stage's labelled documents, scores at 0.3 or more."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _filtered(docs, quality_udf(model)(F.col("text")), lambda v: v >= QUALITY_THRESHOLD)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: letters, and known trigrams of the language found, a fifth at least of what is usual
    in its training text. The limit goes with the filter, which lacks the rarest trigrams once the table is very large."""
    model = fit_languages(docs)
    usual = F.create_map(*[F.lit(x) for item in model.usual.items() for x in item]) if model.usual else F.lit(None).cast("map<string,double>")
    least = lambda v: LEAST_LANGUAGE_SHARE * F.coalesce(usual[v["lang_pred"]], F.lit(1.0))
    return _filtered(docs, language_udf(model)(F.col("text")), lambda v: (v["lang_pred"] != "und") & (v["score"] >= least(v)))


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a key for each row, whatever its doc_id. It is written, so that each use reads the same keys."""
    return cut(docs.withColumn("_key", F.monotonically_increasing_id()), name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (shingles of five words, similarity 0.8): that with the smallest id.

    Rows count as documents of their own: those that share an id but not the text are compared by their texts, and a row
    with a null id stays if no other row of its group has an id. Of rows without words, those with one id keep one."""
    rows = _keyed(docs, "dedup-rows")
    found = near_duplicates(rows, id_col="_key").withColumnRenamed("doc_id", "_key")
    # Rows without words are a group for each id; null ids have none in common.
    ids = rows.select("_key", "doc_id")
    own = F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull(), F.col("doc_id"))
    group = [own.alias("id"), F.when(own.isNull(), F.col("component_id")).alias("component")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))
    kept = found.join(ids, "_key").groupBy(*group).agg(first.alias("first")).select("first._key")
    return rows.join(kept, "_key", "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold an item of the benchmark, whatever their id."""
    rows = _keyed(docs, "decontaminate-rows")
    found = cut(contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return rows.join(found, "_key", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, taken of all documents; those that it leaves out take 0 words."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        remove(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
