"""Keyed JSON Lines, catalogs and id lists in, JSON Lines and canonical reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.joins import overlay, violations


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """Rows of a keyed file. Broken JSON, a missing or empty key, and a repeated key fail the query."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = violations(rows, F.coalesce(F.col(key).cast("string"), F.lit("")) == "", "a row has no key")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return violations(rows.withColumn("_n", n), F.col("_n") > 1, "a key occurs twice").drop("_n")


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of any number of files; blank lines are skipped, a broken one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files whose last lines may be torn; any other bad line fails the query.

    A line's place is that of its split in the file and its number in the split, so files of any number and size will do."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), place.alias("_at")).filter("trim(value) != ''")
    parsed = lines.withColumn("row", F.from_json("value", schema)).withColumn("_bad", F.expr("try_parse_json(value) IS NULL"))
    last = parsed.groupBy("_file").agg(F.max("_at").alias("_last"))
    marked = parsed.join(last, "_file")
    return violations(marked, F.col("_bad") & (F.col("_at") < F.col("_last")), "a line is no JSON").filter("not _bad").select("row.*")


def read_unique_keys(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files whose objects name no key twice, at any depth: else, or for broken JSON, the query fails."""
    lines = spark.read.text(path).filter("trim(value) != ''")
    checked = violations(lines, F.expr("try_parse_json(value) IS NULL"), "a line is no JSON, or names a key twice")
    return checked.select(F.from_json("value", schema).alias("row")).select("row.*")


def read_partitioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """<role>/<project>.jsonl under path, with both as columns."""
    name = F.col("_metadata.file_path")
    return spark.read.schema(schema).json(f"{path}/*/*.jsonl").withColumn("role", F.regexp_extract(name, r"([^/]+)/[^/]+$", 1)).withColumn("project", F.regexp_extract(name, r"([^/]+)\.jsonl$", 1))


def read_catalogs(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """JSON arrays; a later file's entry replaces an earlier one's."""
    return overlay([spark.read.schema(schema).option("multiLine", True).json(p) for p in paths], key)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, ordinal) of one file's lines, trimmed; the file is read whole, so the order holds."""
    lines = spark.read.text(path, wholetext=True)
    out = lines.select(F.posexplode(F.split("value", "\n")).alias("ordinal", "id")).select(F.trim("id").alias("id"), F.col("ordinal").cast("long"))
    return out.filter("id != ''")


def read_projected(spark: SparkSession, path: str, schema: str, ids: DataFrame, key: str) -> DataFrame:
    """Only the schema's columns of wanted rows."""
    return spark.read.schema(schema).json(path).join(ids.select(key), key, "left_semi")


def write_new(df: DataFrame, path: str) -> None:
    """JSON Lines in a folder that must not exist; readers see all of it or nothing."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def replace(df: DataFrame, path: str, staging: str) -> None:
    """Write to staging, move the old rows aside, and rename staging: a failed job leaves the old rows, and if the driver is lost
    between the two renames they are under path + ".old"."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("ignoreNullFields", False).json(staging)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = hadoop(path + ".old")
    fs.delete(old, True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), old)
    fs.rename(hadoop(staging), hadoop(path))
    fs.delete(old, True)


def append_missing(rows: DataFrame, path: str, key: str, schema: str) -> None:
    """Append rows whose key the output lacks."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    exists = hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop(path))
    todo = rows.join(spark.read.schema(schema).json(path).select(key), key, "left_anti") if exists else rows
    todo.write.mode("append").json(path)
