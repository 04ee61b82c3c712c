"""CSV, JSON and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYNONYM_SCHEMA = "groups array<struct<canonical:string,variants:array<string>>>"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file with header and quoted fields; values that do not fit become null, as do empty ones."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, every value a string; missing ones are empty."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return df.na.fill("")


def without_header_rows(rows: DataFrame, col: str) -> DataFrame:
    """Rows that repeat the header's name, or are blank, go."""
    return rows.where(F.col(col).isNotNull() & (F.trim(F.col(col)) != "") & (F.col(col) != col))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, key, canonical``: canonical names and variants in lower case, in file order."""
    groups = spark.read.schema(SYNONYM_SCHEMA).json(path, multiLine=True)
    g = groups.select(F.posexplode("groups").alias("g", "x"))
    keys = g.select("g", F.col("x.canonical").alias("canonical"), F.posexplode(F.concat(F.array("x.canonical"), F.coalesce("x.variants", F.array().cast("array<string>")))).alias("k", "key"))
    out = keys.select(F.struct("g", "k").alias("place"), F.lower("key").alias("key"), "canonical")
    # a key that comes again keeps its place and takes the later canonical name
    out = out.groupBy("key").agg(F.min("place").alias("place"), F.max_by("canonical", "place").alias("canonical"))
    # a curated table: one file, that one task has read as a whole
    return out.select((F.row_number().over(Window.orderBy("place")) - 1).cast("long").alias("ordinal"), "key", "canonical")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``text``: whole files."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
