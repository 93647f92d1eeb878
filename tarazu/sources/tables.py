"""Table readers with fixed schemas and added columns, and the CSV sink with the union of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarazu.functions import labels as lb

ADJUDICATION = "obs_id long, final_label string, basis string, adjudicator string, note string, guideline_version string, decided_at timestamp"
FONT_FAMILY = "family_id string, label string, n_observations long, n_documents long, example_fonts string, example_text string, threshold double"
CONVERSION = "run_id string, sha256 string, page int, family_id string, split string, coverage double, invalid_rate_before double, invalid_rate_after double, similarity double"


def conformed(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The columns of the schema in order, cast; columns that are missing are null, others are dropped."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    have = set(df.columns)
    return df.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields))


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return conformed(df, schema) if schema else df


def union_by_keys(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the sorted union of their columns."""
    got = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return got.select(*sorted(got.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by ";"."""
    flat = [F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def offline_labels(spark: SparkSession, path: str) -> DataFrame:
    """A finished labelling batch (JSON lines): succeeded results with a known label and script only.

    Refusals, failures and answers outside the lists stay pending.
    """
    rows = spark.read.schema("obs_id long, annotator string, round int, label string, script string, status string").json(path)
    known = lb.same_label(F.col("label")).isin(*lb.LABELS) & (F.col("script").isNull() | F.lower("script").isin(*lb.SCRIPTS))
    return rows.where((F.col("status") == "succeeded") & known).drop("status")
