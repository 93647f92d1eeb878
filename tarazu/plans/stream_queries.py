"""An incremental pass over the label log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import labels as lb
from tarazu.session import checkpoint_dir
from tarazu.streaming.incremental import folder_and_glob, run_pass


def incremental_label_log(spark: SparkSession, d: str) -> DataFrame:
    """The whole log streamed into a sink with one row per judgement, then counted."""
    at = f"{checkpoint_dir(spark)}/incremental-{uuid.uuid4().hex}"
    source, glob = folder_and_glob(f"{d}/annotation.parquet")
    keep = lambda df: df.select("annotation_id", lb.same_annotator(F.col("annotator")).alias("annotator"), lb.same_label(F.col("label")).alias("label"))
    run_pass(spark, source, f"{at}/sink", f"{at}/state", ["annotation_id"], keep, glob)
    return spark.read.parquet(f"{at}/sink").groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"incremental_label_log": incremental_label_log}
SQL = {"incremental_label_log": f"SELECT {lb.SQL_ANNOTATOR} AS annotator, {lb.SQL_LABEL} AS label, count(*) AS n FROM (SELECT DISTINCT ON (annotation_id) * FROM annotation) GROUP BY 1, 2"}
