"""Problem 2: a sample of files under the given seeds that stays stable as data grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.llm.block_sample import block_sample, sequence_numbers
from tarazu.session import table

TAKE = 26  # of the 256 positions of a block


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The chosen files under every seed of annotation_sample; doc_id is handed out on arrival."""
    numbers = sequence_numbers(table(spark, d, "documents").select("sha256", "doc_id"), "sha256", "doc_id")
    return block_sample(numbers, table(spark, d, "annotation_sample").select("seed"), TAKE).select(F.col("key").alias("sha256"), "seed", "block", "position", "selection_prob")


_STEP = "(((('0x' || substr(m, {a}, 4))::BIGINT | 1) * {x} + ('0x' || substr(m, {b}, 4))::BIGINT) & 255)"
QUERIES = {"p2_sample": p2_sample}
SQL = {
    "p2_sample": f"""
WITH seeds AS (SELECT DISTINCT seed FROM annotation_sample WHERE seed IS NOT NULL),
files AS (SELECT sha256, min(doc_id) AS number FROM documents WHERE sha256 IS NOT NULL AND doc_id >= 0 GROUP BY 1),
rows AS (SELECT sha256, seed, number >> 8 AS block, number & 255 AS position FROM files, seeds),
a AS (SELECT *, md5(seed || ':' || block) AS m FROM rows),
b AS (SELECT *, {_STEP.format(a=1, b=5, x="position")} AS x FROM a),
c AS (SELECT * REPLACE (xor(x, x >> 4) AS x) FROM b),
e AS (SELECT * REPLACE ({_STEP.format(a=9, b=13, x="x")} AS x) FROM c),
f AS (SELECT * REPLACE (xor(x, x >> 4) AS x) FROM e)
SELECT sha256, seed, block, position, {TAKE} / 256::DOUBLE AS selection_prob FROM f WHERE {_STEP.format(a=17, b=21, x="x")} < {TAKE}
"""
}
