"""Problem 9: pieces of the documents above a token limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarazu.llm.chunks import Sizes, pieces
from tarazu.session import spread, table

SIZES = Sizes(limit=1024, overlap=96, least=448)


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return pieces(docs, "doc_id", "text", SIZES, oversized_only=True)


def p9_violations(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that break a rule; none is to be found.

    The pieces of a document follow one another without a gap from its first character to
    its last, hold its text, stay under the limit and overlap by no more than wanted.
    """
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n_chars"), F.col("text").alias("whole"))
    got = p9_pieces(spark, d)
    w = Window.partitionBy("doc_id").orderBy("piece")
    rows = got.join(docs, "doc_id").withColumns({"end_before": F.lag("char_end").over(w), "next_start": F.lead("char_start").over(w)})
    same = F.substring("whole", (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int")) == F.col("text")
    first = F.when(F.col("end_before").isNull(), F.col("char_start") != 0).otherwise((F.col("char_start") > F.col("end_before")) | (F.col("char_end") <= F.col("end_before")))
    last = F.col("next_start").isNull() & (F.col("char_end") != F.col("n_chars"))
    wrong = ~same | first | last | (F.col("n_tokens") > SIZES.limit) | (F.col("overlap_tokens") > SIZES.overlap)
    return rows.where(wrong).select("doc_id", "piece")


QUERIES = {"p9_pieces": p9_pieces, "p9_violations": p9_violations}
SQL = {"p9_violations": "SELECT 0::BIGINT AS doc_id, 0 AS piece WHERE false"}
