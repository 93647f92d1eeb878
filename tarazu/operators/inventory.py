"""The fonts of a file: references collapsed to names, and the inventory against what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse(references: DataFrame, order: str) -> DataFrame:
    """One row per file and font name from one row per reference to a font.

    ``n_xrefs`` counts the references (their sum where they carry counts), a font is
    embedded if one of its references is and has a Unicode map only if all of them have;
    pages are united where ``pages`` lists them, else their numbers are added; the raw
    name is that of the first reference by ``order``. Null names are one name.
    """
    have = set(references.columns)
    xrefs = F.sum("n_xrefs") if "n_xrefs" in have else F.count(F.lit(1))
    pages = F.size(F.array_distinct(F.flatten(F.collect_list("pages")))) if "pages" in have else F.sum("n_pages_seen")
    first = F.min(F.array_min("pages")) if "pages" in have else F.min("first_page")
    return references.groupBy("sha256", "font_name").agg(
        xrefs.cast("long").alias("n_xrefs"), F.max("embedded").alias("embedded"), F.min("has_tounicode").alias("has_tounicode"),
        pages.cast("long").alias("n_pages"), first.alias("first_page"), F.min_by("raw_font_name", order).alias("raw_font_name"),
    )


def observed(inventory: DataFrame, spans: DataFrame) -> DataFrame:
    """Both sides by file and font name, with ``seen``: both, inventory only or spans only."""
    a = inventory.withColumn("__a", F.lit(True)).alias("a")
    b = spans.withColumn("__b", F.lit(True)).alias("b")
    same = (F.col("a.sha256") == F.col("b.sha256")) & F.col("a.font_name").eqNullSafe(F.col("b.font_name"))
    seen = F.when(F.col("__a").isNull(), "spans only").when(F.col("__b").isNull(), "inventory only").otherwise("both")
    keys = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("sha256", "font_name")]
    rest = [F.col(f"a.`{c}`") for c in inventory.columns if c not in ("sha256", "font_name")] + [F.col(f"b.`{c}`") for c in spans.columns if c not in ("sha256", "font_name")]
    return a.join(b, same, "full_outer").select(*keys, *rest, seen.alias("seen"))
