"""Spellings of annotators, labels and strata made comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels and scripts that a judgement may carry.
LABELS = ("CORRECT", "LEGACY_8BIT", "LEGACY_ASCII", "LEGACY_SYMBOL", "CMAP_INVALID", "PARTIAL", "NO_LINGUISTIC_TEXT", "UNDECIDABLE")
SCRIPTS = ("deva", "latin", "mixed", "other", "none")
_OUTER = "^[\\s\\u00a0]+|[\\s\\u00a0]+$"


def same_annotator(c: Column) -> Column:
    """Annotators without regard to case and outer blanks; empty becomes null."""
    out = F.lower(F.regexp_replace(c, _OUTER, ""))
    return F.when(out != "", out)


def same_label(c: Column) -> Column:
    """Labels without regard to case, outer blanks and the separator; empty becomes null."""
    out = F.regexp_replace(F.upper(F.regexp_replace(c, _OUTER, "")), "[\\s_./\\-]+", "_")
    return F.when((out != "") & (out != "_"), out)


def same_stratum(c: Column) -> Column:
    return F.lower(F.trim(c))


SQL_ANNOTATOR = "nullif(lower(trim(annotator)), '')"
SQL_LABEL = "nullif(nullif(regexp_replace(upper(trim(label)), '[\\s_./\\-]+', '_', 'g'), ''), '_')"
