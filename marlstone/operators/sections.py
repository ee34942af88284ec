"""Sections and layout tables of plain texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ordinal (dense, from 0), text: the lines that are not blank, trimmed of spaces."""
    # not F.trim itself: as it takes a second argument, it would get the line's number as the characters to trim
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    lines = docs.select(key, F.posexplode(F.filter(trimmed, lambda x: x != "")).alias("ordinal", "text"))
    return lines.select(key, "ordinal", "text")


def table_cells(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, row_ordinal, column_ordinal, text: cells between runs of two or more blanks, of texts in which at least two lines have two cells. A single blank inside a cell is a space."""
    cells = F.transform(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s{2,}"), lambda c: F.regexp_replace(c, r"\s", " "))
    cells = lines.withColumn("cells", cells).where(F.size("cells") >= 2)
    many = cells.groupBy(key).agg(F.count("*").alias("n")).where("n >= 2").select(F.col(key).alias("_key"))
    rows = cells.join(many, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return rows.select(key, F.col("ordinal").alias("row_ordinal"), F.posexplode("cells").alias("column_ordinal", "text"))
