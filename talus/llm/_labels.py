"""Labelled samples of bounded size, and the rows that training may not see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose labels are held out: crc32 of the id's decimal text has this remainder by 4.
HELD_OUT = "crc32(CAST(CAST(doc_id AS BIGINT) AS STRING)) % 4 = 2"


def first_ids(rows: DataFrame, n: int) -> DataFrame:
    """At most n distinct ids that may be trained on, in the order of a hash: the same ones however the table is dealt out."""
    return rows.where(f"doc_id IS NOT NULL AND NOT ({HELD_OUT})").selectExpr("CAST(doc_id AS BIGINT) AS doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
