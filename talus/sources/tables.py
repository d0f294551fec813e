"""Clouds as views over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of each embedding."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS pid", *[f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz")], "label")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour of the month, user and value of each event."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS pid",
        "(unix_micros(CAST(ts AS TIMESTAMP)) / 3.6e9) % 720 AS x",
        "CAST(user_id AS DOUBLE) AS y",
        "value AS z",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, price and discount of each order line."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_quantity AS x", "l_extendedprice / 1000 AS y", "100 * l_discount AS z", "l_returnflag AS grp")
