"""Voxels over a stream: sums by cell add up, so each batch is merged into the table of the batches before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_sums(points: DataFrame, size: float) -> DataFrame:
    return points.selectExpr(*[f"CAST(floor({c} / {size!r}) AS BIGINT) AS c{c}" for c in "xyz"], "x", "y", "z").groupBy("cx", "cy", "cz").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"s{c}") for c in "xyz"],
        F.min("z").alias("low"),
    )


def stream_voxels(points: DataFrame, size: float, folder: str, checkpoint: str):
    """Starts the stream; each batch's sums are one folder of its number, so a repeated batch replaces itself. Read with ``read_voxels``."""
    write = lambda batch, number: cell_sums(batch, size).write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_voxels(spark, folder: str) -> DataFrame:
    total = spark.read.parquet(folder).groupBy("cx", "cy", "cz").agg(F.sum("n").alias("n"), *[F.sum(f"s{c}").alias(f"s{c}") for c in "xyz"], F.min("low").alias("low"))
    return total.selectExpr("cx", "cy", "cz", "n", *[f"s{c} / n AS {c}" for c in "xyz"], "low")
