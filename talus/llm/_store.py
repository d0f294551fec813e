"""What the text operators keep to when they hand texts to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from talus.session import Workspace, shared_dir

__all__ = ["Workspace", "shared_dir", "small_batches"]

#: Rows and bytes of an Arrow batch that goes to Python, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, by rows and by bytes. These are settings of the session, which keep smaller values of its
    own; results don't depend on them."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
