"""What every operator here needs from the Spark session."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession

from typesift.session import materialize, scratch_dir

__all__ = ["shipped", "materialize", "scratch_dir", "table", "partitions"]


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Tasks import it by name, so that per-process caches outlive a task.
    """
    sc = spark.sparkContext
    if getattr(sc, "_typesift_shipped", False):
        return spark
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in sorted(os.walk(root)):
            for f in sorted(names):
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    at = os.path.abspath(os.path.join(tempfile.mkdtemp(prefix="typesift-src-"), "typesift_src.zip"))
    with open(at, "wb") as f:
        f.write(out.getvalue())
    sc.addPyFile(at)  # the driver's copy is served to the executors by Spark itself
    sc._typesift_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
