"""Session helpers: the settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# The classification stage generates one large method; HotSpot does not JIT
# methods above 8000 bytes of bytecode, so Spark is told to fall back to
# split (JIT-able) projections past that size, as its docs suggest on HotSpot.
HUGE_METHOD_CONF = "spark.sql.codegen.hugeMethodLimit"
HUGE_METHOD_LIMIT = "8000"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "typesift",
                  extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, use the cluster's session and pass
    the same confs through spark-submit."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config(HUGE_METHOD_CONF, HUGE_METHOD_LIMIT))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine (``local``) may leave it unset; it then
    gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="typesift-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    import uuid
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Cut lineage by writing ``df`` once as Parquet under the shared
    checkpoint folder and reading it back.

    Unlike ``Dataset.checkpoint()``, which computes an unpersisted plan twice
    (once to count, once to write), this runs the plan exactly once.  Meant
    for small derived tables (registries, per-column decisions).
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
