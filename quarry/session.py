"""SparkSession defaults shared by the library, the tests and the bench.

The library never creates a session inside an operator; callers pass one in.
These defaults only describe how *we* start Spark locally: UTC, AQE with skew
handling, Arrow for the pandas paths, no web UI.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults."""
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or max(8, cpus * 2))
    conf.setdefault("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, durable folder and is
    always respected.  Only local runs (tests, bench) without that setting get a
    fresh folder under /tmp; a cluster without it is an error, as its hosts would
    each see files of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in the executors' Python workers.

    Pandas UDFs and grouped-map functions are pickled by module reference; the
    package is zipped once per SparkContext and distributed with
    ``addPyFile`` (the standard way to ship Python code to a cluster)."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-pyfiles-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def prepare(spark: SparkSession) -> str:
    """Checkpoint folder + shipped package: what every query needs first."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local).

    The frame is persisted first so the checkpoint write reuses the rows
    computed for the eager count instead of recomputing the lineage; the
    cache is released once the checkpoint files exist.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and
    read it back: a durable, column-pruned cut of the lineage (used for index
    tables that several jobs read)."""
    import uuid
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex[:10]}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
