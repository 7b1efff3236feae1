"""Session helpers: one place that builds a SparkSession and resolves the
shared checkpoint / scratch folders.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a
shared file system path set by the cluster operator). A local session without
one, as in tests and benchmarks, gets a fresh temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tessera") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("TESSERA_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. Only a local session, all of whose
    tasks run on this machine, may have a temporary one; a cluster must name a
    folder that its executors share."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def _status(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for any kind of URI."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _status(spark, path)
    return bool(fs.exists(target))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _status(spark, path)
    return bool(fs.getFileStatus(target).isDirectory())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables.

    Used where lineage must be cut or an intermediate table must survive an
    executor loss: the path lives on the shared file system, never on a
    machine-local temporary folder.
    """
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str, mode: str = "overwrite", path: str | None = None):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage (recovery after an executor loss re-reads the
    files instead of recomputing) and gives later self-joins a clean plan."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode(mode).parquet(path)
    return spark.read.parquet(path)


_DERIVED = ("Join", "Aggregate", "Union", "Window", "Generate", "Expand", "Sort", "Repartition", "MapIn", "FlatMap")


def stage_input(df, name: str = "stage"):
    """For an operator that reads its input in several separate jobs: when
    the input is itself derived (joins, aggregates, unions ...), write it
    once to the shared checkpoint folder and read that instead of recomputing
    it in every job. A plain (pruned) file scan is returned unchanged.
    (Branches of ONE lazy plan need no staging: Spark reuses their common
    exchanges.)"""
    return materialize(df, name) if any(n.startswith(_DERIVED) for n in _node_names(df._jdf.queryExecution().optimizedPlan())) else df


def _node_names(plan):
    """Names of the operators of a logical plan."""
    yield plan.nodeName()
    children = plan.children()
    for i in range(children.size()):
        yield from _node_names(children.apply(i))
