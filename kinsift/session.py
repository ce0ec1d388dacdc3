"""Session defaults and the two places every job needs: its tables and its scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}


def build_session(app: str = "kinsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings all operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session.

    Only a local master may do without the setting; it then gets a temporary folder of its own. Tables that loops
    don't drop stay until clean() or the end of the programme."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="kinsift-")
            atexit.register(shutil.rmtree, base, True)
            base = f"file://{base}"
        _SCRATCH[app] = f"{base.rstrip('/')}/kinsift-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before work that is heavy by row: a scan of few small files has few tasks. Scans (with
    columns and conditions at most) that have as many partitions as cores stay as they are. What a shuffle feeds
    is dealt out anew, without running it to count its partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" not in plan.sparkPlan().toString() and "Join" not in plan.optimizedPlan().toString() and "Aggregate" not in plan.optimizedPlan().toString():
        return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
    return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the scratch folder and read again: its lineage ends there, so a lost
    executor costs no more than the stage at hand."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinsift_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a table made by cut() that no later plan reads."""
    path = getattr(df, "_kinsift_path", None)
    if path:
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Removes all tables of the session's scratch folder; results that aren't written yet can't be read then."""
    path = _SCRATCH.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    """At the end of the programme; a session that is stopped by then leaves its folder to the cluster."""
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001
        pass
