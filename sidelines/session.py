"""Session construction and lineage control.

Cluster jobs get their checkpoint folder from ``spark.checkpoint.dir``, which
the cluster operator sets to a shared, fault-tolerant location.  Only when it
is unset (local tests) do we pick a scratch folder ourselves.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast joins only below a fixed, checked size; AQE re-plans with real sizes.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _submitted_master(conf_cls) -> bool:
    """Whether the launcher already chose a master.

    ``SparkConf`` sees it once the JVM runs (spark-submit starts the JVM before
    Python); before that only the submit arguments can carry one.
    """
    from pyspark import SparkContext
    if SparkContext._jvm is not None or "PYSPARK_GATEWAY_PORT" in os.environ:
        return conf_cls().contains("spark.master")
    args = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    return "--master" in args or "spark.master" in args or "MASTER" in os.environ


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "sidelines", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine's defaults.

    A master set by spark-submit, spark-defaults or a running session is never
    overridden: ``local[$BENCH_CPUS or *]`` and the local driver memory apply
    only when ``SparkConf`` names no master and the caller names none.
    """
    from pyspark import SparkConf, SparkContext
    b = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    if master is None and SparkContext._active_spark_context is None and not _submitted_master(SparkConf):
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if master:
        b = b.master(master)
        if master.startswith("local"):
            conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sidelines`` importable on the executors' Python workers.

    Pandas functions (``applyInPandas``, ``mapInPandas``, pandas UDFs) run
    in worker processes that import the helpers they reference.  The package
    is zipped once per SparkContext and distributed with ``addPyFile`` (what
    ``spark-submit --py-files`` does), so workers find it wherever they run.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="sidelines-pyfiles-"), "sidelines.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Where it is unset a scratch folder is made only for a one-machine master
    (``local[...]``, as in tests); on a cluster executors could not share such
    a folder, so the call fails and says what to set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sidelines-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, mode: str = "table") -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and continue from it.

    ``mode='table'`` (default) writes a parquet table under
    ``spark.checkpoint.dir`` and reads it back: columnar and vectorised, and
    the new scan carries real size statistics for AQE.  ``mode='checkpoint'``
    uses ``DataFrame.checkpoint``.  Both survive executor loss (unlike
    ``localCheckpoint``) and stop plans from growing without bound.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if mode == "checkpoint":
        return df.checkpoint(eager=True)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
