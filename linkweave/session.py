"""Session helpers: building a session for tests/bench and locating shared scratch space.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by the
cluster). A default is only installed when the setting is absent, which is the
case in tests on a laptop.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "linkweave", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_LOCAL_FALLBACK: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present and is only read; without it this
    raises, because a machine-local folder is not shared between executors. Only a
    single-JVM ``local`` session (a laptop, tests) gets a temporary folder instead,
    registered as the context's checkpoint dir; the static setting itself cannot
    change at runtime.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        d = _LOCAL_FALLBACK.get(app)
        if d is None:
            d = _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="linkweave-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/linkweave/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so plain-OS helpers can look at local test paths."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str):
    """A small literal DataFrame as a local relation (exact size statistics, no RDD behind it)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    names = [f.name for f in st.fields]
    if not rows:
        return spark.createDataFrame([], st)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs))).select(*names)


def materialize(df, name: str):
    """Write ``df`` once to a fresh folder under the shared checkpoint dir and read it back.

    Cuts lineage (a lost executor does not recompute upstream stages) with a single
    job, and the re-read table has exact size statistics for the planner.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _SCRATCH.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.parquet(path)


_SCRATCH: dict[str, list[str]] = {}


def scratch_tables(spark: SparkSession) -> list[str]:
    """Folders that ``materialize`` has written in this application and nobody has released yet."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def release_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables once every result that reads them has been written."""
    known = _SCRATCH.get(spark.sparkContext.applicationId, [])
    sc = spark.sparkContext
    for p in paths:
        if p in known:
            jp = sc._jvm.org.apache.hadoop.fs.Path(p)
            jp.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jp, True)
            known.remove(p)
