"""Session helpers: one place for Spark settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for every job in this library. AQE re-plans joins and
# coalesces partitions from runtime statistics; skew-join splits hot keys.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts travel to Python: 10,000 of them would not be a small batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    # A task that writes by partitions keeps so many files open and does not sort (and spill) its rows first.
    "spark.sql.maxConcurrentOutputFileWriters": "32",
    # map_concat in the evidence injection (JSN2) lets the injected key win.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # JSON objects with a repeated key are valid, the last value wins (as json.loads does).
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_spark(master: str | None = None, app: str = "strata", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build or fetch a session with the library defaults.

    On a cluster ``master`` stays None so spark-submit decides; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable defaults to an existing session (e.g. the driver's) and
    make the package importable by its Python workers."""
    for k, v in DEFAULT_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (what ``--py-files`` does), once
    per application. UDFs and the kNN kernel are defined in package modules, so a worker
    must be able to import them whatever the driver's working directory is."""
    try:
        sc = spark.sparkContext
    except Exception:  # a remote session ships code its own way
        return
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="strata-pyfiles-"), "strata.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, dirs, files in os.walk(pkg):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


_LOCAL_DIRS: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for lineage cuts and intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint directory). Only when
    neither is set (local tests) is a local folder created; it is registered with
    ``setCheckpointDir``, since the conf itself cannot change on a running session."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = _LOCAL_DIRS.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="strata-ckpt-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused, never cleared)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/strata/{name}-{uuid.uuid4().hex[:12]}"


def input_version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: a key under which what was made of it can be kept."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


_MATERIALIZED: dict = {}


def materialize(spark: SparkSession, df_fn, name: str, key=None, partition_by: list | None = None):
    """Write ``df_fn()`` once per session (and ``key``) as Parquet under the shared folder and
    return a DataFrame reading it back. A written table cuts the lineage, so a lost executor
    recomputes from the table, not from the whole upstream plan."""
    k = (spark.sparkContext.applicationId, name, key)
    if k not in _MATERIALIZED:
        path = scratch_path(spark, name)
        w = df_fn().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        _MATERIALIZED[k] = path
    return spark.read.parquet(_MATERIALIZED[k])


def list_files(path: str, suffix: str):
    """(file system, sorted file names) of a folder in the shared folder, for use in a task."""
    from pyarrow import fs
    files, root = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(root))
    return files, sorted(f.path for f in found if f.path.endswith(suffix))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem API (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))
