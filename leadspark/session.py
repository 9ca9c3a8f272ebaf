"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings a job needs regardless of cluster size.  Partition counts are left
# to AQE (coalescing + skew-join split) instead of being fixed per query.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # remove checkpoint files once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "leadspark",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when it is unset (local tests) a private scratch folder is
    created, so lineage cuts work in tests too.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir and not sc.master.startswith("local"):
        refuse_own_folder(conf_dir)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(written intermediates must survive lost executors)")
        conf_dir = tempfile.mkdtemp(prefix="leadspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def refuse_own_folder(path: str) -> None:
    """Raise if ``path`` lies in this machine's temporary folder, which other machines don't see.

    Another ``file:`` path may be a mount that all machines share.
    """
    if path.startswith("file:"):
        own = os.path.realpath(path.removeprefix("file:").replace("//", "/"))
        for top in {"/tmp", "/var/tmp", tempfile.gettempdir()}:
            if own == top or own.startswith(os.path.realpath(top) + "/"):
                raise RuntimeError(f"spark.checkpoint.dir is {path}, in the temporary folder of one machine: "
                                   "name a folder that all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint location for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def freeze(df, name: str = "frozen"):
    """Cut lineage with a written table in the session's checkpoint folder.

    The plan runs once (an eager ``checkpoint()`` runs it twice unless the
    data is also cached), the files survive lost executors, and reading them
    back gives partitions sized by ``spark.sql.files.maxPartitionBytes``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver found it (once per application).

    The package goes as a zip file to the checkpoint folder, from which Spark
    hands it to each executor.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "leadspark")):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, root))
    target = scratch_path(spark, f"package/{uuid.uuid4().hex}/leadspark.zip")
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def input_bytes(spark: SparkSession, paths) -> int:
    """Total size of the given files/folders, via the Hadoop file system of each path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            total += fs.getContentSummary(path).getLength()
    return int(total)


def size_shuffle_partitions(spark: SparkSession, paths, bytes_per_partition: int = 64 << 20) -> int:
    """Set ``spark.sql.shuffle.partitions`` from the input size.

    About one partition per ``bytes_per_partition`` of (compressed) input,
    never fewer than twice the default parallelism; AQE then coalesces small
    partitions and splits skewed ones.  At 100 TB this gives about 1.6 million
    partitions, on a laptop-sized sample a few dozen.
    """
    n = -(-input_bytes(spark, paths) // bytes_per_partition)
    n = int(max(2 * spark.sparkContext.defaultParallelism, n))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


_MEMO: dict = {}


def data_identity(spark: SparkSession, d: str) -> str:
    """Names, sizes and times of the files below a data folder: another value once any of them changes."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(d)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def memo(spark: SparkSession, d: str, name: str, build, fresh: bool = False):
    """``build()``, once per application and state of the files of ``d``, until ``forget``."""
    key = (spark.sparkContext.applicationId, data_identity(spark, d), name)
    if fresh or key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def forget(spark: SparkSession | None = None) -> None:
    """Drop what ``memo`` holds (of one application)."""
    for k in [k for k in _MEMO if spark is None or k[0] == spark.sparkContext.applicationId]:
        del _MEMO[k]


_TABLES: set = set()


def keep_table(spark: SparkSession, name: str) -> None:
    """Note a catalog table of this application, to be dropped by ``cleanup_scratch``."""
    _TABLES.add((spark.sparkContext.applicationId, name))


def cleanup_scratch(spark: SparkSession) -> None:
    """Delete this application's written intermediates (its own sub-folder of the
    checkpoint folder; other applications' folders are not touched).  Call at
    the end of a job, after the last DataFrame reading them is used."""
    sc = spark.sparkContext
    forget(spark)  # their files go now
    for app, name in [t for t in _TABLES if t[0] == sc.applicationId]:
        spark.sql(f"drop table if exists {name}")
        _TABLES.discard((app, name))
    d = sc.getCheckpointDir()
    if not d:
        return
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(d)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)
