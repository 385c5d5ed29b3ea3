"""Session construction and shared-storage helpers.

Every job in this package is a plain ``DataFrame -> DataFrame`` function; the
only process-level concerns are the session settings (AQE, skew handling,
Arrow) and where intermediate state may be written.  Intermediate state is
always written under ``spark.checkpoint.dir`` — the shared folder a cluster
names — never a machine-local temporary folder.  A local default is set only on
a ``local`` master whose session has none (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "evalspark", extra: dict | None = None) -> SparkSession:
    """Session with the settings every job here assumes.

    AQE coalesces small shuffles, splits skewed join partitions and turns a
    sort-merge join into a broadcast join only from *measured* runtime sizes.
    The static auto-broadcast threshold is kept at Spark's default; explicit
    broadcasts in this package are limited to tables of proven size.
    """
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("EVALSPARK_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(executors: int = 1000, cores_per_executor: int = 8,
                 advisory_mb: int = 256) -> dict[str, str]:
    """Settings for a large cluster (≈100 TB inputs); pass as ``extra``.

    Shuffle partitions start high (AQE coalesces them to ``advisory_mb`` by
    measured size, ``parallelismFirst`` off so the advisory size wins); skewed
    join partitions are split at 4× the median; scans split at 256 MB.  The
    checkpoint folder must be a shared path and is *not* set here.
    """
    cores = executors * cores_per_executor
    return {
        "spark.sql.shuffle.partitions": str(max(2000, 4 * cores)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{advisory_mb}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.session.timeZone": "UTC",
    }


def _spark_context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        return None


def _is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "").startswith("local") and \
        not spark.conf.get("spark.master", "").startswith("local-cluster")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    A session that names none gets a temporary folder on a ``local`` master
    (tests, bench).  Anywhere else that folder would exist on one machine
    only, so it is an error.
    """
    sc = _spark_context(spark)
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        if not _is_local(spark):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="evalspark-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/evalspark/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB: on the executors'
    disks, with snapshots in the stream's checkpoint folder."""
    old = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_PROVIDER) if old is None else spark.conf.set(STATE_PROVIDER, old)


def read_if_exists(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None if nothing was written there yet.
    Any other failure (a schema clash, a damaged file) is raised."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``evalspark`` importable in Python workers (``addPyFile``).

    Grouped-map and map-in-pandas functions are pickled by module reference,
    so every worker must import this package.  When the driver's working
    directory is not the repository root the workers cannot; a zip of the
    package is shipped once per application (the runtime form of
    ``--py-files``).  On a cluster where the package is installed this is a
    harmless extra path entry.
    """
    import zipfile

    sc = _spark_context(spark)
    if sc is None:
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    ckpt = ensure_checkpoint_dir(spark) or ""
    if "://" in ckpt and not ckpt.startswith("file:"):
        # A shared cluster folder: the package is installed on the executors
        # (or passed with --py-files); nothing is written to local disk here.
        _SHIPPED.add(app)
        return
    dest = os.path.join(ckpt.replace("file:", "", 1), "evalspark-pyfiles")
    os.makedirs(dest, exist_ok=True)
    zpath = os.path.join(dest, f"evalspark-{app}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
