"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes that go to Python in one batch (one row at least).
BATCH_BYTES = 8 * 1024 * 1024

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; explicit settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # long texts: a batch sent to Python is bounded in bytes as well as in rows
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as into:
        for path in sorted(root.rglob("*.py")):
            into.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose batches to Python are bounded in bytes, so that long rows don't add up in a task.

    The bound is a setting of the session, which ``build_session`` makes. In a session without
    it, it is lowered to BATCH_BYTES here (never raised) and stays so, since frames run later.
    """
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests), a temporary folder takes its
    place. On a cluster without the setting this raises, since a machine-local folder
    would lose tables together with an executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def write_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation), and gives the planner
    the true size, so that a small table is broadcast only when it *is* small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
