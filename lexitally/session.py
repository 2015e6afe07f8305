"""Session construction and the shared working folder.

Everything that must survive an executor loss (streaming checkpoints, result
tables that cut lineage) lives under the folder the cluster names in
``spark.checkpoint.dir``.  Only where that is unset (tests, the bench) a folder
below the session's warehouse is used, which all executors share as well.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_RUN = uuid.uuid4().hex
_cleaned: set[str] = set()


def build_session(master: str | None = None, app_name: str = "lexitally",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session configured the way every job here expects.

    * UTC session zone, so NTZ event times cast to TIMESTAMP keep their value.
    * AQE on: shuffle partitions are coalesced at runtime, skewed join
      partitions are split, and small join sides are broadcast only once their
      real (runtime) size is known to be under the threshold.
    * UI off: no server or port beyond what the session itself needs.
    * RocksDB state store for streaming aggregations.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # streaming state: RocksDB keeps large state off-heap and commits
        # incrementally (changelog) instead of snapshotting whole maps
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote session has no local context
        return None


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for working files: ``spark.checkpoint.dir``, else one
    below the warehouse."""
    sc = _context(spark)
    value = spark.conf.get(CHECKPOINT_KEY, None) or \
        (sc.getConf().get(CHECKPOINT_KEY, None) if sc is not None else None)
    if value:
        return value.rstrip("/")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lexitally-work/{_RUN}"
    if own not in _cleaned and own.startswith(("file:/", "/")):
        atexit.register(shutil.rmtree, re.sub("^file:/+", "/", own), True)      # scratch of this run
        _cleaned.add(own)
    return own


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique location under the shared folder."""
    base = shared_dir(spark)
    return "/".join([base, *parts, uuid.uuid4().hex])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers (as ``--py-files`` would), once an application.

    Functions that run inside tasks import it by name; a worker started
    elsewhere than in the repository would not find it.
    """
    sc = _context(spark)
    if sc is None or sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # the driver serves this file to executors that start later, too
    folder = tempfile.mkdtemp(prefix="lexitally-ship-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / "lexitally.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def ensure_utc(spark: SparkSession) -> None:
    """Event-time logic reads NTZ times as UTC; pin the session zone to UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
