"""Session helpers: a tuned local session for tests/bench and the shared
folder used for checkpoints and written intermediate tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "ledgerlens") -> SparkSession:
    """Session for tests and the local bench.  On a cluster the caller owns
    the session; nothing in the library depends on these settings."""
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # no broadcast from planner estimates; AQE broadcasts a join side
        # only after measuring its actual shuffle size at run time
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # checkpoints go when nothing refers to them any longer
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # per-call Python call-site capture costs milliseconds per Column
        # function; wide generated plans make thousands of such calls
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    The setting is read from the session.  Only a local-mode session with no
    setting (tests, bench) gets a fresh scratch folder of its own; a cluster
    session without one is an error, since a machine-local folder would not
    be visible to the executors.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the setting
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
        return named.rstrip("/")
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for a written table."""
    base = shared_dir(spark)
    return os.path.join(base, "tables", f"{name}-{os.getpid()}-{_next_id()}")


_counter = [0]


def _next_id() -> int:
    _counter[0] += 1
    return _counter[0]
