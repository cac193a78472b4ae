"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder for one run's written tables."""
    return f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


MOST_BITS = 60  # of a size estimate in bytes


def unsized(df: DataFrame) -> DataFrame:
    """The same rows without the planner's guess of their size, so joins wait for what shuffles measure.

    The guess knows nothing of rows that an explode adds or of how well a file was packed. A side guessed
    small is broadcast through the driver whatever it holds: adaptive execution does not take a planned
    broadcast back, since that would cost one more shuffle.
    """
    fresh = df.sparkSession._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    return DataFrame(fresh, df.sparkSession)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor costs no recomputation of loops.

    A checkpoint keeps the size that the planner had guessed, and a join's guess is the product of its
    sides: in a loop that joins its state with itself the guess squares every round, until planning does
    nothing but multiply. A guess beyond all sizes is dropped with the plan that made it.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    if done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= MOST_BITS:
        return done
    return unsized(done)
