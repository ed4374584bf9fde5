"""Session helpers: building a session, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "graphloom", master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the library expects: UTC, AQE with skew handling, Arrow.

    ``conf`` takes further settings with ``__`` in place of dots.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset and the session is a
    plain local one, as in tests, a temporary folder serves; elsewhere it is an error, since a
    folder of one machine would not survive the loss of that machine.
    """
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_KEY)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, for Python stages over an input that has fewer partitions than that.

    A small Parquet file is one row group and thus one task, however many cores wait; an input with as
    many partitions as cores is returned as it is, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def fresh_name(taken: list[str], wish: str) -> str:
    """A column name that clashes with none of ``taken``, compared without regard to case."""
    low = {name.lower() for name in taken}
    name, n = wish, 1
    while name.lower() in low:
        n += 1
        name = f"{wish}_{n}"
    return name
