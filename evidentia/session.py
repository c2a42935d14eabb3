"""Sessions, tables and durable cuts of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "evidentia", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_folder(spark: SparkSession) -> str:
    """The folder for cuts: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a temporary one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="evidentia-cut-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back from there.

    The files outlive lost executors, are compressed, and later readers take only the columns they
    need. They are removed when the driver ends. With ``tidy`` the shuffle files behind them go at
    once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{cut_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    if not _CUTS:
        atexit.register(_remove_cuts)
    _CUTS.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CUTS: list[tuple[SparkSession, str]] = []


def _remove_cuts() -> None:
    for spark, path in _CUTS:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended before
            return


def spread(df: DataFrame, per_core: int = 2, at_most: int = 4096) -> int:
    """A partition count for Python-heavy stages: a few tasks for each core of the cluster."""
    sc = df.sparkSession.sparkContext
    return max(2, min(at_most, sc.defaultParallelism * per_core))


def widen(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` in enough partitions for every core.

    Input that already has as many partitions as the cluster has cores, which holds for any large
    input, is left as it is: no shuffle. Only small inputs in few files are dealt out anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * per_core)
