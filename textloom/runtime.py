"""Session helpers shared by all operators: the shared folder, durable tables, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_OWN_DIR: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what ``spark.checkpoint.dir`` names. Only in local mode, where every task runs on this
    machine, is a temporary folder made if the setting is absent; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN_DIR:
        _OWN_DIR[sc.applicationId] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _OWN_DIR[sc.applicationId], ignore_errors=True)
    return _OWN_DIR[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; then whoever owns the folder clears it
        pass


#: Spark then removes a finished query's shuffle files at once, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder as compressed Parquet and read it back.

    Cuts the lineage like checkpoint(), survives the loss of executors, but stores columns compressed.
    The table is removed by release(), at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def clear(spark: SparkSession) -> None:
    """Remove all tables that durable() has made in this application's shared folder; for a driver that lives long, between queries whose results are no longer read."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        _remove(spark, path)


def release(*tables: DataFrame) -> None:
    """Remove tables made by durable() that nothing will read again."""
    for t in tables:
        _remove(t.sparkSession, t._textloom_path)


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with the columns of ``ddl`` behind its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; Parquet pushes filters and columns down into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def split_join(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", hot_rows: int = 1_000_000, weight: str | None = None) -> DataFrame:
    """``big`` joined with ``small`` (one row a key) on ``key``, whatever the keys' skew; inner or left.

    Keys that more than ``hot_rows`` rows of ``big`` have are joined by a broadcast of their rows of
    ``small``, so no task gets a hot key's rows together; there are fewer than rows / hot_rows of
    them. The other keys are joined as Spark chooses. How many rows a key has is counted in one pass
    that combines before the shuffle, or read from the column ``weight`` of ``small``. Tables that are
    costly to compute should be written first, as they are read more than once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if weight is None:
        found = big.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).drop("__n").toArrow()
    else:
        found = small.where(F.col(weight) > hot_rows).select(*keys).toArrow()
        small = small.drop(weight)
    if not found.num_rows:
        return big.join(small, keys, how)
    hot = F.broadcast(big.sparkSession.createDataFrame(found))
    few = F.broadcast(small.join(hot, keys, "left_semi"))
    return big.join(hot, keys, "left_anti").join(small, keys, how).unionByName(big.join(hot, keys, "left_semi").join(few, keys, how))


def sieved(big: DataFrame, small: DataFrame, key: str, bits: int = 1 << 27) -> DataFrame:
    """The rows of ``big`` whose ``key`` may be in ``small``, before an inner join on it: all that are, few of the others.

    The keys of ``small`` are marked by one hash in a bitmap, which is broadcast in pieces of 4 KB. It has 16 to
    32 bits a key, and ``bits`` at most (16 MB), which then let about n / bits of the other rows pass with n keys.
    ``small`` is read twice.
    """
    room = min(bits, 1 << max(15, (32 * small.count()).bit_length() - 1))
    place = F.pmod(F.xxhash64(key), F.lit(room))
    pieces = small.select(F.shiftright(place, 15).alias("__piece"), (place % (1 << 15)).alias("at")).repartition("__piece").groupBy("__piece").agg(F.bitmap_construct_agg("at").alias("__map"))
    byte = F.conv(F.hex(F.expr("substring(__map, cast(__place % 32768 div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    marked = (F.shiftright("__place", 15) == F.col("__piece")) & (F.getbit(byte, (F.col("__place") % 8).cast("int")) == 1)
    return big.withColumn("__place", place).join(F.broadcast(pieces), marked, "left_semi").drop("__place")
