"""Session helpers: a local session, shared scratch space and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side table may be broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20

_local_dirs: dict[str, str] = {}


def local_session(app: str = "tallymill", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local master may fall back on a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tallymill-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A written table cuts the lineage, survives lost executors, and later reads
    of it prune columns and push down filters.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` reads."""
    spark = df.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = [path(name) for name in df.inputFiles()]
    return sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in files)


def spread(df: DataFrame, finer: int = 1) -> DataFrame:
    """Give every core a part of a table before expensive work on each row.

    A table in one small file is one task. A table in more parts than there are
    cores, as any large one is, is returned as it is and not shuffled. Meant for
    a plain scan: counting the parts of a shuffled plan would run it.

    Where rows are kept or grow a lot, ``finer`` cuts each part of the scan, which
    is bounded in bytes, into so many, however large the table is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    scanned = df._jdf.queryExecution().toRdd().getNumPartitions()
    if scanned < cores or finer > 1:
        return df.repartition(max(cores, scanned * finer))
    return df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast, by its rows and by their size as JSON.

    Looking at it stops at ``max_rows + 1`` rows, one more than a small table has.
    """
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    rows, held = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return rows <= max_rows and held <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side table for broadcasting, but only after counting its rows and bytes.

    A larger table is returned as it is and takes part in a shuffled join, which
    adaptive execution splits where a key is skewed.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
