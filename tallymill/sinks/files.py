"""Report and dataset files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymill.folders import Folder
from tallymill.session import scratch_path

#: Size of a report as Parquet from which on it is several files.
FILE_BYTES = 128 << 20
#: Complete versions of a table that stay.
VERSIONS = 2


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report_csv(
    df: DataFrame, path: str, order_by: list[str] | None = None, file_bytes: int = FILE_BYTES
) -> None:
    """A report as CSV with a header, in one file where it is of ordinary size.

    A result that is larger than a file should be stays in several, and with
    ``order_by`` their names follow that order. The report is written to the
    shared folder first, which says how large it is and keeps the parallelism of
    the work before.
    """
    if not order_by:
        df.hint("rebalance").write.mode("overwrite").option("header", True).csv(path)
        return
    place = scratch_path(df.sparkSession, "report")
    df.write.parquet(place)
    folder = Folder(df.sparkSession, place)
    parts = max(1, -(-folder.size("") // file_bytes))
    written = df.sparkSession.read.schema(df.schema).parquet(place)
    ranged = written.repartitionByRange(parts, *order_by) if parts > 1 else written.coalesce(1)
    ranged.sortWithinPartitions(*order_by).write.mode("overwrite").option("header", True).csv(path)
    folder.remove("")


def show(df: DataFrame, rows: int = 20) -> None:
    """Print the first rows; nothing more leaves the cluster."""
    df.show(rows, truncate=False)


def has_delta(spark: SparkSession) -> bool:
    """Whether this session can write the Delta format."""
    return "io.delta" in spark.conf.get("spark.sql.extensions", "")


def _versions(folder: Folder) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in folder.names() if n.startswith("version="))


def _complete(folder: Folder) -> list[int]:
    return [v for v in _versions(folder) if folder.exists(f"version={v}/_SUCCESS")]


def _claim(folder: Folder) -> int:
    """A version that no other writer has, whether or not it is still at work."""
    claimed = [int(n) for n in folder.names("_claims") if n.isdigit()]
    version = max([*_versions(folder), *claimed], default=-1) + 1
    while True:
        try:
            folder.publish(f"_claims/{version:010d}", "")
            return version
        except RuntimeError:
            version += 1


def overwrite_versioned(df: DataFrame, location: str, fmt: str | None = None, keep: int = VERSIONS) -> None:
    """Replace a whole table so that readers see the old rows or the new ones.

    A transactional format does this itself. Without one, each overwrite is a new
    Parquet folder, which counts once its success marker is there; the job may
    therefore read the table it replaces, and a lost job changes nothing. Writers
    claim their version before they write it, so two of them never write one
    folder; the one that claims later wins. Of the complete versions the last
    ``keep`` stay, for those who are reading them.
    """
    spark = df.sparkSession
    fmt = fmt or ("delta" if has_delta(spark) else "parquet")
    if fmt != "parquet":
        df.write.format(fmt).mode("overwrite").save(location)
        return
    folder = Folder(spark, location)
    version = _claim(folder)
    df.write.mode("error").parquet(f"{location}/version={version}")
    complete = _complete(folder)
    for old in complete[: max(0, len(complete) - max(keep, 1))]:
        folder.remove(f"version={old}")
        folder.remove(f"_claims/{old:010d}")


def read_versioned(spark: SparkSession, location: str, fmt: str | None = None) -> DataFrame:
    """The rows of the last complete overwrite."""
    fmt = fmt or ("delta" if has_delta(spark) else "parquet")
    if fmt != "parquet":
        return spark.read.format(fmt).load(location)
    complete = _complete(Folder(spark, location))
    if not complete:
        raise FileNotFoundError(f"no complete version of {location}")
    return spark.read.parquet(f"{location}/version={complete[-1]}")
