"""CSV files that a manifest names, read without a list of them on the driver.

The manifest is cut into stretches of bytes, each of which is a task: it reads
the lines that begin in its stretch and the files they name. So the driver knows
the size of the manifest and nothing else, and a million paths are as many tasks
as they have stretches.

Tasks open files by themselves, through the file systems that Arrow knows: local
and shared folders, S3, GCS and HDFS where its client library is installed.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of a manifest that are one task.
STRETCH = 1 << 16
#: Bytes of a CSV file that are parsed at once.
BLOCK = 4 << 20

_FORMAT = "csv_manifest"

# The source travels with the job, so the executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> Iterator[tuple[fs.FileSystem, fs.FileInfo]]:
    """A file, or the files below a folder but for hidden ones; it is an error if there is neither."""
    system, at = _open(path)
    (info,) = system.get_file_info([at])
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path} is not there")
    if info.type == fs.FileType.File:
        yield system, info
        return
    for found in sorted(system.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda f: f.path):
        inner = found.path[len(at.rstrip("/")) :].split("/")
        if found.type == fs.FileType.File and not any(name.startswith(("_", ".")) for name in inner):
            yield system, found


@dataclass
class Stretch(InputPartition):
    """Bytes of a file of the manifest."""

    path: str
    file: str
    first: int
    end: int


def _lines(system: fs.FileSystem, stretch: Stretch) -> Iterator[str]:
    """The lines that begin in a stretch."""
    with io.BufferedReader(system.open_input_file(stretch.file)) as file:
        at = stretch.first
        if at:
            # the line over the edge belongs to the stretch before
            file.seek(at - 1)
            at += len(file.readline()) - 1
        file.seek(at)
        while at < stretch.end:
            line = file.readline()
            if not line:
                return
            at += len(line)
            text = line.decode().strip()
            if text:
                yield text


class ManifestReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, header: bool, stretch: int) -> None:
        self.path, self.schema, self.header, self.stretch = path, schema, header, stretch

    def partitions(self) -> list[InputPartition]:
        return [
            Stretch(self.path, info.path, first, min(first + self.stretch, info.size))
            for _, info in _files(self.path)
            for first in range(0, info.size, self.stretch)
        ]

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, pa.string()) for name in self.schema.names])
        options = {
            # columns go by their place, as they do where Spark reads CSV by a schema
            "read_options": pc.ReadOptions(use_threads=False, block_size=BLOCK, skip_rows=int(self.header), column_names=schema.names),
            "parse_options": pc.ParseOptions(escape_char="\\", newlines_in_values=False),
            "convert_options": pc.ConvertOptions(column_types=schema, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False),
        }
        system, _ = _open(stretch.path)
        for line in _lines(system, stretch):
            for place, info in _files(line):
                if info.size == 0:
                    continue
                with place.open_input_stream(info.path, compression="detect") as stream:
                    try:
                        batches = pc.open_csv(stream, **options)
                    except pa.ArrowInvalid as error:
                        if "Empty CSV" in str(error):
                            continue
                        raise
                    for batch in batches:
                        if batch.num_rows:
                            yield batch


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def reader(self, schema: StructType) -> DataSourceReader:
        options = self.options
        return ManifestReader(options["path"], schema, options.get("header", "true") == "true", int(options.get("stretch", STRETCH)))


def read_large_manifest(
    spark: SparkSession, path: str, schema: StructType | str, header: bool = True, stretch: int = STRETCH
) -> DataFrame:
    """The CSV files whose paths a text file, or a folder of them, lists one a line.

    A path is a file or a folder, whose files are all read. Columns go by their
    place. Empty lines are skipped, files may be compressed, an empty field and
    one that is not of its type are NULL, and a path that is not there ends the
    job. For a manifest of some thousand paths
    :func:`tallymill.sources.files.read_manifest` is enough, which also reads from
    stores that only Spark knows.
    """
    spark.dataSource.register(ManifestSource)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    texts = StructType([StructField(f.name, StringType()) for f in schema])
    reader = spark.read.format(_FORMAT).schema(texts).option("header", str(header).lower())
    found = reader.option("stretch", stretch).load(path)
    return found.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
