"""Log-like text sources: event logs, XML log records, pattern logs, metrics."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    StringType,
    StructField,
    StructType,
)

from tallymill.functions.blocks import unpacked
from tallymill.session import broadcast_if_small

# --- application event logs -------------------------------------------------

APPLICATION_EVENT = "SparkListenerApplication"
APPLICATION_START = "SparkListenerApplicationStart"
APPLICATION_END = "SparkListenerApplicationEnd"


# The names of rolling logs, of their files, and of the codecs.
_ROLLING = r"/(?:log=)?eventlog_v2_([^/]+)/"
_ROLLED_FILE = r"/events_(\d+)_[^/]*?(\.compact)?(?:\.(?:zstd|lz4|snappy|lzf|gz))?$"
FRAMED = ("lz4", "snappy", "lzf")


def superseded_files(files: list[str]) -> list[str]:
    """Files of rolling logs that a compact file stands for.

    A compact file holds what is left of the files up to its number.
    """
    rolled = []
    for file in files:
        folder, name = re.search(_ROLLING, file), re.search(_ROLLED_FILE, file)
        if folder and name:
            rolled.append((file[: folder.end()], int(name[1]), name[2] is not None, file))
    compact: dict[str, int] = {}
    for log, number, is_compact, _ in rolled:
        if is_compact:
            compact[log] = max(number, compact.get(log, -1))
    return [
        file
        for log, number, is_compact, file in rolled
        if number < compact.get(log, -1) or (number == compact.get(log) and not is_compact)
    ]


def event_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line below a log folder with the log it belongs to.

    A rolling log is a folder of numbered files, a plain log is one file. The
    folder may be a partition that a job has written. Files that a compact file
    of their log stands for are not read. Files in the block formats that Spark
    writes with lz4, snappy and lzf are unpacked; each of them is held as a
    whole, as rolling logs have files of bounded size.
    """
    file = F.col("_metadata.file_path")
    rolling = F.regexp_extract(file, _ROLLING, 1)
    plain = F.regexp_extract(file, r"([^/]+?)(\.inprogress)?(\.(zstd|lz4|snappy|lzf|gz))?$", 1)
    log = F.coalesce(F.nullif(rolling, F.lit("")), plain).alias("log")
    modified = F.col("_metadata.file_modification_time").alias("modified")
    framed = file.rlike(rf"\.({'|'.join(FRAMED)})$")
    texts = spark.read.option("recursiveFileLookup", True).text(path)
    # a file without a host has one slash in the column and three in the list
    files = [re.sub(r"^(\w+):///", r"\1:/", f) for f in texts.inputFiles()]
    gone = superseded_files(files)
    known = texts.select(log, modified, "value", file.alias("file"), framed.alias("framed"))
    if any(f.endswith(tuple(f".{c}" for c in FRAMED)) for f in files):
        binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        packed = binary.where(framed).select(log, modified, "content", file.alias("file"))
        lines = packed.mapInArrow(_unpack_lines, "log string, modified timestamp, value string, file string")
        known = known.where(~F.col("framed")).drop("framed").union(lines.select("log", "modified", "value", "file"))
    if gone:
        known = known.join(broadcast_if_small(spark.createDataFrame([(f,) for f in gone], "file string")), "file", "left_anti")
    return known.select("log", "modified", "value")


def _unpack_lines(batches):
    for batch in batches:
        for log, modified, content, file in zip(*(batch.column(c) for c in ("log", "modified", "content", "file"))):
            lines = unpacked(content.as_py(), file.as_py().rsplit(".", 1)[1]).decode("utf-8", "replace").split("\n")
            lines = [line.removesuffix("\r") for line in (lines[:-1] if lines[-1] == "" else lines)]
            for first in range(0, len(lines), 10_000):
                part = lines[first : first + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([log.as_py()] * len(part)), pa.array([modified.as_py()] * len(part), modified.type), pa.array(part), pa.array([file.as_py()] * len(part))],
                    names=["log", "modified", "value", "file"],
                )


def parse_event_log(lines: DataFrame) -> DataFrame:
    """Typed columns of event-log lines; needs ``log``, ``modified`` and ``value``.

    The event name comes first in every line, so a match at its beginning finds
    it before any JSON is parsed. The other fields are read for the start and
    end of an application only.
    """
    event = F.regexp_extract("value", r'^\s*\{\s*"Event"\s*:\s*"([^"]+)"', 1)
    tagged = lines.withColumn("event", F.nullif(event, F.lit("")))
    framing = F.col("event").isin(APPLICATION_START, APPLICATION_END)

    def field(name: str) -> Column:
        return F.when(framing, F.get_json_object("value", f"$['{name}']"))

    return tagged.select(
        "log",
        "modified",
        "event",
        field("App ID").alias("app_id"),
        field("App Name").alias("app_name"),
        field("User").alias("user"),
        field("Timestamp").try_cast("long").alias("ts_ms"),
        "value",
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Application event logs below a folder as one table."""
    return parse_event_log(event_log_lines(spark, path))


# --- XML log records --------------------------------------------------------

#: Writers of the tests separate records by an empty line.
RECORD_SEPARATOR = "\n\n"
# Fixed value: the tag a record ends with.
RECORD_END = "</Event>"
# A line that opens an event element, or any element behind an empty line, begins a record.
_RECORD_START = r"\r?\n\s*(?=<(?:\w+:)?\w*Event[\s>/])|\r?\n[ \t]*\r?\n\s*(?=<[A-Za-z])"

_FRAME = StructType(
    [
        StructField(name, StringType())
        for name in ("_class", "_method", "_file", "_line", "_exact", "_location", "_version")
    ]
)
# Numbers stay text here; the validation casts them and says what is wrong.
LOG_EVENT = StructType(
    [
        StructField("_timeMillis", StringType()),
        StructField("_level", StringType()),
        StructField("_loggerName", StringType()),
        StructField("_thread", StringType()),
        StructField("_threadId", StringType()),
        StructField("_threadPriority", StringType()),
        StructField(
            "Instant",
            StructType(
                [
                    StructField("_epochSecond", StringType()),
                    StructField("_nanoOfSecond", StringType()),
                    StructField("_VALUE", StringType()),
                ]
            ),
        ),
        StructField("Message", StringType()),
        StructField(
            "Thrown",
            StructType(
                [
                    StructField("_name", StringType()),
                    StructField("_localizedMessage", StringType()),
                    StructField("_message", StringType()),
                    StructField(
                        "ExtendedStackTrace",
                        StructType([StructField("ExtendedStackTraceItem", ArrayType(_FRAME))]),
                    ),
                ]
            ),
        ),
        StructField("_corrupt_record", StringType()),
    ]
)


def read_log4j_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per XML log record, as raw text.

    Records end with their closing tag, so what stands between them, one line
    break of either kind, empty lines or nothing, does not matter, and a message
    may hold empty lines. The records are cut apart before anything parses them,
    so one that is never closed cannot swallow its neighbours. A record that is
    cut off at the end of a file gets a closing tag.
    """
    chunks = spark.read.option("lineSep", RECORD_END).text(path)
    rows = chunks.select(F.split("value", _RECORD_START).alias("parts")).select(
        F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part")
    )
    part = F.btrim("part", F.lit(" \t\r\n"))
    closed = (F.col("at") == F.col("n") - 1) & part.rlike(r"^<Event[\s>]") & ~part.rlike(r"^<Event[^<]*/>$")
    # a message that ends in white space keeps it: only the outside of a record is trimmed
    record = F.when(closed, F.concat(F.ltrim("part"), F.lit(RECORD_END))).otherwise(part)
    return rows.select(F.btrim(record, F.lit(" \t\r\n")).alias("raw")).filter("raw <> ''")


# --- pattern layout ---------------------------------------------------------

# Fixed value: the layout is ``%d{ISO8601} %p [%t] %c - %m%n``.
PATTERN_LINE = (
    r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[,.]\d{3}) (\w+) \[(.*?)\] (\S+) - (.*)$"
)


def parse_pattern_log(lines: DataFrame, value: str = "value", others: list[str] | None = None) -> DataFrame:
    """Time, level, thread, logger and message; lines in another form keep only ``value``.

    One match per line puts the parts on lines of their own, which no part can
    contain.
    """
    matched = F.col(value).rlike(PATTERN_LINE)
    split = F.split(F.regexp_replace(value, PATTERN_LINE, "$1\n$2\n$3\n$4\n$5"), "\n", 5)
    part = F.col("_parts")
    others = others or []
    return lines.select(F.when(matched, split).alias("_parts"), F.col(value).alias("value"), *others).select(
        F.translate(part[0], "T,", " .").try_cast("timestamp").alias("ts"),
        part[1].alias("level"),
        part[2].alias("thread"),
        part[3].alias("logger"),
        part[4].alias("message"),
        "value",
        *others,
    )


#: Continuation lines that an event takes.
LONGEST_EVENT = 100_000

_ASSEMBLED = "file string, block long, line long, kind int, lines long, value string, rest string"
#: Kinds of assembled rows: a whole event, the last event of a block, a line
#: before the first event of a block, and a line that no event takes.
_WHOLE, _LAST, _EARLY, _ALONE = range(4)


def _assembler(edges: bool, longest: int):
    """Put continuation lines behind the event before them, within a block of a file.

    The lines of a block come in order. What may go on in another block, the last
    event and the lines before the first one, is given out with ``edges``, all
    else without.
    """

    def assemble(batches):
        place, event, rest, rows = None, None, [], []

        def close(kind: int) -> None:
            if event is not None and edges == (kind == _LAST):
                rows.append((*event[:3], kind, len(rest), event[3], "\n".join(rest) if rest else None))

        def flush():
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        names = [c.split()[0] for c in _ASSEMBLED.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "block", "line", "head", "value")]
            for file, block, line, head, value in zip(*columns):
                if (file, block) != place:
                    close(_LAST)
                    place, event, rest = (file, block), None, []
                if head:
                    close(_WHOLE)
                    event, rest = (file, block, line, value), []
                elif event is not None and len(rest) < longest:
                    rest.append(value)
                else:
                    kind = _EARLY if event is None else _ALONE
                    if edges == (kind == _EARLY):
                        rows.append((file, block, line, kind, 0, value, None))
            if rows:
                yield flush()
                rows.clear()
        close(_LAST)
        if rows:
            yield flush()

    return assemble


def _over_edges(edges: DataFrame, longest: int) -> DataFrame:
    """Events at the end of a block with the lines of the blocks behind it, and lines that belong to no event.

    Only these rows are shuffled, and by block; one row a block says which event
    its early lines belong to.
    """
    early, last = F.col("kind") == _EARLY, F.col("kind") == _LAST
    blocks = edges.groupBy("file", "block").agg(
        F.count(F.when(early, 1)).alias("early"), F.max(F.when(last, F.col("lines"))).alias("lines")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("lines").isNotNull(), F.struct("block", "lines")), ignorenulls=True).over(before)
    blocks = blocks.withColumn("owner", owner).select("file", "block", "early", F.col("owner.block").alias("event"), F.col("owner.lines").alias("taken"))
    since = Window.partitionBy("file", "event").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("taken") + F.coalesce(F.sum("early").over(since), F.lit(0)) >= longest
    owned = blocks.select("file", "block", F.when(~full, F.col("event")).alias("event"))
    lines = edges.where(early).join(owned, ["file", "block"])
    alone = lines.where("event IS NULL").select("value", "rest")
    more = lines.where("event IS NOT NULL").groupBy("file", F.col("event").alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n").alias("more")
    )
    events = edges.where(last).join(more, ["file", "block"], "left")
    return events.select("value", F.when(F.col("rest").isNotNull() | F.col("more").isNotNull(), F.concat_ws("\n", "rest", "more")).alias("rest")).union(alone)


def read_pattern_log(spark: SparkSession, path: str, longest: int = LONGEST_EVENT) -> DataFrame:
    """Events of log files in the pattern layout, with the lines that continue them.

    A line in another form, as those of a stack trace, belongs to the event
    before it in its file, also where the file is cut into blocks between the
    two; it goes on ``message`` and ``value`` after a line feed. A line before the
    first event of its file stays a row that has only ``value``. So does one
    behind ``longest`` others of its event, or behind the block in which so many
    are reached, which bounds the size of a row; no line is lost.

    Lines are put together where they are read. The files are read twice, as
    what lies at the edges of blocks, a few rows each, is put together apart.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").rlike(PATTERN_LINE).alias("head"),
        "value",
    )
    inner, edges = (lines.mapInArrow(_assembler(e, longest), _ASSEMBLED) for e in (False, True))
    events = inner.select("value", "rest").union(_over_edges(edges, longest))
    parsed = parse_pattern_log(events.select(F.struct("value", "rest").alias("both"), "value"), "value", ["both"])
    whole = F.concat_ws("\n", "value", "both.rest")
    return parsed.select(
        "ts", "level", "thread", "logger",
        F.when(F.col("message").isNotNull(), F.concat_ws("\n", "message", "both.rest")).alias("message"),
        whole.alias("value"),
    )


# --- metrics exposition -----------------------------------------------------

SAMPLE_LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(?:\{(.*)\})?\s*(\S+)(?:\s+-?\d+)?\s*$"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def parse_prometheus(lines: DataFrame, value: str = "value") -> DataFrame:
    """Samples of the text exposition format: name, labels and value.

    Comments and empty lines are dropped; other columns are kept. Escaped quotes
    and backslashes in labels are unescaped. A line that is no sample keeps its
    text in ``raw``, which is NULL otherwise.
    """
    line = F.btrim(F.col(value), F.lit(" \t\r"))
    others = [c for c in lines.columns if c != value]
    matched = line.rlike(SAMPLE_LINE)
    split = F.split(F.regexp_replace(line, SAMPLE_LINE, "$1\n$2\n$3"), "\n", 3)
    part = F.col("_parts")

    names, values = (F.regexp_extract_all(part[1], F.lit(LABEL), F.lit(g)) for g in (1, 2))
    labels = F.zip_with(
        names,
        values,
        lambda n, v: F.struct(n.alias("n"), F.regexp_replace(v, r'\\(["\\])', "$1").alias("v")),
    )
    # of a label that is there twice the last value counts
    last = F.filter(
        labels, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["n"])
    )

    return (
        lines.filter((line != "") & ~line.startswith("#"))
        .select(*others, F.when(matched, split).alias("_parts"), F.when(~matched, line).alias("raw"))
        .select(
            *others,
            part[0].alias("name"),
            F.map_from_entries(last).alias("labels"),
            part[2].try_cast("double").alias("value"),
            "raw",
        )
    )


def read_prometheus(spark: SparkSession, path: str) -> DataFrame:
    """Scraped metrics, with the file name as ``endpoint``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("endpoint"), "value")
    return parse_prometheus(lines)
