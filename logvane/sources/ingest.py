"""Raw lines in: files, streams of files, JSON envelopes, and what is let through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.functions.rules import first_match, is_in, quote
from logvane.functions.scalar import event_id
from logvane.sources.tail import LogTail

# --- fixed values ---
MAX_LINE = 10_000
SOURCES = ("syslog", "nginx", "auth", "firewall", "custom")
SEVERE = 4
PATH_SOURCES = (
    (r"/(auth\.log|secure)[^/]*$", "auth"),
    (r"/nginx/[^/]*$", "nginx"),
    (r"/(syslog|messages)[^/]*$", "syslog"),
)
SAMPLE_PERCENT = {"CRITICAL": 100, "ERROR": 100, "WARNING": 50}
SAMPLE_REST = 10
ENVELOPE = "log_line string, source string, metadata map<string,string>"


def source_of_path(path: str) -> Column:
    """Source type of a file path; `custom` for unknown places."""
    rules = [(f"{path} RLIKE {quote(p)}", quote(s)) for p, s in PATH_SOURCES]
    return F.expr(first_match(rules, "'custom'"))


def _with_source(lines: DataFrame) -> DataFrame:
    named = lines.withColumn("_path", F.col("_metadata.file_path"))
    return named.select(
        F.col("value").alias("log_line"),
        source_of_path("_path").alias("source"),
        F.col("_path").alias("path"),
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text files or folders, with the source told by the file's path."""
    return _with_source(spark.read.text(path))


def watch_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files under `path` as a stream, each read once; `tail_lines` follows files that grow."""
    reader = spark.readStream.schema("value string").format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _with_source(reader.load(path))


def tail_lines(spark: SparkSession, path: str, max_bytes: int | None = None, **options: str) -> DataFrame:
    """Lines as they are appended to the logs below `path`, through rotation and truncation."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format(LogTail.name()).options(**options)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes))
    tailed = reader.load(path)
    return tailed.select(
        F.col("value").alias("log_line"), source_of_path("path").alias("source"), "path", "position"
    )


def unpack_envelopes(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies, one line or a list under `logs`, to one row per line."""
    layout = f"{ENVELOPE}, logs array<struct<{ENVELOPE.replace(' string', ':string').replace(' map', ':map')}>>"
    read = df.withColumn("_j", F.from_json(body, layout))
    single = F.struct("_j.log_line", "_j.source", "_j.metadata")
    every = F.coalesce(F.col("_j.logs"), F.array(single))
    kept = [c for c in df.columns if c != body]
    return (
        read.select(*kept, F.posexplode(every).alias("position", "_l"))
        .select(*kept, "position", "_l.*")
    )


def reject_reason() -> Column:
    """Why a line is not accepted, or null."""
    return F.expr(
        first_match(
            [
                ("log_line IS NULL OR length(log_line) = 0", "'empty'"),
                (f"length(log_line) > {MAX_LINE}", "'too long'"),
                (f"source IS NULL OR NOT ({is_in('source', SOURCES)})", "'unknown source'"),
            ]
        )
    )


def split_valid(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted lines, and rejected ones with their reason."""
    judged = lines.withColumn("reason", reject_reason())
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def severe_only(lines: DataFrame, line: str = "log_line") -> DataFrame:
    """Tagged syslog lines of severity 4 (warning) or worse."""
    priority = F.regexp_extract(line, r"^<(\d+)>", 1).try_cast("bigint")
    return lines.filter(F.pmod(priority, F.lit(8)) <= SEVERE)


def sample_by_severity(df: DataFrame, line_id: str = "line_id") -> DataFrame:
    """All critical and error rows, half of the warnings, a tenth of the rest.

    A row's place in its hundred decides, so a rerun keeps the same rows.
    """
    percent = first_match(
        [(f"severity = {quote(s)}", str(p)) for s, p in SAMPLE_PERCENT.items()], str(SAMPLE_REST)
    )
    return df.filter(F.expr(f"pmod({line_id}, 100) < {percent}"))


def with_event_id(df: DataFrame) -> DataFrame:
    return df.withColumn("log_id", event_id(F.col("log_line"), F.col("line_id")))
