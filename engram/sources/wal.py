"""A write-ahead log as text files, one checksummed JSON record a line; also as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import storage


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    df.select(storage.wal_line(record).alias("value")).write.mode(mode).text(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records that are whole."""
    return storage.wal_parse(spark.read.text(path), schema).where("ok and record is not null").select("record.*")


def torn(spark: SparkSession, path: str, schema: str) -> int:
    return storage.wal_parse(spark.read.text(path), schema).where("not ok or record is null").count()


def read_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """The whole records of a log and of what is appended to it, files at a time. A query that keeps a
    checkpoint goes on where it ended; torn lines are passed over."""
    reader = spark.readStream.format("text")
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return storage.wal_parse(reader.load(path), schema).where("ok and record is not null").select("record.*")


def write_stream(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream to a log. A batch is committed whole: read() and read_stream() see the files
    of committed batches only, so a batch that is run again leaves no record twice."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    lines = df.select(storage.wal_line(record).alias("value"))
    return lines.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


def copy(spark: SparkSession, source: str, path: str, checkpoint: str, schema: str, files: int | None = None) -> DataFrame:
    """Carries what a log has and its copy has not over to the copy, and gives the copy's records."""
    query = write_stream(read_stream(spark, source, schema, files), path, checkpoint)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return read(spark, path, schema)
