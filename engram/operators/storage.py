"""Durable forms: operation logs, write-ahead lines, segments and generations, queues."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clocks import hlc


# -------------------------------------------------------------- stored tables


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only where it names none and all
    runs in one JVM a local one takes its place."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = tempfile.mkdtemp(prefix="engram-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def state_of(spark: SparkSession, path: str) -> str:
    """Tells whether what lies at a path has changed: its files' number, bytes and time."""
    fs, p = _path(spark, path)
    size, times = fs.getContentSummary(p), sorted(f.getModificationTime() for f in fs.listStatus(p))
    return f"{path} {size.getFileCount()} {size.getLength()} {times[-1:]}"


def stored(spark: SparkSession, name: str, sources: list[str], build, write=None) -> DataFrame:
    """What build() returns, written to the shared folder by its first use in an application and
    read again by later ones, as long as the source paths have not changed. write(path) takes
    the place of build where a table has a layout of its own."""
    key = hashlib.sha256("\n".join([spark.sparkContext.applicationId, *(state_of(spark, s) for s in sources)]).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/engram/{name}-{key}"
    fs, done = _path(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        write(path) if write else build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows does not depend on how it came
    about, so a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/engram/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt to all cores; a larger one is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key. Partial maxima are combined before the shuffle."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def apply_tombstones(df: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    return df.join(dead.select(key).distinct(), key, "left_anti")


def recover(log: DataFrame, key: str = "point_id", lsn: str = "lsn") -> DataFrame:
    """Replays a log of upserts and deletes: the rows that exist at its end."""
    return latest(log, key, [F.col(lsn)]).where("op <> 'delete'")


def wal_line(record: Column) -> Column:
    """checksum, space, record: eight hex digits of the record's CRC-32."""
    return F.concat(F.lpad(F.lower(F.hex(F.crc32(record))), 8, "0"), F.lit(" "), record)


def wal_parse(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """record (null where torn) and ok. A line is torn if it has no space, a wrong checksum or
    a record that does not parse."""
    crc, body = F.substring_index(F.col(value), " ", 1), F.expr(f"substring(`{value}`, instr(`{value}`, ' ') + 1)")
    right = (F.instr(F.col(value), " ") > 0) & (F.crc32(body) == F.conv(crc, 16, 10).cast("long"))
    record = F.when(right, F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    return lines.select(record.alias("record"), F.coalesce(right, F.lit(False)).alias("ok"))


def watermark(df: DataFrame, lsn: str) -> int | None:
    return df.agg(F.max(lsn)).first()[0]


def generations(df: DataFrame, generation: str = "generation", lsn: str = "lsn") -> DataFrame:
    return df.groupBy(generation).agg(F.count("*").alias("records"), F.min(lsn).alias("min_lsn"), F.max(lsn).alias("max_lsn"))


def up_to(df: DataFrame, generation: int) -> DataFrame:
    return df.where(F.col("generation") <= generation)


def fsck(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """generation, status: ok, corrupt, missing or orphan. manifest: generation, digest, records;
    files: generation, digest."""
    both = manifest.withColumnRenamed("digest", "want").join(files.withColumnRenamed("digest", "have"), "generation", "full_outer")
    status = F.when(F.col("want").isNull(), "orphan").when(F.col("have").isNull(), "missing").when(F.col("want") != F.col("have"), "corrupt").otherwise("ok")
    return both.select("generation", "records", status.alias("status"))


def page(df: DataFrame, order: str, cursor, limit: int) -> DataFrame:
    """Rows after the cursor in order, with how many remain beyond the page."""
    after = df.where(F.col(order) > cursor)
    n = after.count()
    return after.orderBy(order).limit(limit).withColumn("remaining", F.lit(max(0, n - limit)).cast("long"))


def push_lww(stored: DataFrame, incoming: DataFrame, key: str = "point_id") -> DataFrame:
    """incoming with accepted: its clock is greater than the stored one."""
    mine = stored.select(key, hlc(F.col("wall_ms"), F.col("counter"), F.col("device_id")).alias("_mine"))
    theirs = hlc(F.col("wall_ms"), F.col("counter"), F.col("device_id"))
    return incoming.join(mine, key, "left").withColumn("accepted", F.col("_mine").isNull() | (theirs > F.col("_mine"))).drop("_mine")


def pending(queue: DataFrame, acks: DataFrame, key: str = "op_id") -> DataFrame:
    """What a durable queue still has to send: enqueued once, not acknowledged."""
    return queue.dropDuplicates([key]).join(acks.select(key).distinct(), key, "left_anti")


def elide(df: DataFrame, frame: str, order: str, fields: list[str]) -> DataFrame:
    """Fields that repeat the row before in their frame become null; <field>_same tells so."""
    w = Window.partitionBy(frame).orderBy(order)
    out = df
    for f in fields:
        same = F.coalesce(F.col(f).eqNullSafe(F.lag(f).over(w)) & (F.row_number().over(w) > 1), F.lit(False))
        out = out.withColumn(f"{f}_same", same)
    for f in fields:
        out = out.withColumn(f, F.when(~F.col(f"{f}_same"), F.col(f)))
    return out


def restore(df: DataFrame, frame: str, order: str, fields: list[str]) -> DataFrame:
    """Inverse of elide()."""
    w = Window.partitionBy(frame).orderBy(order)
    out = df
    for f in fields:
        run = F.sum((~F.col(f"{f}_same")).cast("int")).over(w)
        out = out.withColumn(f"_{f}_run", run)
    for f in fields:
        out = out.withColumn(f, F.first(f).over(Window.partitionBy(frame, f"_{f}_run").orderBy(order)))
    return out.drop(*[f"_{f}_run" for f in fields], *[f"{f}_same" for f in fields])


def digest_diff(a: DataFrame, b: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    joined = a.withColumnRenamed(digest, "_a").join(b.withColumnRenamed(digest, "_b"), key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return joined.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))


def migrate(source: DataFrame, target_rows: int, force: bool = False) -> DataFrame:
    """The rows to write; refuses to replace a target that holds more than is offered."""
    n = source.count()
    if target_rows > n and not force:
        raise ValueError(f"the target holds {target_rows} rows, only {n} are offered")
    return source
