"""Vehicle-position feed: normalise, drop re-polled positions, append to the event log.

Feed entities are landed as JSON lines (one entity per line) by whatever polls the
upstream service; Spark reads them with an explicit nested schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .live_eta import Folder

POSITION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("vehicle", T.StructType([
        T.StructField("vehicle", T.StructType([T.StructField("id", T.StringType())])),
        T.StructField("trip", T.StructType([T.StructField("route_id", T.StringType())])),
        T.StructField("position", T.StructType([T.StructField("latitude", T.DoubleType()),
                                                T.StructField("longitude", T.DoubleType())])),
        T.StructField("timestamp", T.LongType()),
        T.StructField("current_status", T.StringType()),
    ])),
])

# Vehicle stop status names by GTFS-realtime enum number.
STATUS_BY_CODE = {"0": "INCOMING_AT", "1": "STOPPED_AT", "2": "IN_TRANSIT_TO"}
DEFAULT_STATUS = "IN_TRANSIT_TO"
NORMALIZED_COLS = ["vehicle_id", "route_id", "latitude", "longitude", "timestamp", "current_status"]


def status_name(c: Column) -> Column:
    s = F.upper(F.trim(c))
    out = F.lit(DEFAULT_STATUS)
    for code, name in STATUS_BY_CODE.items():
        out = F.when((s == code) | (s == name), name).otherwise(out)
    return out


def normalize_positions(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Skip entities without a vehicle; ``vehicle_id`` = vehicle id or entity id
    (empty counts as missing); timestamp 0/missing -> ``now`` (processing time); status
    name with the in-transit default; every value emitted as a string."""
    now = now if now is not None else F.unix_seconds(F.current_timestamp())
    v = F.col("vehicle")
    ts = v.getField("timestamp")
    return raw.where(v.isNotNull()).select(
        F.coalesce(F.nullif(v.getField("vehicle").getField("id"), F.lit("")), F.col("id")).alias("vehicle_id"),
        F.coalesce(v.getField("trip").getField("route_id"), F.lit("")).alias("route_id"),
        v.getField("position").getField("latitude").cast("string").alias("latitude"),
        v.getField("position").getField("longitude").cast("string").alias("longitude"),
        F.when(F.coalesce(ts, F.lit(0)) != 0, ts).otherwise(now).cast("string").alias("timestamp"),
        status_name(v.getField("current_status")).alias("current_status"))


def read_feed(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming JSON source over the landing folder."""
    r = spark.readStream.schema(POSITION_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def without_repeats(positions: DataFrame, within: str) -> DataFrame:
    """Positions that a poll delivers again (all columns equal) are passed on once: stateful, with the
    event time as watermark; ``within`` is how far apart the copies may arrive in event time."""
    at = F.timestamp_seconds(F.col("timestamp").cast("long"))
    d = positions.withColumn("_at", at).withWatermark("_at", within)
    return d.dropDuplicatesWithinWatermark(NORMALIZED_COLS).drop("_at")


def start_ingest(spark: SparkSession, landing: str, log_path: str, checkpoint: str,
                 poll_seconds: int = 15, available_now: bool = False, max_files_per_trigger: int | None = None,
                 keep: int | None = None, repeats_within: str | None = None) -> StreamingQuery:
    """R1 + R2 + K4: normalise every poll and append to the position log (Parquet,
    partitioned by event date). The checkpoint makes the append exactly-once.

    ``keep`` caps the log at its newest records (R7, ``CappedLog``); ``repeats_within`` drops re-polled
    positions (``without_repeats``)."""
    norm = normalize_positions(read_feed(spark, landing, max_files_per_trigger))
    if repeats_within:
        norm = without_repeats(norm, repeats_within)
    if keep is not None:
        log = CappedLog(spark, log_path, keep)
        w = norm.writeStream.foreachBatch(lambda batch, batch_id: log.append(batch, batch_id) and None)
    else:
        norm = norm.withColumn("event_date", F.to_date(F.timestamp_seconds(F.col("timestamp").cast("long"))))
        w = norm.writeStream.format("parquet").option("path", log_path).partitionBy("event_date").outputMode("append")
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{poll_seconds} seconds")
    return w.start()


class CappedLog(Folder):
    """R7 + K4: a position log of the newest ``keep`` records.

    A batch is appended as ``delta/batch_id=B`` (its own newest ``keep`` rows; a replayed batch is
    skipped). After ``compact_every`` batches the log is written anew as ``v=B``: the newest
    ``keep`` of the version before and the deltas since, a top-k per task and one merge of those.
    Readers see the newest committed version and later deltas, cut to ``keep``; what a version
    replaces stays until the next one."""

    def __init__(self, spark: SparkSession, root: str, keep: int, compact_every: int = 4):
        super().__init__(spark, root)
        self.keep, self.compact_every = keep, compact_every

    def _state(self) -> tuple[list[int], list[int]]:
        """(versions, deltas), committed ones, oldest first."""
        return ([v for v, in self.numbers("v=*", "_SUCCESS")], [b for b, in self.numbers("delta", "batch_id=*", "_SUCCESS")])

    def read(self) -> DataFrame:
        versions, deltas = self._state()
        newest = max(versions, default=-1)
        paths = [f"{self.root}/v={newest}"] if versions else []
        paths += [f"{self.root}/delta/batch_id={b}" for b in deltas if b > newest]
        if not paths:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in NORMALIZED_COLS))
        return retain_newest(self.spark.read.parquet(*paths), self.keep)

    def append(self, batch: DataFrame, batch_id: int) -> bool:
        """Add a batch; returns False when it was added before."""
        versions, deltas = self._state()
        if batch_id <= max(versions + deltas, default=-1):
            return False
        retain_newest(batch, self.keep).write.mode("overwrite").parquet(f"{self.root}/delta/batch_id={batch_id}")
        if len([b for b in deltas if b > max(versions, default=-1)]) + 1 >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        versions, deltas = self._state()
        self.read().write.mode("overwrite").parquet(f"{self.root}/v={max(deltas)}")
        for v in versions[:-1]:
            self.remove(f"v={v}")
        for b in deltas:
            if versions and b <= versions[-1]:
                self.remove(f"delta/batch_id={b}")


def retain_newest(log: DataFrame, keep: int, ts_col: str = "timestamp") -> DataFrame:
    """The newest ``keep`` records of the log (the retention is the feature here).
    Uses a global top-k (``orderBy().limit()``), which Spark runs as per-partition
    top-k plus a final merge of ``keep`` rows per partition."""
    rest = sorted((c for c in log.columns if c != ts_col), key=lambda c: (c != "vehicle_id", c))   # ties: a fixed order
    return log.orderBy(F.col(ts_col).cast("long").desc(), *rest).limit(keep)


def drop_old_partitions(log: DataFrame, min_date: str) -> DataFrame:
    """R7 alternative: keep whole dates from ``min_date`` on (partition pruning)."""
    return log.where(F.col("event_date") >= F.to_date(F.lit(min_date)))


def latest_position(log: DataFrame) -> DataFrame:
    """Newest position per vehicle (pre-aggregated ``max_by``)."""
    cols = [c for c in log.columns if c != "vehicle_id"]
    return log.groupBy("vehicle_id").agg(
        F.max_by(F.struct(*cols), F.struct(F.col("timestamp").cast("long").alias("t"), *cols)).alias("_r")).select("vehicle_id", "_r.*")

