"""Stop-event scoring into a live, expiring ETA table.

Each micro-batch: validate (rejects go to a dead-letter folder and are counted),
build features columnwise, join the current weather snapshot (re-read every batch),
predict, compute confidence, then upsert the newest row per
``(route_id, stop_id, next_stop_id)``.

The live table is a sequence of immutable Parquet snapshots ``v=<batch_id>``; the
current version is the highest one whose write committed (``_SUCCESS``). A replayed
batch id is skipped, so the checkpointed (at-least-once) source plus this sink gives
an idempotent result; nothing is deleted while a query runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import confidence, eta_postprocess
from ..functions.timefmt import parse_event_time

STOP_EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                  ["event_id", "route_id", "direction_id", "stop_id", "next_stop_id",
                                   "half_trip_id", "actual_ts"]])
REQUIRED = ["route_id", "direction_id", "stop_id", "next_stop_id"]
KEY = ["route_id", "stop_id", "next_stop_id"]
TTL_SECONDS = 300
# Weather used when no snapshot exists (10 C, dry, no snow).
DEFAULT_WEATHER = {"temperature_2m": 10.0, "precipitation": 0.0, "snowfall": 0.0}


def is_valid(df: DataFrame) -> Column:
    """F8: every required field present and non-empty after trimming."""
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))
    return ok


def current_weather(weather: DataFrame | None, spark: SparkSession) -> DataFrame:
    """Latest snapshot row (by hour) with defaults for missing values; one row."""
    if weather is None:
        return spark.createDataFrame([tuple(DEFAULT_WEATHER.values())],
                                     "temperature_2m double, precipitation double, snowfall double")
    latest = weather.agg(F.max_by(F.struct(*DEFAULT_WEATHER), F.col("hour_key")).alias("w"))
    return latest.select(*[F.coalesce(F.col(f"w.{c}").cast("double"), F.lit(v)).alias(c)
                           for c, v in DEFAULT_WEATHER.items()])


def event_features(events: DataFrame, weather_row: DataFrame, tz: str = "America/New_York") -> DataFrame:
    """Trimmed ids, calendar of the event time (X10), current weather. The weather
    is a one-row table attached with scalar subqueries (no join)."""
    ids = [F.trim(F.col(c)).alias(c) for c in REQUIRED]
    cal = parse_event_time("actual_ts", tz)
    w = weather_row.select(F.struct(*DEFAULT_WEATHER).alias("w")).scalar()   # one subquery, one row
    return events.select(F.col("event_id"), *ids, *cal, *[w.getField(c).alias(c) for c in DEFAULT_WEATHER])


def closed_form_eta() -> Column:
    """Stand-in predictor when no fitted model is passed: 40 s + 5 s per hour of day
    + 20 s per mm of rain."""
    return F.lit(40.0) + 5.0 * F.col("hora_del_dia") + 20.0 * F.col("precipitation")


def score_batch(batch: DataFrame, weather_row: DataFrame,
                predict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Features -> prediction -> P17 -> P16; one row per valid event."""
    f = event_features(batch, weather_row)
    f = predict(f) if predict is not None else f.withColumn("prediction", closed_form_eta())
    f = f.withColumn("eta_segundos", eta_postprocess("prediction"))
    return f.select(
        *KEY, "direction_id", "eta_segundos",
        confidence("hora_del_dia", "dia_semana", "eta_segundos", "precipitation", "snowfall").alias("nivel_confianza"),
        "hora_del_dia", "dia_semana", "mes",
        F.col("temperature_2m").alias("temperatura_actual_c"), F.col("precipitation").alias("precipitacion_mm"),
        F.col("snowfall").alias("nieve_cm"), F.col("event_ts").alias("ultima_actualizacion"),
        F.col("event_id"))


#: The columns of ``score_batch``, for a table whose batches were all empty.
LIVE_SCHEMA = ("route_id string, stop_id string, next_stop_id string, direction_id string, eta_segundos double, "
               "nivel_confianza double, hora_del_dia int, dia_semana int, mes int, temperatura_actual_c double, "
               "precipitacion_mm double, nieve_cm double, ultima_actualizacion timestamp, event_id string")


def newest_per_key(df: DataFrame) -> DataFrame:
    """Latest-wins by event order (time, then id), pre-aggregated with ``max_by``.

    Ids are text such as ``1700000000-0``: the number before the dash and the one after it
    order them, then the text itself."""
    cols = [c for c in df.columns if c not in KEY]
    part = lambda i: F.split_part(F.col("event_id"), F.lit("-"), F.lit(i)).try_cast("long")
    order = F.struct(F.col("ultima_actualizacion"), part(1).alias("a"), part(2).alias("b"), F.col("event_id"))
    return df.groupBy(*KEY).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*KEY, "_r.*")


class Folder:
    """Numbered folders (``<name>=<number>``) below a root, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def numbers(self, *pattern: str) -> list[tuple[int, ...]]:
        """The numbers in the names on the paths that match, e.g. ("delta", "batch_id=*", "_SUCCESS"), sorted."""
        fs, jvm = self._fs()
        st = fs.globStatus(jvm.org.apache.hadoop.fs.Path("/".join([self.root, *pattern])))
        found = []
        for s in st or []:
            names = s.getPath().toString().split("/")[-len(pattern):]
            found.append(tuple(int(n.split("=", 1)[1]) for n in names if "=" in n))
        return sorted(found)

    def remove(self, path: str) -> None:
        fs, jvm = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}"), True)


class LiveTable(Folder):
    """Keyed ETA table without rewriting it (R5/K5): key buckets, delta files and compacted buckets.

    A batch writes its newest row of each key to ``delta/batch_id=B``, in folders of the keys' hash
    buckets, so it writes the buckets of its keys and no others; the folder counts once its
    ``_SUCCESS`` is there, and a replayed batch is skipped. A reader merges each bucket's newest
    compacted version with the later deltas (latest wins). A bucket with ``compact_after`` deltas
    is merged into ``base/bucket=K/v=B``, at most ``COMPACT_AT_ONCE`` buckets a batch; what a
    compaction replaces stays until the next one of that bucket, for readers on it.

    With ``retain_s``, keys not updated within so many seconds before the newest update are
    not shown, and leave the table when their bucket is compacted."""

    COMPACT_AT_ONCE = 2

    def __init__(self, spark: SparkSession, root: str, retain_s: int | None = None, buckets: int = 16,
                 compact_after: int = 8):
        super().__init__(spark, root)
        self.retain_s, self.buckets, self.compact_after = retain_s, buckets, compact_after

    def current_version(self) -> int | None:
        """The newest batch that was applied."""
        done = self.numbers("delta", "batch_id=*", "_SUCCESS")
        return done[-1][0] if done else None

    def layout(self) -> dict[int, tuple[list[int], list[int]]]:
        """Per bucket: its compacted versions and its deltas (batch ids) after the newest of them."""
        committed = {b for b, in self.numbers("delta", "batch_id=*", "_SUCCESS")}
        found: dict[int, tuple[list[int], list[int]]] = {}
        for k, v in self.numbers("base", "bucket=*", "v=*", "_SUCCESS"):
            found.setdefault(k, ([], []))[0].append(v)
        for b, k in self.numbers("delta", "batch_id=*", "bucket=*"):
            versions, deltas = found.setdefault(k, ([], []))
            if b in committed and b > max(versions, default=-1):
                deltas.append(b)
        return found

    def _paths(self, bucket: int, versions: list[int], deltas: list[int]) -> list[str]:
        base = [f"{self.root}/base/bucket={bucket}/v={max(versions)}"] if versions else []
        return base + [f"{self.root}/delta/batch_id={b}/bucket={bucket}" for b in deltas]

    def read(self) -> DataFrame | None:
        paths = [p for k, (v, d) in self.layout().items() for p in self._paths(k, v, d)]
        if not paths:
            return None if self.current_version() is None else self.spark.createDataFrame([], LIVE_SCHEMA)
        t = newest_per_key(self.spark.read.parquet(*paths))
        return t if self.retain_s is None else live_view(t, t.agg(F.max("ultima_actualizacion")).scalar(), self.retain_s)

    def apply(self, scored: DataFrame, batch_id: int) -> bool:
        """Merge a scored batch; returns False when the batch was already applied."""
        last = self.current_version()
        if last is not None and batch_id <= last:
            return False
        new = newest_per_key(scored).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.root}/delta/batch_id={batch_id}")
        due = [(len(d), k) for k, (_, d) in self.layout().items() if len(d) >= self.compact_after]
        for _, bucket in sorted(due, reverse=True)[:self.COMPACT_AT_ONCE]:
            self.compact(bucket)
        return True

    def compact(self, bucket: int) -> None:
        """Merge a bucket's deltas into its next version; expired keys go."""
        versions, deltas = self.layout()[bucket]
        if not deltas:
            return
        t = newest_per_key(self.spark.read.parquet(*self._paths(bucket, versions, deltas)))
        if self.retain_s is not None:
            t = live_view(t, t.agg(F.max("ultima_actualizacion")).scalar(), self.retain_s)
        t.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/base/bucket={bucket}/v={max(deltas)}")
        if versions:                                       # what the version before this one had replaced
            for v in sorted(versions)[:-1]:
                self.remove(f"base/bucket={bucket}/v={v}")
            for b, k in self.numbers("delta", "batch_id=*", f"bucket={bucket}"):
                if b <= max(versions):
                    self.remove(f"delta/batch_id={b}/bucket={k}")
        pending = {b for b, _ in self.numbers("delta", "batch_id=*", "bucket=*")}
        for b, in self.numbers("delta", "batch_id=*", "_SUCCESS")[:-1]:
            if b not in pending:                           # all of it is compacted
                self.remove(f"delta/batch_id={b}")


def live_view(table: DataFrame, now: Column | str | None = None, ttl_s: int = TTL_SECONDS) -> DataFrame:
    """R5 expiry: rows updated within ``ttl_s`` of ``now`` (a parameter for tests)."""
    n = F.current_timestamp() if now is None else (F.lit(now).cast("timestamp") if isinstance(now, str) else now)
    return table.where(F.col("ultima_actualizacion") > n - F.make_dt_interval(secs=F.lit(ttl_s)))


def start_scorer(spark: SparkSession, source: DataFrame, table_root: str, checkpoint: str,
                 weather_path: str | None = None, dead_letter: str | None = None,
                 predict: Callable[[DataFrame], DataFrame] | None = None,
                 block_seconds: int = 5, available_now: bool = False, totals: str | None = None,
                 retain_s: int | None = None) -> StreamingQuery:
    """``foreachBatch`` scorer over a checkpointed stream of stop events.

    ``predict`` is for example ``PipelineModel.transform`` of a model on the columns of
    ``event_features``; ``totals`` is a folder for each batch's counts (see ``scorer_totals``)."""
    live = LiveTable(spark, table_root, retain_s)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the micro-batch feeds two sinks (dead letters, live table): keep it for the batch
        # instead of re-reading the source files; a lost block is recomputed from the source
        b = batch.withColumn("_ok", is_valid(batch)).persist()
        try:
            if dead_letter:
                # a replayed batch overwrites its own folder
                (b.where(~F.col("_ok")).drop("_ok")
                  .write.mode("overwrite").json(f"{dead_letter.rstrip('/')}/batch_id={batch_id}"))
            if totals:
                ok = F.col("_ok")
                (b.agg(F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("accepted"),
                       F.count_if(~ok).alias("rejected"))
                  .write.mode("overwrite").json(f"{totals.rstrip('/')}/batch_id={batch_id}"))
            weather = spark.read.parquet(weather_path) if weather_path else None  # R6: re-read per batch
            scored = score_batch(b.where(F.col("_ok")).drop("_ok"), current_weather(weather, spark), predict)
            live.apply(scored, batch_id)
        finally:
            b.unpersist()

    w = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{block_seconds} seconds")
    return w.start()


def scorer_totals(spark: SparkSession, totals: str) -> DataFrame:
    """Events received, accepted and rejected over all batches; a replayed batch counts once."""
    t = spark.read.schema("received long, accepted long, rejected long").json(f"{totals.rstrip('/')}/batch_id=*")
    return t.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in t.columns])


def read_stop_events(spark: SparkSession, path: str, max_files_per_trigger: int = 50) -> DataFrame:
    """Stop-event JSON stream, bounded batch size."""
    return (spark.readStream.schema(STOP_EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .json(path))
