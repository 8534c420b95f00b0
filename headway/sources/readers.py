"""Readers with explicit schemas.

All raw text is read with a declared schema (no inference); ids stay strings and
numbers are parsed with ``try_cast`` so a bad value becomes null instead of failing.
"""

from __future__ import annotations

import csv
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def string_schema(cols) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


# --- S1: arrivals CSV (one file per month), column subset ------------------------------
ARRIVAL_COLS = ["service_date", "route_id", "direction_id", "half_trip_id", "stop_id",
                "time_point_order", "point_type", "standard_type", "scheduled", "actual"]
ARRIVAL_USE = ["service_date", "route_id", "direction_id", "half_trip_id", "stop_id", "time_point_order", "actual"]


def read_arrivals(spark: SparkSession, paths, header_cols=ARRIVAL_COLS) -> DataFrame:
    """S1 + U1: multi-file CSV (glob or list), declared string schema, used columns."""
    df = read_csv(spark, paths, [c for c in ARRIVAL_USE if c in header_cols])
    return df.withColumn("time_point_order", F.col("time_point_order").try_cast("int"))


# --- S2 / S3 ------------------------------------------------------------------------
def read_csv(spark: SparkSession, paths, cols, sep: str = ",", header: bool = True,
             encoding: str | None = None, optional=()) -> DataFrame:
    """Generic all-string CSV read (S3: ``sep=';'`` leg logs with string ids).

    Columns are taken by header name (files may hold more, in another order); a missing
    one raises, or is null if it is ``optional``. Files of one call share a header. Without a header they go by position."""
    r = spark.read.option("sep", sep).option("mode", "PERMISSIVE")
    if encoding:
        r = r.option("encoding", encoding)
    if not header:
        return r.schema(string_schema(cols)).csv(paths)
    df = r.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(paths)
    by_name = {c.strip().lstrip("\ufeff"): c for c in df.columns}
    missing = [c for c in cols if c not in by_name and c not in optional]
    if missing:
        raise ValueError(f"missing columns {missing} in {paths}")
    return df.select(*[(F.col(f"`{by_name[c]}`") if c in by_name else F.lit(None).cast("string")).alias(c) for c in cols])


def with_source_order(df: DataFrame, col: str = "_src_order") -> DataFrame:
    """Source order (file, split, position) for keep-first semantics on raw files."""
    return df.withColumn(col, F.struct(F.col("_metadata.file_path").alias("f"),
                                       F.col("_metadata.file_block_start").alias("b"),
                                       F.monotonically_increasing_id().alias("i")))


def read_stops(spark: SparkSession, path: str, dedupe: bool = True) -> DataFrame:
    """Stop dimension (stop_id, stop_lat, stop_lon); first row per stop_id kept."""
    from ..operators.sequence import keep_first
    raw = read_csv(spark, path, ["stop_id", "stop_lat", "stop_lon"])
    df = with_source_order(raw.select(
        "stop_id", F.col("stop_lat").try_cast("double").alias("stop_lat"),
        F.col("stop_lon").try_cast("double").alias("stop_lon")))
    if not dedupe:
        return df.drop("_src_order")
    return keep_first(df, ["stop_id"], ["_src_order"], ["stop_lat", "stop_lon"])


# --- S4: GTFS bundle --------------------------------------------------------------------
GTFS_COLUMNS = {
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "trips": ["route_id", "service_id", "trip_id", "direction_id", "shape_id"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
                 "sunday", "start_date", "end_date"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
}


#: Tables and columns that a feed may leave out; the others must exist.
OPTIONAL_GTFS = ("routes", "shapes")
OPTIONAL_COLUMNS = ("direction_id", "shape_id", "departure_time", "service_id", "stop_name", "route_short_name",
                    "route_long_name", "route_type")


def read_gtfs(spark: SparkSession, root: str, tables=None, encoding_fallback: bool = False,
              seps: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Every GTFS table as an all-string DataFrame (``.txt``; ``.csv`` accepted).

    Columns are matched by header name, so files with extra or reordered columns work; a
    missing column raises unless it is optional (then null). ``seps`` names the separator of
    tables that don't use a comma.
    """
    out = {}
    for name in tables or GTFS_COLUMNS:
        path = None
        for ext in (".txt", ".csv"):
            candidate = f"{root.rstrip('/')}/{name}{ext}"
            if path_exists(spark, candidate):
                path = candidate
                break
        if path is None:
            if tables is None and name in OPTIONAL_GTFS:
                continue
            raise FileNotFoundError(f"{name}.txt is missing in {root}")
        reader = read_csv_fallback if encoding_fallback else _read_header_csv
        out[name] = reader(spark, path, GTFS_COLUMNS[name], sep=(seps or {}).get(name, ","))
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (local, HDFS, object
    stores alike), not the driver's local disk."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath))


def _read_header_csv(spark: SparkSession, path: str, cols, encoding: str | None = None, sep: str = ",") -> DataFrame:
    return read_csv(spark, path, cols, sep, encoding=encoding, optional=OPTIONAL_COLUMNS)


# --- S5: encoding fallback ----------------------------------------------------------------
# Fixed value: the order in which encodings are tried for legacy feeds.
ENCODINGS = ["utf-8", "iso-8859-9", "windows-1254", "latin-1"]


def _code_page(name: str) -> tuple[str, str, str]:
    """A single-byte code page as (Latin-1 characters, its characters for the same bytes, Latin-1
    characters of bytes it lacks)."""
    same, own, lacks = "", "", ""
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            lacks += chr(b)
            continue
        if c != chr(b):
            same, own = same + chr(b), own + c
    return same, own, lacks


def _latin1(line: Column) -> Column:
    return F.decode(line.cast("binary"), "ISO-8859-1")


def file_encodings(spark: SparkSession, paths, encodings=ENCODINGS) -> DataFrame:
    """(file, encoding): the first of ``encodings`` in which all bytes of the file are valid (the last one
    when none is). Lines are read as raw bytes and judged in tasks, one row a file comes out; a
    valid file that holds U+FFFD is valid. Apart from utf-8 only single-byte code pages are known."""
    line = F.col("value")
    valid = []
    for e in encodings:
        lacks = None if e.lower() == "utf-8" else _code_page(e)[2]
        ok = F.is_valid_utf8(line) if lacks is None else (
            ~_latin1(line).rlike("[" + "".join(f"\\x{ord(c):02x}" for c in lacks) + "]") if lacks else F.lit(True))
        valid.append(F.bool_and(ok).alias(f"v{len(valid)}"))
    per_file = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("file")).agg(*valid)
    choice = F.lit(encodings[-1])
    for i in reversed(range(len(encodings))):
        choice = F.when(F.col(f"v{i}"), encodings[i]).otherwise(choice)
    return per_file.select("file", choice.alias("encoding"))


def read_csv_fallback(spark: SparkSession, paths, cols, encodings=ENCODINGS, sep: str = ",",
                      with_encoding: bool = False) -> DataFrame:
    """CSV files of mixed encodings, each decoded in the encoding that ``file_encodings`` chose.

    The choices are joined to the files' lines (a row a file), so no file list goes through the
    driver and no session option changes. Columns go by the header of the first file, which every
    file starts with; lines equal to it are headers. ``with_encoding`` adds the choice."""
    from ..operators.enrich import checked_broadcast
    choice = file_encodings(spark, paths, encodings)
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value",
                                          F.col("_metadata.file_block_start").alias("at"))
    decoded = F.col("value")
    for e in encodings:
        if e.lower() != "utf-8":
            same, own, _ = _code_page(e)
            decoded = F.when(F.col("encoding") == e, F.translate(_latin1(F.col("value")), same, own)).otherwise(decoded)
    text = F.rtrim(F.ltrim(decoded, F.lit("\ufeff")), F.lit("\r"))
    rows = lines.join(checked_broadcast(choice), "file").select("encoding", "at", text.alias("line")).where("line <> ''")
    head = rows.where("at = 0").select("line").first()
    if head is None:
        return spark.createDataFrame([], string_schema([*cols, *(["encoding"] if with_encoding else [])]))
    names = [c.strip() for c in next(csv.reader([head.line], delimiter=sep))]
    missing = [c for c in cols if c not in names and c not in OPTIONAL_COLUMNS]
    if missing:
        raise ValueError(f"missing columns {missing} in {paths}")
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = rows.where(F.col("line") != F.lit(head.line)).select(
        F.from_csv("line", fields, {"sep": sep, "mode": "PERMISSIVE"}).alias("r"), "encoding")
    out = [(F.col(f"r.c{names.index(c)}") if c in names else F.lit(None).cast("string")).alias(c) for c in cols]
    return parsed.select(*out, *(["encoding"] if with_encoding else []))


# --- S7 / S15 -------------------------------------------------------------------------------
def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature parts; ``k`` comes from the partition directory. An unreadable part fails the read."""
    return spark.read.parquet(path)


def read_features_tolerant(spark: SparkSession, path: str, k_col: str = "k") -> tuple[DataFrame, DataFrame]:
    """(features, skipped): the parts that can be read, and (file, part, reason) of the others.

    A listing pass comes first: the files (names and sizes, no content) against those whose
    footers open, which a scan without columns finds in its tasks. Skipped are parts whose
    directory names no number, files too short for Parquet and files without a readable footer
    (or without rows). The scan then leaves these files out by name and reads the others
    strictly, so a damaged page still fails; the skipped names are in a warning."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
              .select(F.col("_metadata.file_path").alias("file"), "length"))
    part = F.regexp_extract("file", f"/{k_col}=([^/]*)/", 1)
    listed = listed.withColumn("part", F.when(part != "", part))
    lenient = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(path)
    opened = lenient.select(F.col("_metadata.file_path").alias("file")).distinct().withColumn("opened", F.lit(True))
    reason = (F.when(F.col("part").isNotNull() & F.col("part").try_cast("int").isNull(), "part name")
               .when(F.col("length") < 12, "too short").when(F.col("opened").isNull(), "no readable footer, or no rows"))
    skipped = materialize(listed.join(opened, "file", "left").withColumn("reason", reason).where("reason IS NOT NULL")
                          .select("file", "part", "reason"), "skipped")
    names = [r.file for r in skipped.select("file").collect()]          # the names to warn of
    if names:
        warnings.warn(f"{len(names)} unreadable parts of {path} are skipped: {', '.join(names[:5])}", stacklevel=2)
    rows = spark.read.schema(lenient.schema).parquet(path).where(~F.col("_metadata.file_path").isin(names))
    if k_col in rows.columns:
        rows = rows.withColumn(k_col, F.col(k_col).try_cast("int"))
    return rows, skipped


# --- S8 / S9: weather -------------------------------------------------------------------------
WEATHER_JSON_SCHEMA = T.StructType([T.StructField("hourly", T.StructType([
    T.StructField("time", T.ArrayType(T.StringType())),
    T.StructField("temperature_2m", T.ArrayType(T.DoubleType())),
    T.StructField("precipitation", T.ArrayType(T.DoubleType())),
    T.StructField("snowfall", T.ArrayType(T.DoubleType())),
]))])


def weather_from_json(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Hourly JSON with parallel arrays -> one row per UTC hour."""
    h = F.from_json(F.col(json_col), WEATHER_JSON_SCHEMA).getField("hourly")
    z = F.arrays_zip(h.getField("time").alias("time"), h.getField("temperature_2m").alias("temperature_2m"),
                     h.getField("precipitation").alias("precipitation"), h.getField("snowfall").alias("snowfall"))
    rows = df.select(F.explode(z).alias("r"))
    return rows.select(F.date_trunc("hour", F.try_to_timestamp(F.col("r.time"))).alias("hour_key"),
                       F.col("r.temperature_2m").alias("temperature_2m"),
                       F.col("r.precipitation").alias("precipitation"), F.col("r.snowfall").alias("snowfall"))


def weather_from_arrays(df: DataFrame, start: str = "start", interval: str = "interval_s",
                        values: dict | None = None) -> DataFrame:
    """Start epoch + interval + value arrays -> timestamps ``start + i*interval``
    (left-inclusive), floored to the hour."""
    values = values or {"temperature_2m": "temperature_2m"}
    first = next(iter(values.values()))
    ex = df.select(start, interval, *values.values(), F.posexplode(F.col(first)).alias("_i", "_v0"))
    ts = F.timestamp_seconds(F.col(start) + F.col("_i") * F.col(interval))
    return ex.select(F.date_trunc("hour", ts).alias("hour_key"),
                     *[F.get(F.col(src), F.col("_i")).alias(dst) for dst, src in values.items()])


# --- S13: holidays ------------------------------------------------------------------------------
def holidays_table(spark: SparkSession, rows) -> DataFrame:
    """(region, date) table built from a list of (region, 'yyyy-MM-dd')."""
    return spark.createDataFrame(rows, "region string, date string").select(
        "region", F.to_date("date").alias("date"))
