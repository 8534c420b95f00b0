"""headway: transit travel-time analytics expressed as Spark DataFrame plans.

Sub-packages:
    functions  Column-level scalar helpers (no UDFs).
    sources    Readers and writers (CSV / GTFS / Parquet / JSON / state tables).
    operators  Sequence windows, historical averages, joins, splits, metrics.
    plans      End-to-end compositions (city feature ETL, schedule unroll, comparisons).
    ml         Spark ML regressors, chained inference, search, reports.
    streaming  Structured Streaming ingest, scoring and the live ETA table.
"""

__version__ = "0.1.0"
