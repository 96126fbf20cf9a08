"""Readers and writers: ``tables`` (CSV, Parquet, layers), ``geojson`` and ``payloads``."""
