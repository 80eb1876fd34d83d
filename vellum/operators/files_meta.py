"""Fingerprints and simple per-file projections (A2, B1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import file_type as _file_type


def fingerprint_md5(df: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """``(key, md5)`` of the content bytes (strings hash their UTF-8 bytes)."""
    return df.select(key, F.md5(F.col(content)).alias("md5"))


def file_types(df: DataFrame, key: str = "page_id", path: str = "url") -> DataFrame:
    """B1: ``(key, file_type)``."""
    return df.select(key, _file_type(path).alias("file_type"))
