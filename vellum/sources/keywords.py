"""Keyword dictionary as an ordered dimension table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from vellum import config


def load_keywords(path: str | None = None) -> dict[str, list[str]]:
    """Dictionary from a YAML/JSON file, falling back to ``{"GENERAL": []}`` when unreadable.

    Without a path the built-in dictionary is returned. Category order is file order.
    """
    if path is None:
        return dict(config.KEYWORDS)
    try:
        with open(path, encoding="utf-8") as fh:
            raw = fh.read()
        data = _parse(raw, path)
        if not isinstance(data, dict):
            raise ValueError("keyword file must hold a mapping")
        return {str(k): [str(w) for w in (v or [])] for k, v in data.items()}
    except (OSError, ValueError):
        return dict(config.FALLBACK_KEYWORDS)


def _parse(raw: str, path: str):
    """JSON by its extension, else YAML; without the yaml package a YAML file is an error of the
    installation, not of the file."""
    if path.lower().endswith(".json"):
        return json.loads(raw)
    try:
        import yaml
    except ImportError as e:
        try:
            return json.loads(raw)
        except ValueError:
            raise RuntimeError(f"reading {path} needs the yaml package") from e
    try:
        return yaml.safe_load(raw)
    except yaml.YAMLError as e:
        raise ValueError(f"malformed YAML in {path}") from e


def categories(keywords: dict[str, list[str]] | None = None) -> list[str]:
    return list((keywords or config.KEYWORDS).keys())


def keyword_dim(spark: SparkSession, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """``(rank, category, keyword)``; rank is the category's 1-based position. A category
    without keywords still appears once with a NULL keyword so the category list is whole."""
    rows = []
    for rank, (cat, words) in enumerate((keywords or config.KEYWORDS).items(), start=1):
        if words:
            rows.extend((rank, cat, w) for w in words)
        else:
            rows.append((rank, cat, None))
    return spark.createDataFrame(rows, "rank INT, category STRING, keyword STRING")
