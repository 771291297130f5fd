"""Fitted models as Parquet tables of named arrays."""

from __future__ import annotations

from dataclasses import fields

import numpy as np
from pyspark.sql import SparkSession

SCHEMA = "name string, shape array<int>, values array<double>"


def save_model(spark: SparkSession, model, path: str) -> None:
    """Writes a dataclass of arrays and numbers, one row per field."""
    rows = []
    for f in fields(model):
        a = np.asarray(getattr(model, f.name), dtype=float)
        rows.append((f.name, list(a.shape), a.ravel().tolist()))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, kind: type):
    """Reads what save_model() wrote back into the dataclass kind; fields without dimensions come back as numbers."""
    rows = {r["name"]: np.array(r["values"], dtype=float).reshape(r["shape"]) for r in spark.read.schema(SCHEMA).parquet(path).collect()}
    missing = {f.name for f in fields(kind)} - set(rows)
    if missing:
        raise ValueError(f"the table lacks {sorted(missing)}")
    return kind(**{f.name: float(rows[f.name]) if rows[f.name].shape == () else rows[f.name] for f in fields(kind)})
