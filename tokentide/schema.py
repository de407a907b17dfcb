"""Column and argument checks made before a job starts."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

_TAG = re.compile(r"[A-Za-z0-9_]+")


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Fail when a column is missing."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")


def require_absent(df: DataFrame, columns: Iterable[str]) -> None:
    """Fail when a column that is about to be added exists."""
    held = {name.lower() for name in df.columns}
    present = [name for name in columns if name.lower() in held]
    if present:
        raise ValueError(f"input already has columns {present}")


def require_type(df: DataFrame, column: str, *allowed: type[T.DataType]) -> None:
    """Fail when a column is missing or of another type."""
    require_columns(df, [column])
    actual = df.schema[column].dataType
    if not isinstance(actual, allowed):
        names = "/".join(kind.__name__ for kind in allowed)
        raise TypeError(f"column {column!r} is {actual.simpleString()}, expected {names}")


def valid_tag(tag: str) -> str:
    """An output tag: ASCII letters, digits and underscores only."""
    if not _TAG.fullmatch(tag):
        raise ValueError(f"tag must be ASCII letters, digits or '_', got {tag!r}")
    return tag


def parse_named(text: str, shape: str = "NAME=VALUE") -> tuple[str, str]:
    """Split ``NAME=VALUE`` at the first ``=``; the name is trimmed, neither part is empty."""
    name, found, value = text.partition("=")
    if not found or not name.strip() or not value:
        raise ValueError(f"expected {shape}, got {text!r}")
    return name.strip(), value


def parse_dataset(text: str) -> tuple[str, list[str]]:
    """Split ``LABEL=path,path,...``; no path may be empty."""
    label, value = parse_named(text, "LABEL=PATH,...")
    paths = value.split(",")
    if not all(paths):
        raise ValueError(f"expected LABEL=PATH,..., got {text!r}")
    return label, paths


def checked_count(column: Column, label: str) -> Column:
    """A token count as long; the job fails on a null or negative value."""
    bad = F.raise_error(
        F.concat(F.lit(f"invalid count in {label}: "), F.coalesce(column.cast("string"), F.lit("null")))
    )
    return F.when(column >= 0, column.cast("long")).otherwise(bad.cast("long"))


def checked_label(column: Column, label: str) -> Column:
    """A group label; the job fails on a null value."""
    return F.coalesce(column, F.raise_error(F.lit(f"null value in {label}")).cast("string"))
