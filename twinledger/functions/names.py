"""Column names: normalization, quoting and collision checks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def clean_names(names: str | Iterable[str], sep: str = ",") -> list[str]:
    """Strip, lower-case and underscore; a single string is split on ``sep`` first."""
    parts = names.split(sep) if isinstance(names, str) else names
    return [clean_name(part) for part in parts]


def key_names(keys: str | Iterable[str]) -> list[str]:
    """Normalized key columns without repeats, in the given order."""
    names = list(dict.fromkeys(clean_names(keys)))
    if not names:
        raise ValueError("at least one key column is needed")
    return names


def distinct_names(names: Iterable[str]) -> list[str]:
    """Normalized names; raises when two of them become the same."""
    cleaned = clean_names(list(names))
    clashes = sorted(name for name, n in Counter(cleaned).items() if n > 1)
    if clashes:
        raise ValueError(f"column names collide after normalization: {', '.join(clashes)}")
    return cleaned


def with_clean_names(df: DataFrame) -> DataFrame:
    """The same rows under normalized column names (a projection, no data movement)."""
    names = distinct_names(df.columns)
    return df if names == df.columns else df.toDF(*names)


def ref(name: str) -> Column:
    """Reference to a column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
