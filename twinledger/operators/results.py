"""Views over a finished detail table: mismatches only, search, and column discovery."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.functions.names import key_names, ref
from twinledger.operators.reconcile import FOUND_IN_BOTH

# What is appended to a compared column's name in detail tables.
STATUS_SUFFIX, SOURCE_SUFFIX, TARGET_SUFFIX = "_status", "_source", "_target"


def data_columns(detail: DataFrame, keys: list[str]) -> list[str]:
    """Names of the compared columns, found by their whole triplet of suffixed columns.

    A table without triplets yields its plain non-key columns.
    """
    names = set(detail.columns)
    found = []
    for column in detail.columns:
        stem = column.removesuffix(STATUS_SUFFIX)
        if column != stem and {stem + SOURCE_SUFFIX, stem + TARGET_SUFFIX} <= names:
            found.append(stem)
    if found:
        return found
    suffixes = (STATUS_SUFFIX, SOURCE_SUFFIX, TARGET_SUFFIX)
    return [c for c in detail.columns if c not in keys and not c.endswith(suffixes)]


def mismatches_only(detail: DataFrame) -> DataFrame:
    """Rows found on both sides, that is, those listed for differing values."""
    return detail.filter(F.col("validation_status") == FOUND_IN_BOTH)


def search_rows(detail: DataFrame, text: str, status: str | None = None) -> DataFrame:
    """Rows where any column contains ``text`` (case ignored), optionally of one status."""
    joined = F.lower(F.concat_ws(" ", *[ref(c).cast("string") for c in detail.columns]))
    found = detail.filter(joined.contains(text.lower()))
    return found if status is None else found.filter(F.col("validation_status") == status)


def rows_of_key(detail: DataFrame, key: Mapping[str, object], status: str | None = None) -> DataFrame:
    """Rows whose key columns hold the given values (None: null), optionally of one status.

    Not all key columns need be given. Values are cast to the columns' types, so that the condition goes down
    to stored files, which are skipped by their Bloom filters and page statistics; a value that the
    type cannot hold is an error.
    """
    for name, value in zip(key_names(list(key)), key.values()):
        held = ref(name)
        wanted = held.isNull() if value is None else held == F.lit(value).cast(detail.schema[name].dataType)
        detail = detail.filter(wanted)
    return detail if status is None else detail.filter(F.col("validation_status") == status)
