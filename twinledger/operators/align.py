"""Bring two tables together on a composite key in one shuffle.

Both sides are tagged, stacked and grouped by key. Grouping treats null key parts as equal, counts
the rows per side, and keeps one survivor per side and key. Spark aggregates before it shuffles, so
however many copies one key has, each task sends at most one row for it: a hot key cannot pile up in
one reducer, and no join ever sees a duplicate. Where no key repeats, which a pass over the keys alone
finds out, a plain null-safe full outer join saves the sort of whole rows before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions.names import key_names, ref, with_clean_names
from twinledger.functions.normalize import canonical_text, floating_number_text, plain_number_text

N_SOURCE, N_TARGET = "__n_source", "__n_target"
SOURCE, TARGET = "__source", "__target"

# Names of result columns, which a key column may not take.
RESERVED = {"validation_status", "mismatch", "mismatch_exact", "is_difference", "source_rows", "target_rows"}


@dataclass(frozen=True)
class Aligned:
    """One row per key: the key, row counts per side, and one record per side (null if absent)."""

    frame: DataFrame
    keys: list[str]
    columns: dict[str, T.DataType]
    source_only: list[str]
    target_only: list[str]


def _is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def _is_orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _is_orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_is_orderable(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.AtomicType, T.NullType)) and not isinstance(dtype, T.VariantType)


# Digits of the whole-number types.
WHOLE_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _as_decimal(dtype: T.DataType) -> T.DecimalType | None:
    """The decimal type that holds all values of an exact number type, else None."""
    if isinstance(dtype, T.DecimalType):
        return dtype
    digits = WHOLE_DIGITS.get(type(dtype))
    return T.DecimalType(digits, 0) if digits else None


def common_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """The type both sides are compared in, or None when only their text forms can be compared."""
    if _is_text(left) and _is_text(right):
        return T.StringType()
    if left == right:
        return left if _is_orderable(left) else None
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return T.LongType()
    exact = _as_decimal(left), _as_decimal(right)
    if all(exact):
        scale = max(d.scale for d in exact)
        digits = max(d.precision - d.scale for d in exact) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else None
    if any(exact):
        # Floating point cannot hold all exact numbers: their plain texts are compared.
        return None
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        return T.DoubleType()
    times = {type(left), type(right)}
    if times in ({T.DateType, T.TimestampNTZType}, {T.TimestampType, T.TimestampNTZType}):
        return T.TimestampNTZType()
    if times == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return None


def _refuse_inexact_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> None:
    """Floating point against exact numbers would merge keys that differ."""
    for key in keys:
        types = [df.schema[key].dataType for df in (source, target)]
        floating = [isinstance(t, T.FractionalType) and _as_decimal(t) is None for t in types]
        if any(floating) and any(map(_as_decimal, types)):
            raise ValueError(f"key {key} is floating point on one side and exact on the other: cast one of them")


def share_types(
    source: DataFrame, target: DataFrame, names: list[str], numeric_scale: int | None = None
) -> tuple[DataFrame, DataFrame, dict[str, T.DataType]]:
    """Project both sides to ``names``, in one type per column."""
    types: dict[str, T.DataType] = {}
    left, right = [], []
    for name in names:
        from_type, to_type = source.schema[name].dataType, target.schema[name].dataType
        dtype = common_type(from_type, to_type)
        types[name] = dtype or T.StringType()
        for df_type, out in ((from_type, left), (to_type, right)):
            column = ref(name)
            if dtype is None and isinstance(from_type, T.NumericType) and isinstance(to_type, T.NumericType):
                scale = max((d.scale for d in map(_as_decimal, (from_type, to_type)) if d), default=0)
                column = plain_number_text(column) if _as_decimal(df_type) else floating_number_text(column, df_type, scale)
            elif dtype is None:
                column = canonical_text(column, df_type, numeric_scale)
            elif df_type != dtype:
                column = column.cast(dtype)
            out.append(column.alias(name))
    return source.select(*left), target.select(*right), types


def align(
    source: DataFrame,
    target: DataFrame,
    keys: str | list[str],
    unique_keys: bool | None = None,
    keys_only: bool = False,
    numeric_scale: int | None = None,
) -> Aligned:
    """One row per key found on either side.

    Columns present on one side only are reported as drift and not compared. ``unique_keys`` None
    looks at the keys first, with one action, and joins if none repeats. True does so as well and raises
    if one repeats. False groups without looking, which is right where reading the keys costs as much as
    reading everything (text).
    """
    source, target = with_clean_names(source), with_clean_names(target)
    key_list = key_names(keys)
    for side, df in (("source", source), ("target", target)):
        lacking = [k for k in key_list if k not in df.columns]
        if lacking:
            raise ValueError(f"key columns not in {side}: {', '.join(lacking)}")
    taken = sorted(RESERVED.intersection(key_list))
    if taken:
        raise ValueError(f"key columns clash with result columns: {', '.join(taken)}")
    both = [c for c in source.columns if c in target.columns and c not in key_list]
    source_only = [c for c in source.columns if c not in target.columns]
    target_only = [c for c in target.columns if c not in source.columns]
    _refuse_inexact_keys(source, target, key_list)
    names = key_list + ([] if keys_only else both)
    left, right, types = share_types(source, target, names, numeric_scale)
    columns = {c: types[c] for c in names if c not in key_list}

    if keys_only or not columns:
        frame = _keys_by_grouping(left, right, key_list)
    elif unique_keys is not False and not has_repeats(key_list, left, right):
        frame = _by_join(left, right, key_list, list(columns))
    elif unique_keys:
        raise ValueError(f"keys repeat: {', '.join(key_list)}")
    else:
        frame = _by_grouping(left, right, key_list, list(columns))
    return Aligned(frame, key_list, columns, source_only, target_only)


def has_repeats(keys: list[str], *sides: DataFrame) -> bool:
    """Whether a key occurs twice on a side. One job, which reads keys alone and counts them before they move."""
    key_refs = [ref(k) for k in keys]
    tagged = [df.select(F.lit(i).alias("__side"), *key_refs) for i, df in enumerate(sides)]
    counts = reduce(DataFrame.unionByName, tagged).groupBy("__side", *key_refs).agg(F.count(F.lit(1)).alias("__n"))
    return not counts.filter("__n > 1").isEmpty()


def _record(columns: list[str]):
    return F.struct(*[ref(c) for c in columns])


def _by_grouping(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    key_refs = [ref(k) for k in keys]
    stacked = left.select(*key_refs, _record(columns).alias(SOURCE)).unionByName(
        right.select(*key_refs, _record(columns).alias(TARGET)), allowMissingColumns=True
    )
    return stacked.groupBy(*key_refs).agg(
        F.count(SOURCE).alias(N_SOURCE),
        F.count(TARGET).alias(N_TARGET),
        F.min(SOURCE).alias(SOURCE),
        F.min(TARGET).alias(TARGET),
    )


def _keys_by_grouping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    key_refs = [ref(k) for k in keys]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    stacked = left.select(*key_refs, one.alias(N_SOURCE), none.alias(N_TARGET)).unionByName(
        right.select(*key_refs, none.alias(N_SOURCE), one.alias(N_TARGET))
    )
    return stacked.groupBy(*key_refs).agg(F.sum(N_SOURCE).alias(N_SOURCE), F.sum(N_TARGET).alias(N_TARGET))


def _by_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    one = F.lit(1).cast("bigint")
    s = left.select(
        *[ref(k).alias(f"_s{i}") for i, k in enumerate(keys)], _record(columns).alias(SOURCE), one.alias(N_SOURCE)
    )
    t = right.select(
        *[ref(k).alias(f"_t{i}") for i, k in enumerate(keys)], _record(columns).alias(TARGET), one.alias(N_TARGET)
    )
    same_key = F.lit(True)
    for i in range(len(keys)):
        same_key = same_key & F.col(f"_s{i}").eqNullSafe(F.col(f"_t{i}"))
    none = F.lit(0).cast("bigint")
    return s.join(t, same_key, "full_outer").select(
        *[F.coalesce(F.col(f"_s{i}"), F.col(f"_t{i}")).alias(k) for i, k in enumerate(keys)],
        F.coalesce(F.col(N_SOURCE), none).alias(N_SOURCE),
        F.coalesce(F.col(N_TARGET), none).alias(N_TARGET),
        SOURCE,
        TARGET,
    )
