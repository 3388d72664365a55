"""Cell comparison: exact after normalization, then numeric tolerance, then timestamp equality."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions.normalize import canonical_text, normalized_text
from twinledger.spec import CompareRules

# Which texts count as a number or as a full date with an optional time.
NUMBER_PATTERN = r"^\s*[+-]?(\d[\d_]*\.?[\d_]*|\.\d[\d_]*)([eE][+-]?\d+)?\s*$"
DATE_PATTERN = r"^(\d{4,5})([-/ \\])(\d{1,2})\2(\d{1,2})([T ]\d{1,2}:\d{1,2}.*)?$"

MATCH = "MATCH"


def number_from_text(text: Column) -> Column:
    """The text as a double, or null when it is not a plain number."""
    return F.when(text.rlike(NUMBER_PATTERN), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def timestamp_from_text(text: Column) -> Column:
    """The text as a timestamp without zone, or null when it is not a full date."""
    iso = F.regexp_replace(text, DATE_PATTERN, "$1-$3-$4$5")
    return F.when(text.rlike(DATE_PATTERN), iso.try_cast("timestamp_ntz"))


# How far two cells agree.
EXACT, NEAR, DIFFERENT = 0, 1, 2


@dataclass(frozen=True)
class Cell:
    """The comparison of one column, as expressions over the two raw values.

    ``level`` is EXACT for equal normalized values, NEAR for values that agree only within the
    tolerance or as times, else DIFFERENT. It is one expression per cell on purpose: boolean chains
    over all cells of a wide table grow into code that neither Spark nor the JVM compiles well.
    """

    level: Column
    source: Column
    target: Column

    def status(self, level: Column) -> Column:
        """``MATCH``, or the two raw values with null written as ``NULL``, for a computed level."""
        missing = F.lit("NULL")
        return F.when(level < DIFFERENT, F.lit(MATCH)).otherwise(
            F.concat(
                F.lit("MISMATCH: "),
                F.coalesce(self.source, missing),
                F.lit(" || "),
                F.coalesce(self.target, missing),
            )
        )


def compare_cell(name: str, dtype: T.DataType, source: Column, target: Column, rules: CompareRules) -> Cell:
    """Build the comparison for one column whose two sides share ``dtype``.

    Text goes through every rule. Typed values are compared in their own domain, where trimming,
    case and date formats have no meaning; only the numeric tolerance applies.
    """
    tolerance = rules.float_epsilon
    # Equal raw values are equal however they are normalized; most cells end the check here.
    level = F.when(source.eqNullSafe(target), F.lit(EXACT))
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        left, right = normalized_text(source, name, rules), normalized_text(target, name, rules)
        level = level.when(left.eqNullSafe(right), F.lit(EXACT))
        if tolerance:
            gap = F.abs(number_from_text(left) - number_from_text(right))
            level = level.when(gap <= F.lit(float(tolerance)), F.lit(NEAR))
        if rules.normalize_dates:
            level = level.when(timestamp_from_text(left) == timestamp_from_text(right), F.lit(NEAR))
    elif tolerance and isinstance(dtype, T.NumericType):
        if isinstance(dtype, T.IntegralType):
            gap = F.abs(F.try_subtract(source.cast("decimal(20,0)"), target.cast("decimal(20,0)")))
        elif isinstance(dtype, T.DecimalType):
            gap = F.abs(F.try_subtract(source, target))
        else:
            gap = F.abs(source.cast("double") - target.cast("double"))
        exact = isinstance(dtype, T.DecimalType)
        most = F.lit(Decimal(repr(float(tolerance)))) if exact else F.lit(float(tolerance))
        level = level.when(gap <= most, F.lit(NEAR))
    return Cell(
        level.otherwise(F.lit(DIFFERENT)),
        canonical_text(source, dtype, rules.numeric_scale),
        canonical_text(target, dtype, rules.numeric_scale),
    )
