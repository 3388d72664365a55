"""Text normalization as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.spec import CompareRules


@cache
def space_separators() -> str:
    """All space separators (Unicode category Zs), which is what SQL TRIM removes."""
    return "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Zs")


@cache
def whitespace() -> str:
    """All whitespace characters, as stripped around fixed-width fields."""
    return "".join(chr(c) for c in range(0x10000) if chr(c).isspace() and not 0x1C <= c <= 0x1F)


@cache
def accent_table() -> tuple[str, str]:
    """Arguments of ``translate``: accented letters to their base, then all marks to nothing.

    Built from the Unicode rule (decompose, drop marks, compose) one character at a time.
    """
    accented, bases, marks = [], [], []
    # No character beyond these planes has a decomposition or is a mark.
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE1000)):
        char = chr(code)
        if unicodedata.category(char).startswith("M"):
            marks.append(char)
            continue
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        kept = "".join(p for p in parts if not unicodedata.category(p).startswith("M"))
        base = unicodedata.normalize("NFC", kept)
        if len(base) == 1 and base != char:
            accented.append(char)
            bases.append(base)
    return "".join(accented + marks), "".join(bases)


# Where syllables and the letters that compose them begin, and how many letters there are of each kind.
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
LEAD_COUNT, VOWEL_COUNT, TAIL_COUNT = 19, 21, 28


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.hex(code.cast("bigint"))), "UTF-16BE")


def compose_hangul(text: Column) -> Column:
    """Syllables for runs of conjoining letters, by the arithmetic of the Unicode standard.

    What becomes of a letter depends on its neighbours alone: a lead before a vowel starts a syllable, a tail after either
    ends it, and letters that went into a syllable before them go. The code before the first tail stands for none, and
    goes as well, which is what SQL's function makes of it.
    """
    chars = F.split(text, "")
    syllables = LEAD_COUNT * VOWEL_COUNT * TAIL_COUNT

    def code(i: Column) -> Column:
        # Null beyond the ends, where no comparison holds.
        return F.when(i >= 0, F.ascii(F.get(chars, F.greatest(i, F.lit(0)))))

    def among(value: Column, first: int, count: int) -> Column:
        return F.coalesce((value >= first) & (value < first + count), F.lit(False))

    def composed(char: Column, i: Column) -> Column:
        here, after, later = F.ascii(char), code(i + 1), code(i + 2)
        before, earlier = code(i - 1), code(i - 2)
        lead, vowel = (lambda x: among(x, LEADS, LEAD_COUNT)), (lambda x: among(x, VOWELS, VOWEL_COUNT))
        tail = lambda x: among(x, TAILS, TAIL_COUNT)
        open_syllable = lambda x: among(x, SYLLABLES, syllables) & ((x - SYLLABLES) % TAIL_COUNT == 0)
        base = F.lit(SYLLABLES) + ((here - LEADS) * VOWEL_COUNT + (after - VOWELS)) * TAIL_COUNT
        return (
            F.when(lead(here) & vowel(after), _character(base + F.when(tail(later), later - TAILS).otherwise(0)))
            .when(vowel(here) & lead(before), F.lit(""))
            .when(tail(here) & ((vowel(before) & lead(earlier)) | open_syllable(before)), F.lit(""))
            .when(open_syllable(here) & tail(after), _character(here + after - TAILS))
            .otherwise(char)
        )

    letters = f"[{chr(LEADS)}-{chr(LEADS + LEAD_COUNT - 1)}{chr(TAILS)}-{chr(TAILS + TAIL_COUNT - 1)}]"
    return F.when(text.rlike(letters), F.array_join(F.transform(chars, composed), "")).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Letters without their accents. Pure ASCII text is passed through untouched."""
    matching, replace = accent_table()
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(
        compose_hangul(F.translate(text, matching, replace))
    )


def ltrim(text: Column) -> Column:
    return F.ltrim(text, F.lit(space_separators()))


def rtrim(text: Column) -> Column:
    return F.rtrim(text, F.lit(space_separators()))


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(space_separators()))


def upper(text: Column) -> Column:
    """Upper case, one letter for one letter (a sharp s does not become two letters)."""
    return F.upper(F.translate(text, "ß", "ẞ"))


def lower(text: Column) -> Column:
    """Lower case, one letter for one letter and independent of the position in the word."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def canonical_text(value: Column, dtype: T.DataType, numeric_scale: int | None = None) -> Column:
    """The text form of a typed value, used in reports and to compare different types."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return value
    if isinstance(dtype, (T.FloatType, T.DoubleType)) and numeric_scale is not None:
        return value.try_cast(T.DecimalType(38, numeric_scale)).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(_with_sorted_maps(value, dtype))
    return value.cast("string")


def plain_number_text(value: Column) -> Column:
    """An exact number without zeros at the end of its fraction, so that equal numbers have equal texts."""
    text = F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(text, r"\.$", "")


# From here on every double is whole, and digits that a plain text of a smaller one is given.
FIRST_WHOLE = 2**53
FRACTION_DIGITS = 22
# From here on a double may not fit the widest decimal.
LAST_EXACT = 2.0**125


def floating_number_text(value: Column, dtype: T.DataType, scale: int) -> Column:
    """A floating point number as ``plain_number_text`` writes the exact number that equals it.

    Whole numbers beyond 2^53 are written with all their digits: split by 2^62, both parts are exact. Of smaller
    numbers the shortest decimal counts that reads back as the same value. What no decimal of ``scale`` digits can equal
    keeps its scientific form.
    """
    double, shortest = value.cast("double"), value.cast("string")
    part = F.lit(2.0**62)
    high = F.when(F.abs(double) < LAST_EXACT, (double / part).cast("bigint"))
    low = (double - high.cast("double") * part).cast("bigint")
    digits = high.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    text = F.when((F.abs(double) >= FIRST_WHOLE) & high.isNotNull(), digits.cast("string"))
    for places in sorted({FRACTION_DIGITS, max(FRACTION_DIGITS, scale)}):
        decimal = shortest.try_cast(T.DecimalType(38, places))
        text = text.when(decimal.cast(dtype) == value, plain_number_text(decimal))
    return text.otherwise(shortest)


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)


def _with_sorted_maps(value: Column, dtype: T.DataType) -> Column:
    """The value with the entries of all maps in it in key order: maps are equal in any order."""
    if not _holds_map(dtype):
        return value
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _with_sorted_maps(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_with_sorted_maps(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    entries = F.transform(
        F.map_entries(value),
        lambda e: F.struct(e["key"].alias("key"), _with_sorted_maps(e["value"], dtype.valueType).alias("value")),
    )
    by_key = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.map_from_entries(by_key)


def normalized_text(text: Column, name: str, rules: CompareRules) -> Column:
    """All text rules for one column, in their fixed order; null-as-empty comes last."""
    out = text
    if name in rules.ltrim_columns:
        out = ltrim(out)
    elif name in rules.rtrim_columns:
        out = rtrim(out)
    elif name in rules.trim_columns or rules.trim_strings:
        out = trim(out)
    if name in rules.upper_columns:
        out = upper(out)
    if name in rules.lower_columns:
        out = lower(out)
    if name in rules.strip_accents_columns:
        out = strip_accents(out)
    if rules.treat_null_as_empty:
        out = F.coalesce(out, F.lit(""))
    return out
