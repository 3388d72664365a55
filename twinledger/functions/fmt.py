"""Human-readable sizes, durations, times and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinledger.spec import COMPRESSION_BY_SUFFIX

# Unit names, smallest first.
SI_UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")
IEC_UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def format_bytes(value: Column, decimals: int = 2, binary: bool = False) -> Column:
    """``1.02 MB`` or, with ``binary``, ``1.50 KiB``; the sign is kept, plain bytes have no decimals."""
    base = 1024.0 if binary else 1000.0
    amount = F.abs(value.cast("double"))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    pattern = F.lit("0." + "0" * decimals if decimals else "0")
    text = F.when(amount < base, F.concat(amount.cast("bigint").cast("string"), F.lit(" B")))
    units = IEC_UNITS if binary else SI_UNITS
    for power in range(len(units), 0, -1):
        factor = base**power
        scaled = F.call_function("format_number", amount / F.lit(factor), pattern)
        text = text.when(amount >= factor, F.concat(scaled, F.lit(" " + units[power - 1])))
    return F.concat(sign, text)


def format_duration(start: Column, end: Column) -> Column:
    """``1 days 2 hours 3 min 4 sec`` from two times in seconds; leading zero parts are left out."""
    total = F.rint(end.cast("double") - start.cast("double")).cast("bigint")
    days = F.floor(total / 86400)
    rest = total - days * 86400
    hours = F.floor(rest / 3600)
    minutes = F.floor((rest - hours * 3600) / 60)
    seconds = rest - hours * 3600 - minutes * 60

    def part(number: Column, unit: str) -> Column:
        return F.concat(number.cast("string"), F.lit(unit))

    return F.concat_ws(
        " ",
        F.when(days != 0, part(days, " days")),
        F.when((days != 0) | (hours != 0), part(hours, " hours")),
        F.when((days != 0) | (hours != 0) | (minutes != 0), part(minutes, " min")),
        part(seconds, " sec"),
    )


def safe_name(text: Column) -> Column:
    """Everything but letters, digits, underscore and hyphen becomes an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def base_name(path: Column) -> Column:
    """The part of a path after its last slash."""
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1")


def run_id(job_name: Column, file_name: Column, at: Column) -> Column:
    """``<job>_<file stem>_<yyyyMMdd_HHmmss>`` with unsafe characters replaced."""
    return F.concat_ws(
        "_",
        safe_name(job_name),
        safe_name(file_stem(file_name)),
        F.date_format(at, "yyyyMMdd_HHmmss"),
    )


def storage_scheme(path: Column) -> Column:
    """The URI scheme of a path, ``file`` when it has none."""
    scheme = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]+):", 1)
    return F.when(scheme == "", F.lit("file")).otherwise(F.lower(scheme))


def bucket_of(path: Column) -> Column:
    """Bucket of an object-store URI, null for other paths."""
    return F.nullif(F.regexp_extract(path, r"^gs://([^/]*)", 1), F.lit(""))


def blob_of(path: Column) -> Column:
    """Object name within the bucket, null for other paths."""
    return F.nullif(F.regexp_extract(path, r"^gs://[^/]*/+(.*)$", 1), F.lit(""))


def compression_type(path: Column) -> Column:
    """Compression name by suffix, null when there is none."""
    lowered = F.lower(path)
    found = F.lit(None).cast("string")
    for suffix, name in COMPRESSION_BY_SUFFIX.items():
        found = F.when(lowered.endswith(suffix), F.lit(name)).otherwise(found)
    return found


DISPLAY_PATTERN = "yyyy-MM-dd HH:mm:ss"


def _shown(local: Column) -> Column:
    """A zone-less time to the second, whatever the session's zone is."""
    return F.substring(local.cast("string"), 1, len("yyyy-MM-dd HH:mm:ss"))


def _in_zone(at_utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at_utc)


def render_utc(at_utc: Column) -> Column:
    """A zone-less UTC time as ``2024-01-01 00:00:07 UTC``."""
    return F.concat(_shown(at_utc), F.lit(" UTC"))


def render_ist(at_utc: Column) -> Column:
    return F.concat(_shown(_in_zone(at_utc, "Asia/Kolkata")), F.lit(" IST"))


def render_et(at_utc: Column) -> Column:
    """US eastern time; the suffix tells standard from daylight time."""
    local = _in_zone(at_utc, "America/New_York")
    daylight = F.timestamp_diff("HOUR", at_utc, local) == -4
    return F.concat(_shown(local), F.when(daylight, F.lit(" EDT")).otherwise(F.lit(" EST")))


def render_local(at_utc: Column) -> Column:
    """The time in the session's zone, with that zone's abbreviation."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, at_utc))
    return F.date_format(instant, DISPLAY_PATTERN + " zzz")


def name_components(name: Column) -> Column:
    """The parts of a file name between dots, underscores and hyphens."""
    return F.split(name, "[_.-]")
