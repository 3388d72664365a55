"""What to read, how to compare, and what one run needs: three frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from posixpath import basename

from twinledger.functions.names import clean_names

# File suffix -> compression name.
COMPRESSION_BY_SUFFIX = {
    ".gz": "gzip",
    ".gzip": "gzip",
    ".z": "compress",
    ".bz2": "bzip2",
    ".zip": "zip",
}

# Suffixes that Hadoop's own codecs recognise; everything else goes through `sources.archives`.
NATIVE_SUFFIX = {"gzip": ".gz", "bzip2": ".bz2"}


def compression_of(path: str) -> str | None:
    """Compression name from the file suffix, or None."""
    lowered = str(path).lower()
    for suffix, name in COMPRESSION_BY_SUFFIX.items():
        if lowered.endswith(suffix):
            return name
    return None


@dataclass(frozen=True)
class TableSpec:
    """One side of a comparison: where it lies and how its bytes become rows of text.

    ``path`` may be any URI that Spark can open; it is handed on unchanged. ``col_specs`` are
    half-open ``(start, end)`` positions. ``fan_out`` is the number of partitions that lines of
    an unsplittable file (gzip, zip) are spread over; None means the session's parallelism.
    ``max_record_bytes`` bounds a record whose quoted fields hold line ends; a longer one is a reject.
    """

    path: str
    file_type: str = "csv"
    delimiter: str = ","
    col_specs: tuple[tuple[int, int], ...] | None = None
    header_rows: int = 0
    trailer_patterns: tuple[str, ...] = ()
    column_names: tuple[str, ...] | None = None
    compression: str | None = "auto"
    encoding: str = "utf-8"
    quote: str = '"'
    multi_line: bool = False
    fan_out: int | None = None
    max_record_bytes: int = 64 * 1024 * 1024

    def __post_init__(self) -> None:
        object.__setattr__(self, "path", str(self.path))
        object.__setattr__(self, "trailer_patterns", tuple(self.trailer_patterns or ()))
        if self.col_specs is not None:
            object.__setattr__(self, "col_specs", tuple((int(a), int(b)) for a, b in self.col_specs))
        if self.column_names is not None:
            object.__setattr__(self, "column_names", tuple(self.column_names))
        if self.header_rows < 0:
            raise ValueError("header_rows must not be negative")
        if self.codec == "compress":
            raise ValueError(f"Unix compress files cannot be read by Spark; convert first: {self.path}")

    @property
    def is_fixed_width(self) -> bool:
        return self.file_type.lower() == "fwf"

    @property
    def is_parquet(self) -> bool:
        return self.file_type.lower() == "parquet"

    @property
    def is_object_store(self) -> bool:
        return self.path.startswith("gs://")

    @property
    def codec(self) -> str | None:
        """The compression in force: the given one, or by suffix when it is ``auto``."""
        if self.is_parquet:
            return None
        if self.compression in ("auto", None, ""):
            return compression_of(self.path)
        named = {"gz": "gzip", "bz2": "bzip2"}.get(self.compression, self.compression)
        if named not in ("gzip", "bzip2", "zip", "compress", "none"):
            raise ValueError(f"unknown compression: {self.compression!r}")
        return None if named == "none" else named

    @property
    def is_compressed(self) -> bool:
        return self.codec is not None

    @property
    def opens_natively(self) -> bool:
        """True when Spark's text reader decodes the file by itself."""
        return self.codec is None or self.path.lower().endswith(NATIVE_SUFFIX.get(self.codec, "\0"))

    @property
    def filename(self) -> str:
        return basename(self.path.rstrip("/"))


@dataclass(frozen=True)
class CompareRules:
    """How two cells are made comparable. Column lists are matched after name normalization.

    Trimming picks one rule per column: left, else right, else both sides, else ``trim_strings``.
    ``numeric_scale`` renders floating point values with that many decimals in reports.
    """

    float_epsilon: float | None = None
    normalize_dates: bool = False
    trim_strings: bool = False
    treat_null_as_empty: bool = True
    ltrim_columns: tuple[str, ...] = ()
    rtrim_columns: tuple[str, ...] = ()
    trim_columns: tuple[str, ...] = ()
    upper_columns: tuple[str, ...] = ()
    lower_columns: tuple[str, ...] = ()
    strip_accents_columns: tuple[str, ...] = ()
    numeric_scale: int | None = None

    def __post_init__(self) -> None:
        for name in (
            "ltrim_columns",
            "rtrim_columns",
            "trim_columns",
            "upper_columns",
            "lower_columns",
            "strip_accents_columns",
        ):
            object.__setattr__(self, name, tuple(clean_names(getattr(self, name) or ())))


@dataclass(frozen=True)
class JobConfig:
    """A complete comparison run, with its two sides described independently."""

    job_name: str
    source: TableSpec
    target: TableSpec
    primary_keys: tuple[str, ...]
    output: str
    rules: CompareRules = field(default_factory=CompareRules)
    sample_rows: int = 500

    def __post_init__(self) -> None:
        object.__setattr__(self, "primary_keys", tuple(self.primary_keys))
