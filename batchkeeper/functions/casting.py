"""Typing raw text by the contract without hiding what does not fit."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAST_ERROR = "_cast_error"
#: The raw line of a row that is not one: more or fewer fields than its header, or no JSON object. Else NULL.
MALFORMED = "_malformed"


def cast_to_contract(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Type the named columns; a value that does not fit becomes NULL *and* is listed.

    ``types`` maps column to Spark type. ``_cast_error`` holds the names of the
    columns whose raw value was present but not of the declared type, so a format
    drift can never pass as a null spike. A malformed line is listed as ``_malformed``. Other columns are carried along.
    """
    typed, errors = [], []
    if MALFORMED in df.columns:
        errors.append(F.when(F.col(MALFORMED).isNotNull(), F.lit(MALFORMED)))
    for name in df.columns:
        if name in types:
            cast = F.col(name).try_cast(types[name])
            typed.append(cast.alias(name))
            errors.append(F.when(F.col(name).isNotNull() & cast.isNull(), F.lit(name)))
        else:
            typed.append(F.col(name))
    listed = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return df.select(*typed, listed.alias(CAST_ERROR))


def cast_failure_share(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """(column_name, n_rows, n_bad) for every declared column, in one pass over the raw text.

    Malformed lines are counted under ``_malformed``, and their fragments under no column.
    """
    present = [c for c in types if c in df.columns]
    whole = F.col(MALFORMED).isNull() if MALFORMED in df.columns else F.lit(True)
    bad = [
        F.count_if(whole & F.col(c).isNotNull() & F.col(c).try_cast(types[c]).isNull()).alias(f"bad_{i}")
        for i, c in enumerate(present)
    ]
    if MALFORMED in df.columns:
        bad.append(F.count(MALFORMED).alias(f"bad_{len(present)}"))
        present.append(MALFORMED)
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *bad)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), F.col(f"bad_{i}").alias("n_bad"))
            for i, c in enumerate(present)
        ]
    )
    return counted.select(F.inline(rows))


def well_formed(df: DataFrame) -> DataFrame:
    """The rows of a batch, without the lines that are none."""
    return df.filter(F.col(MALFORMED).isNull()) if MALFORMED in df.columns else df


def parse_date(column: Column, formats: Sequence[str]) -> Column:
    """First format that fits wins; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(column), F.lit(f)) for f in formats]).cast("date")


def clean_text(column: Column, case: str | None = None) -> Column:
    """Trim, squeeze inner blanks and optionally fold case (``lower``, ``upper``, ``title``)."""
    text = F.regexp_replace(F.trim(column), r"\s+", " ")
    folds = {None: lambda c: c, "lower": F.lower, "upper": F.upper, "title": F.initcap}
    return folds[case](text)


def standardize(
    df: DataFrame,
    dates: Mapping[str, Sequence[str]] | None = None,
    text: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Bring date columns to DATE and text columns to one spelling."""
    out = {c: parse_date(F.col(c), formats) for c, formats in (dates or {}).items()}
    out.update({c: clean_text(F.col(c), case) for c, case in (text or {}).items()})
    return df.withColumns(out) if out else df


def as_raw_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The staged form of a typed table: every named column as text."""
    wanted = set(columns or df.columns)
    return df.select(*[F.col(c).cast("string").alias(c) if c in wanted else F.col(c) for c in df.columns])
