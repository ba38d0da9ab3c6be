"""One row per value of a field that holds several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.multivalue import ValueSplitter, contains_delimiter, country_spellings
from millrace.operators.arrowmap import arrow_map
from millrace.session import spread

#: A reference list is read to the driver only up to this many rows that matter there.
MAX_REFERENCE = 200_000


def _few(df: DataFrame, what: str) -> list[str]:
    """The one column of ``df``, if it has no more than ``MAX_REFERENCE`` rows."""
    rows = df.limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"the reference has more than {MAX_REFERENCE} {what}")
    return sorted(r[0] for r in rows if r[0])


def country_codes(place_ref: DataFrame) -> list[str]:
    """The distinct country codes of a place list."""
    return _few(place_ref.select("country_code").distinct(), "country codes")


def names_with_delimiters(place_ref: DataFrame) -> list[str]:
    """The names of a place list that hold a delimiter; only they leave the cluster."""
    names = place_ref.select(F.explode(F.concat(F.array("place_name"), F.coalesce("alt_names", F.array().cast("array<string>")))).alias("name"))
    marked = names.where(F.col("name").rlike(r"[,;|/&•·\n\r\t、，；｜]|(?i) (and|or) ")).distinct()
    return [n for n in _few(marked, "names with delimiters") if contains_delimiter(n)]


def split_rules(place_ref: DataFrame) -> tuple[list[str], list[str]]:
    """Names that hold a delimiter, and country spellings, of a place list."""
    return names_with_delimiters(place_ref), sorted(country_spellings(country_codes(place_ref)))


def split_values(df: DataFrame, key: str, field: str, place_ref: DataFrame, least: int = 2) -> DataFrame:
    """``(key, pos, piece)``: one row per value of each ``field`` holding at least ``least``.

    Null, empty and blank fields and fields of delimiters only give no row. A
    null key is kept as null. Repeated rows each give their rows. Other columns
    of ``df`` are ignored, so names can't clash.
    """
    protected, qualifiers = split_rules(place_ref)

    def setup():
        split = ValueSplitter(protected, qualifiers)

        def run(keys, fields):
            out = ([], [], [])
            for k, text in zip(keys, fields):
                values = split(text)
                if len(values) >= least:
                    for pos, value in enumerate(values, 1):
                        out[0].append(k)
                        out[1].append(pos)
                        out[2].append(value)
            return out

        return run

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, field).where(F.col(field).rlike(r"\S"))
    return arrow_map(spread(rows), setup, f"`{key}` {kind}, pos bigint, piece string")
