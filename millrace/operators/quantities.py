"""Pay figures of mixed notation, currency and period in one unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.units import PayScale
from millrace.operators.arrowmap import arrow_map
from millrace.session import spread

#: Units are read to the driver only up to this many.
MAX_UNITS = 100_000


def to_usd_per_year(df: DataFrame, key: str, field: str, description: str, unit_ref: DataFrame) -> DataFrame:
    """``(key, low_usd, high_usd)``: one row per row whose ``field`` holds a pay figure.

    ``unit_ref`` is ``(unit_code, unit_kind, factor)``. A figure with neither
    currency nor period takes both from ``description``, also where a currency
    stands in an aside (a bonus, say). Null, blank and figureless fields and
    fields whose currency is unknown give no row; a null key is kept; repeated
    rows give repeated rows.
    """
    rows = unit_ref.select("unit_code", "unit_kind", "factor").limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"unit_ref has more than {MAX_UNITS} rows")
    factors = {(r[0], r[1]): r[2] for r in rows}

    def setup():
        scale = PayScale(factors)

        def run(keys, fields, descriptions):
            found = [(k, r) for k, f, d in zip(keys, fields, descriptions) if (r := scale.range_of(f, d))]
            return [k for k, _ in found], [r[0] for _, r in found], [r[1] for _, r in found]

        return run

    kind = df.schema[key].dataType.simpleString()
    # Whether the figure is bare shows only once its asides are cut, so every description is sent.
    figures = df.where(F.col(field).rlike(r"\d")).select(key, field, F.col(description).alias("stated"))
    return arrow_map(spread(figures), setup, f"`{key}` {kind}, low_usd bigint, high_usd bigint")
