"""Timestamps of mixed notation as instants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.instants import epoch_millis
from millrace.operators.arrowmap import arrow_map
from millrace.session import spread

#: Boards are read to the driver only up to this many.
MAX_BOARDS = 100_000


def to_instants(df: DataFrame, key: str, field: str, source: str, board_ref: DataFrame) -> DataFrame:
    """``(key, epoch_ms)``: one row per row of ``df`` whose ``field`` states an instant.

    ``board_ref`` (``source, zone_name, date_order``) gives each source's zone
    and date order; a source that is null or not listed counts as UTC and year
    first. Null, blank, relative and impossible values give no row; a null key
    is kept; repeated rows give repeated rows.
    """
    rows = board_ref.select("source", "zone_name", "date_order").limit(MAX_BOARDS + 1).collect()
    if len(rows) > MAX_BOARDS:
        raise ValueError(f"board_ref has more than {MAX_BOARDS} rows")
    boards = {r[0]: (r[1], r[2]) for r in rows}

    def setup():
        def run(keys, texts, sources):
            found = [(k, ms) for k, t, s in zip(keys, texts, sources) if (ms := epoch_millis(t, *boards.get(s, ("UTC", "YMD")))) is not None]
            return [k for k, _ in found], [ms for _, ms in found]

        return run

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(spread(df.select(key, field, source).where(F.col(field).isNotNull())), setup, f"`{key}` {kind}, epoch_ms bigint")
