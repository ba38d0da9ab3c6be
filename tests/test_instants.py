from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions.instants import days_from_civil, epoch_millis
from millrace.operators.instants import to_instants

BERLIN = ("Europe/Berlin", "DMY")
NEW_YORK = ("America/New_York", "MDY")


@pytest.mark.parametrize(
    ("text", "board", "iso"),
    [
        ("2026-04-25T16:40:49.643Z", BERLIN, "2026-04-25T16:40:49.643"),
        ("2026-02-20T21:28:57z", BERLIN, "2026-02-20T21:28:57"),
        ("2025-05-20 22:37:28.774972-07:00", BERLIN, "2025-05-21T05:37:28.774"),
        ("20260203T012631+0100", BERLIN, "2026-02-03T00:26:31"),
        ("2026-02-03", BERLIN, "2026-02-02T23:00:00"),
        ("20250316", ("UTC", "YMD"), "2025-03-16T00:00:00"),
        ("09-02-2025 17:30", BERLIN, "2025-02-09T16:30:00"),
        ("8/16/2025 2:03 PM", NEW_YORK, "2025-08-16T18:03:00"),
        ("1/2/2026 12:05 am", NEW_YORK, "2026-01-02T05:05:00"),
        ("2025-03-30 02:30:00 Europe/Berlin", BERLIN, "2025-03-30T01:30:00"),  # skipped: the offset before
        ("2025-10-26 02:30", BERLIN, "2025-10-26T00:30:00"),  # twice: the first
        ("2026-10-25T02:15+02:00", NEW_YORK, "2026-10-25T00:15:00"),
        ("2025-07-02 13:13:11 America/New_York", BERLIN, "2025-07-02T17:13:11"),
        ("2026-04-28T10:13:40+01:00[Europe/London]", BERLIN, "2026-04-28T09:13:40"),
        ("Fri, 09 Jan 2026 02:38:13 EST", BERLIN, "2026-01-09T07:38:13"),
        ("Wed, 23 Apr 2025 00:47:53 PST", BERLIN, "2025-04-23T08:47:53"),  # its own offset in any season
        ("10 December 2025, 13:46 CEST", BERLIN, "2025-12-10T11:46:00"),
        ("13-Jan-2026 21:03 UTC", BERLIN, "2026-01-13T21:03:00"),
        ("Tue Sep  2 17:17:04 2026", ("UTC", "YMD"), "2026-09-02T17:17:04"),
        ("Updated: 2025-05-01T22:19:21-0700", BERLIN, "2025-05-02T05:19:21"),
        ("Posted Oct 1, 2025 3:35 PM GMT ", BERLIN, "2025-10-01T15:35:00"),
        ("1754772870142", BERLIN, "2025-08-09T20:54:30.142"),
        ("1751502721", BERLIN, "2025-07-03T00:32:01"),
        ("1751502721.9", BERLIN, "2025-07-03T00:32:01.9"),
        ("1736127316924553", BERLIN, "2025-01-06T01:35:16.924"),
        ("1736127316924553123", BERLIN, "2025-01-06T01:35:16.924"),
        ("2024-02-29", ("UTC", "YMD"), "2024-02-29T00:00:00"),
    ],
)
def test_reads(text, board, iso):
    assert epoch_millis(text, *board) == round(datetime.fromisoformat(iso).replace(tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize("text", [None, "", " ", "soon", "n/a", "3 days ago", "25:61", "0000-00-00", "2025-02-29", "2025-13-01", "2025-01-01T24:00:00Z", "2025-01-01 10:00 XYZ", "31/31/2025", "123456789", "13:00 PM", "2025-01-01 13:00 PM" * 5000])
def test_leaves_out(text):
    assert epoch_millis(text, *BERLIN) is None


@given(st.datetimes(datetime(1, 1, 1), datetime(9999, 12, 31)))
def test_day_arithmetic(t):
    assert days_from_civil(t.year, t.month, t.day) == (t - datetime(1970, 1, 1)) // timedelta(days=1)


@given(st.datetimes(datetime(1971, 1, 1), datetime(2100, 1, 1)), st.integers(-14 * 60, 14 * 60))
def test_round_trip(t, minutes):
    sign, (h, m) = "-" if minutes < 0 else "+", divmod(abs(minutes), 60)
    text = t.strftime("%Y-%m-%dT%H:%M:%S") + f".{t.microsecond:06d}{sign}{h:02d}:{m:02d}"
    assert epoch_millis(text, "UTC", "YMD") == (t - timedelta(minutes=minutes) - datetime(1970, 1, 1)) // timedelta(milliseconds=1)


def test_operator(spark, rows):
    boards = spark.createDataFrame([("b", "Europe/Berlin", "DMY")], "source string, zone_name string, date_order string")
    df = spark.createDataFrame([("1", "2026-02-03", "b", 1), ("2", "2026-02-03", None, 1), ("3", None, "b", 1), (None, "1751502721", "b", 1), ("5", "soon", "b", 1), ("6", "2026-02-03", "?", 1), ("6", "2026-02-03", "?", 1)], "id string, update_time string, source string, epoch_ms int")
    day = 1770076800000
    assert rows(to_instants(df, "id", "update_time", "source", boards)) == sorted([("1", day - 3600_000), ("2", day), (None, 1751502721000), ("6", day), ("6", day)], key=repr)
    assert rows(to_instants(df.limit(0), "id", "update_time", "source", boards)) == []
    assert len(rows(to_instants(df, "id", "update_time", "source", boards.limit(0)))) == 5
