import re
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from millrace.plans.reference_queries import QUERIES, TODAY

ISO = re.compile(r"\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?")
MAIL = re.compile(r"([A-Za-z]{3}, *)?\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d(:\d\d)? *(GMT|UT|UTC|Z|[+-]\d{4})")
TIMES = [
    None, "", "   ", "garbage", "2024-02-31", "0000-00-00", "1725161072", "1728988807907", "2024/08/30 04:05", "01/01/2026 21:16", "April 10, 2026 4:03 AM", "Fri Apr 10 20:14:54 2026",
    "20241106T001542Z", "2024-08-05 23:21:15", "2024-10-02 09:07:28 Europe/Berlin", "2025-01-14T13:19:06+05:30[Asia/Kolkata]", "Fri, 01 Aug 2025 07:29:41 EDT", "2024-10-10T25:00:00Z",
    "2024-08-23", " 2024-08-23\n", "2024-12-31T23:30", "2024-10-10T18:48:07.742Z", "2024-12-31T20:48:21-08:00", "2025-01-01T03:00+1100", "2024-03-30T23:35:12+0000", "Fri, 03 Jul 2026 01:22:31 +0200", "1 Aug 2025 23:18 -0530", "Fri, 02 Jan 2026 08:22:36 GMT",
]


def day(text):
    t = (text or "").strip()
    try:
        found = datetime.fromisoformat(t) if ISO.fullmatch(t) else parsedate_to_datetime(t) if MAIL.fullmatch(t) else None
    except ValueError:
        found = None
    if found is None:
        return TODAY
    return (found if found.tzinfo is None else found.astimezone(UTC)).strftime("%Y-%m-%d")


def test_every_row_has_a_day(spark, rows, tmp_path):
    data = [(f"{i:02}", t) for i, t in enumerate(TIMES)] + [(None, None), ("00", None)]
    spark.createDataFrame(data, "id string, update_time string").write.parquet(f"{tmp_path}/job_detail.parquet")
    got = rows(QUERIES["c11_job_days"](spark, str(tmp_path)))
    assert got == sorted(((i, day(t)) for i, t in data), key=repr)
    assert sum(d == TODAY for _, d in got) == 20 and len(got) == len(data)
