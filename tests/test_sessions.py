from datetime import datetime, timedelta

from millrace.schemas import SESSION_EVENT
from millrace.streaming.sessions import EXPECT, UPLOAD, session_actions, session_stream

T0 = datetime(2026, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(c, T0 + timedelta(seconds=s), k, x) for c, s, k, x in rows], SESSION_EVENT)


ROWS = [
    (1, 0, "command", UPLOAD), (1, 5, "text", "hello"), (1, 6, "text", "again"), (1, 10, "document", None), (1, 20, "text", "after"),
    (2, 0, "command", EXPECT), (2, 30, "text", "remote"), (2, 40, "text", "more"), (2, 50, "callback", "matched_jobs_callback_data_1"),
    (3, 0, "command", EXPECT), (3, 600, "text", "late"), (3, 601, "command", UPLOAD), (3, 602, "command", EXPECT), (3, 603, "text", "in time"),
    (4, 0, "text", "nothing"), (5, 0, "document", None), (6, 0, "command", "/start"), (6, 1, "text", None),
    (7, 0, "command", EXPECT), (7, 1, "text", "same"), (7, 1, "text", "same"), (None, 0, "text", "nobody"),
]
ACTIONS = {
    1: [UPLOAD, "ask_for_file", "ask_for_file", "store_resume", "ignored"], 2: [EXPECT, "store_expectations", "ignored", "turn_page"], 3: [EXPECT, "ignored", UPLOAD, EXPECT, "store_expectations"],
    4: ["ignored"], 5: ["store_resume"], 6: ["/start", "ignored"], 7: [EXPECT, "store_expectations", "ignored"],
}


def by_chat(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["ts"], r["action"] == "ignored")):
        out.setdefault(r["chat_id"], []).append(r["action"])
    return out


def test_batch(spark):
    df = events(spark, *ROWS)
    assert by_chat(session_actions(df).collect()) == ACTIONS
    assert session_actions(df.limit(0)).count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    whole = events(spark, *ROWS)
    for i, (a, b) in enumerate(((0, 25), (25, 605))):  # two micro-batches in the order of time
        whole.where(f"ts >= timestamp'2026-01-01' + interval {a} second and ts < timestamp'2026-01-01' + interval {b} second").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SESSION_EVENT).parquet(str(tmp_path / "in"))
        query = session_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120), i
    assert by_chat(spark.read.parquet(str(tmp_path / "out")).collect()) == ACTIONS
