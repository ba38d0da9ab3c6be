import pytest

from millrace.streaming.queue import MESSAGE, consume, events_from


def stream_of(spark, folder, *messages):
    spark.createDataFrame([(m, None, None) for m in messages], MESSAGE.replace(",", ", ")).write.mode("append").parquet(f"{folder}/in")
    return events_from(spark, f"{folder}/in", MESSAGE)


def test_every_kind_runs_in_the_order_of_the_handlers(spark, tmp_path):
    ran = []
    handlers = {k: lambda limit, k=k: ran.append(k) for k in ("crawl", "embed", "match", "notify")}
    consume(stream_of(spark, tmp_path, "notify", "match", "match", "crawl", "other"), handlers, str(tmp_path / "c")).awaitTermination()
    assert ran == ["crawl", "match", "notify"]
    # What was consumed isn't consumed again.
    consume(stream_of(spark, tmp_path, "embed"), handlers, str(tmp_path / "c")).awaitTermination()
    assert ran == ["crawl", "match", "notify", "embed"]


def test_a_handler_that_fails_is_repeated_and_reported(spark, tmp_path):
    waits, failed, ran = [], [], []

    def crawl(limit):
        raise ValueError("down")

    handlers = {"crawl": crawl, "embed": lambda limit: ran.append("embed")}
    consume(stream_of(spark, tmp_path, "crawl", "embed"), handlers, str(tmp_path / "c"), failed=lambda *x: failed.append(x), wait=waits.append).awaitTermination()
    assert waits == [60.0] * 3 and failed == [("crawl", "ValueError: down")] and ran == ["embed"]
    with pytest.raises(Exception, match="down"):
        consume(stream_of(spark, tmp_path, "crawl"), {"crawl": crawl}, str(tmp_path / "d"), retries=0).awaitTermination()
