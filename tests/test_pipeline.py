import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.providers import HashedWords, KeepAll
from millrace.operators.store import SnapshotStore
from millrace.plans import pipeline
from millrace.plans.access import all_jobs_reply, outbox
from millrace.plans.pipeline import Pipeline, match_candidates, match_prompts, self_test, shared_candidates
from millrace.schemas import JOB, MATCH, USER, VECTOR
from millrace.session import cut_lineage
from millrace.sources.http import AllSourcesFailed
from millrace.sources.listings import read_uploads


def failing():
    class Fails(HashedWords):  # local, so that it travels to the workers by value
        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("poison")
            return HashedWords.embed(self, texts)

    return Fails()


LISTINGS = "title string, url string, description string, tags array<string>, location string, salary string, update_time string"


def listings(spark):
    rows = [("Data engineer", "u1", "spark python data", "2026-03-20"), ("Data engineer again", "u1", "other", "2026-03-20"), ("Old", "u2", "spark python data", "2025-01-01"), ("Empty", "u3", "", ""), ("Poison", "u4", "poison", "2026-03-20"), ("Cook", "u5", "kitchen soup", "2026-03-21")]
    return spark.createDataFrame([(t, u, d, [], "", "", w) for t, u, d, w in rows], LISTINGS)


def test_stages(spark, rows, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    p = Pipeline(store, failing(), KeepAll(), today="2026-03-31", now="2026-03-31T00:00:00.000Z", top_k=4)
    assert p.crawl(listings(spark), "board") == 5
    assert p.crawl(listings(spark), "board") == 0
    assert p.embed() == {"embedded": 3, "failed": 1, "skipped": 1}
    marks = {r["title"]: r["vectorize_id"] for r in store.read("job_detail").collect()}
    assert marks["Empty"] == "__no_desc__" and marks["Poison"] is None and marks["Data engineer"]
    store.write("user_info", spark.createDataFrame([("a", "A", None, "t1", None, None, None), ("b", "B", None, "", None, None, None), ("c", "C", None, "t3", None, None, None)], USER))
    p.ingest_resumes(spark.createDataFrame([("t1", "spark data"), ("", "soup")], "telegram_id string, resume string"))
    assert p.match() == 4  # the old job is among the most similar and drops out after
    assert p.match() == 0
    assert p.match(exclude_matched=True) == 0
    sent = []

    def deliver(box):
        sent.extend(box.collect())
        return box.select("user_id")

    assert p.notify(deliver) == 1
    assert [r["telegram_id"] for r in sent] == ["t1"] and sent[0]["message"].startswith("You have new matched jobs")
    assert {r["user_id"]: r["notification"] for r in store.read("user_matched_job").collect()} == {"a": 1, "b": 0}
    assert p.notify(deliver) == 0


@pytest.mark.parametrize(("pending", "shown"), [(0, 0), (10, 10), (11, 10)])
def test_outbox(spark, pending, shown):
    jobs = spark.createDataFrame([(f"j{i:02}", f"T{i}", None, None, "l", "s", None, None, "2026-01-01T10:00", None) for i in range(12)], JOB)
    users = spark.createDataFrame([("u", None, None, "t", None, None, None), ("n", None, None, None, None, None, None)], USER)
    matches = spark.createDataFrame([(u, f"j{i:02}", None, 0, str(i), None) for i in range(pending) for u in "un"] + [("u", "orphan", None, 0, "9", None)], MATCH)
    box = outbox(users, matches, jobs).collect()
    assert len(box) == (shown > 0)
    if box:
        titles = [line[8:] for line in box[0]["message"].split("\n") if line.startswith("Title")]
        assert len(titles) == shown and titles[0] == "T9"  # scores in the order of their text
        assert "Date : 2026-01-01\n" in box[0]["message"]


def test_undelivered_stay_pending(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.write("job_detail", spark.createDataFrame([("j", "T", None, None, "l", "s", None, None, None, None)], JOB))
    store.write("user_info", spark.createDataFrame([("u", None, None, "t", None, None, None)], USER))
    store.write("user_matched_job", spark.createDataFrame([("u", "j", None, 0, "9", None)], MATCH))
    p = Pipeline(store, HashedWords(), KeepAll(), "2026-03-31", "now")
    assert p.notify(lambda box: box.limit(0)) == 0
    assert store.read("user_matched_job").first()["notification"] == 0


def test_checkpoint_folder_is_the_sessions(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.rand(1)))
    assert df.collect() == df.collect()


def test_one_firing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.create()
    p = Pipeline(store, HashedWords(), KeepAll(), "2026-03-31", "now")
    p.register_users(spark.createDataFrame([("a", "A", None, "t1", None, None, None)], USER))
    p.register_users(spark.createDataFrame([("b", "B", None, "t1", None, None, None), ("c", "C", None, "t2", None, None, None)], USER))
    assert sorted(r["id"] for r in store.read("user_info").collect()) == ["a", "c"]
    p.set_expectations(spark.createDataFrame([("t1", "remote"), ("t9", "x")], "telegram_id string, job_expectations string"))
    assert {r["id"]: r["job_expectations"] for r in store.read("user_info").collect()} == {"a": "remote", "c": None}
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "t1.txt").write_text("spark data")
    (tmp_path / "up" / "t2.txt").write_text("")
    p.ingest_resumes(read_uploads(spark, str(tmp_path / "up")))
    broken = spark.range(1).select(F.raise_error(F.lit("down")).alias("title"), *[F.lit("").alias(c) for c in ("url", "description", "location", "salary", "update_time")], F.array().cast("array<string>").alias("tags"))
    report = p.run_all({"good": listings(spark), "bad": broken}, lambda box: box.select("user_id"))
    assert report["crawl good"] == 5 and "down" in str(report["crawl bad"]) or "Exception" in str(report["crawl bad"])
    assert report["embed"] == {"embedded": 4, "failed": 0, "skipped": 1} and report["match"] == 3 and report["notify"] == 1
    with pytest.raises(ValueError, match="no stage"):
        p.run_stage("nothing")


def small_store(spark, folder):
    store = SnapshotStore(spark, str(folder))
    store.create()
    return store


def test_an_upload_that_fails_changes_nothing(spark, tmp_path):
    store = small_store(spark, tmp_path)
    store.write("user_info", spark.createDataFrame([("a", "A", None, "t1", "old", None, "a"), ("b", "B", None, "t2", None, None, None)], USER))
    p = Pipeline(store, failing(), KeepAll(), "2026-03-31", "now")
    assert p.ingest_resumes(spark.createDataFrame([("t1", "poison"), ("t2", "good")], "telegram_id string, resume string")) == {"stored": 1, "created": 0, "failed": 1}
    assert {r["id"]: (r["resume"], r["vectorize_id"]) for r in store.read("user_info").collect()} == {"a": ("old", "a"), "b": ("good", "b")}
    assert [r["id"] for r in store.read("resume_vector").collect()] == ["b"]


def test_an_upload_of_an_unknown_user_creates_one(spark, tmp_path):
    store = small_store(spark, tmp_path)
    p = Pipeline(store, HashedWords(), KeepAll(), "2026-03-31", "now")
    upload = spark.createDataFrame([("t7", "spark", "Ada", None), ("t8", "soup", "Bo", "Li"), (None, "x", None, None)], "telegram_id string, resume string, first_name string, last_name string")
    assert p.ingest_resumes(upload) == {"stored": 2, "created": 2, "failed": 0}
    assert p.ingest_resumes(upload) == {"stored": 2, "created": 0, "failed": 0}
    got = {r["telegram_id"]: r for r in store.read("user_info").collect()}
    assert {t: (r["name"], r["resume"]) for t, r in got.items()} == {"t7": ("Ada", "spark"), "t8": ("Li Bo", "soup")}
    assert sorted(r["id"] for r in store.read("resume_vector").collect()) == sorted(r["vectorize_id"] for r in got.values())


def test_new_rows_leave_written_ones_alone(spark, tmp_path):
    store = small_store(spark, tmp_path)
    p = Pipeline(store, HashedWords(), KeepAll(), "2026-03-31", "now")
    p.crawl(listings(spark), "board")
    p.embed()
    parts = store.parts("job_detail")
    more = spark.createDataFrame([("New", "u9", "more", [], "", "", "2026-03-22")], LISTINGS)
    assert p.crawl(more, "board") == 1
    assert set(parts) < set(store.parts("job_detail"))
    assert p.embed()["embedded"] == 1
    assert set(parts) < set(store.parts("job_detail"))


def test_draining(spark, tmp_path):
    store = small_store(spark, tmp_path)
    p = Pipeline(store, failing(), KeepAll(), "2026-03-31", "now")
    p.crawl(listings(spark), "board")
    assert p.drain(2)["embedded"] + p.drain(9)["embedded"] == 3
    assert [r["title"] for r in store.read("job_detail").where("vectorize_id is null").collect()] == ["Poison"]


def test_feeds_fail_alone_or_all_together(spark, tmp_path):
    p = Pipeline(small_store(spark, tmp_path), HashedWords(), KeepAll(), "2026-03-31", "now")
    feed = "<rss><channel><item><title>T</title><link>l</link><description>d</description></item></channel></rss>"
    schema = "url string, body string, error string"
    assert p.crawl_feeds(spark.createDataFrame([("a", feed, None), ("b", None, "down")], schema), "feeds") == {"added": 1, "failed": ["b: down"]}
    with pytest.raises(AllSourcesFailed, match="down"):
        p.crawl_feeds(spark.createDataFrame([("a", None, "down"), ("b", None, "gone")], schema), "feeds")
    assert p.crawl_feeds(spark.createDataFrame([("a", "<rss><channel></channel></rss>", None)], schema), "feeds")["added"] == 0


def test_retries_wait(spark, tmp_path):
    p, waits = Pipeline(small_store(spark, tmp_path), HashedWords(), KeepAll(), "2026-03-31", "now"), []
    p.notify = lambda deliver: 1 / 0
    with pytest.raises(ZeroDivisionError):
        p.run_stage("notify", None, wait=waits.append)
    assert waits == [60.0] * 3


def test_self_test_and_configuration(spark, tmp_path):
    store = small_store(spark, tmp_path)
    p = Pipeline.of(store, "2026-03-31", "now", {"MILLRACE_TOP_K": "2"})
    assert p.top_k == 2
    p.crawl(listings(spark), "board")
    report = self_test(p, width=64)
    assert report["embedded"] == 4 and report["matched"] == report["matches"] > 0
    assert self_test(p, width=64)["matched"] == 0


def test_prompt_states_the_rules(spark):
    users = spark.createDataFrame([("u", None, None, None, "cv {jobs}", None, "u")], USER)
    found = spark.createDataFrame([("u", 2, "j2", "T2", None, None, None, None), ("u", 1, "j1", 'T"1', "l", "d", "p", "s")], "user_id string, rank int, job_id string, title string, link string, job_desc string, location string, salary string")
    text = match_prompts(users, found).first()["prompt"]
    assert "6 or more" in text and "each of them must be met" in text
    assert [e["jobId"] for e in json.loads(KeepAll().complete(text))["matched_jobs"]] == ["j1", "j2"]


def test_replies_past_the_end(spark):
    jobs = spark.createDataFrame([(f"j{i:02}", f"T{i}", None, None, "l", "s", None, None, f"2026-01-{i + 1:02}", None) for i in range(11)], JOB)
    assert all_jobs_reply(jobs).first()["text"].count("Title : ") == 10
    assert list(all_jobs_reply(jobs, 1).first()["keys"]) == ["Current Page 2", "Total Page 2", "Pre Page", "Next Page"]
    assert all_jobs_reply(jobs, 2).first()["text"] == "No jobs available."
    assert tuple(all_jobs_reply(jobs.limit(0)).first()) == ("No jobs available.", ["Current Page 1", "Total Page 1", "Pre Page", "Next Page"])


def alike(spark):
    """Four users, of whom three have equal vectors, and their jobs."""
    users = spark.createDataFrame([(u, None, None, None, f"cv of {u}", f"wish of {u}", u) for u in "abcd"], USER)
    mine = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0])], VECTOR)
    jobs = spark.createDataFrame([(f"j{i}", f"T{i}", "desc", None, "l", "s", None, None, "2026-03-20", f"j{i}") for i in range(6)], JOB)
    theirs = spark.createDataFrame([(f"j{i}", [float(i % 2), float(1 - i % 2)]) for i in range(6)], VECTOR)
    return users, mine, jobs, theirs, "2026-03-01"


def test_a_list_is_written_once_for_users_with_equal_vectors(spark, rows):
    given = alike(spark)
    found, members = shared_candidates(*given, 3)
    assert rows(found, "user_id", "rank", "job_id") == [("a", 1, "j1"), ("a", 2, "j3"), ("a", 3, "j5"), ("c", 1, "j0"), ("c", 2, "j2"), ("c", 3, "j4")]
    assert rows(members) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "a")]
    got = rows(match_prompts(given[0], found, members))
    assert got == rows(match_prompts(given[0], match_candidates(*given, 3)))
    assert [u for u, text in got if f"cv of {u}" in text and f"wish of {u}" in text] == list("abcd")


def test_matching_shares_lists_between_users(spark, tmp_path, monkeypatch):
    users, mine, jobs, theirs, _ = alike(spark)
    store = small_store(spark, tmp_path)
    for name, df in (("user_info", users), ("resume_vector", mine), ("job_detail", jobs), ("job_vector", theirs)):
        store.write(name, df)
    lists = []
    monkeypatch.setattr(pipeline, "match_prompts", lambda u, found, *members: lists.append(found.select("user_id").distinct().count()) or match_prompts(u, found, *members))
    p = Pipeline(store, HashedWords(), KeepAll(), "2026-03-31", "now", top_k=3)
    assert p.match() == 12
    assert lists == [2]  # of four users, three alike
    got = {(r["user_id"], r["job_id"], r["match_score"]) for r in store.read("user_matched_job").collect()}
    assert got == {(u, j, s) for u in "abcd" for j, s in zip(("j0", "j2", "j4") if u == "c" else ("j1", "j3", "j5"), ("10", "9", "8"))}
    assert p.match(exclude_matched=True) == 0
