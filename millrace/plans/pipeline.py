"""The incremental stages over a snapshot store. Each is safe to repeat."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.providers import Config, EmbeddingProvider, RankProvider, embed_texts, job_entry, prompt_of, rank_prompts
from millrace.functions.scalars import embedding_mark, indented_array, month_before, person_name
from millrace.operators.knn import VectorIndex, shared_similar
from millrace.operators.store import SnapshotStore, insert_if_absent, update_by_key, update_where, upsert_vectors
from millrace.plans.access import eligible_users, new_matches, outbox, recent, unembedded_jobs
from millrace.schemas import NO_DESCRIPTION
from millrace.session import cut_lineage
from millrace.sources.http import checked
from millrace.sources.listings import listings_of_feeds, to_jobs, union_with_failures

STAGES = ("crawl", "embed", "match", "notify")


def match_candidates(users: DataFrame, resume_vectors: DataFrame, jobs: DataFrame, job_vectors: DataFrame | VectorIndex, cutoff: str | Column, top_k: int = 30) -> DataFrame:
    """``(user_id, rank, job columns)``: the recent jobs among each user's
    ``top_k`` most similar ones. The similar are found first and filtered after,
    so fewer may remain; users and jobs without a vector drop out."""
    found, members = shared_candidates(users, resume_vectors, jobs, job_vectors, cutoff, top_k)
    return found if members is None else members.join(found.withColumnRenamed("user_id", "like"), "like").drop("like")


def shared_candidates(users: DataFrame, resume_vectors: DataFrame, jobs: DataFrame, job_vectors: DataFrame | VectorIndex, cutoff: str | Column, top_k: int = 30) -> tuple[DataFrame, DataFrame | None]:
    """``match_candidates`` of one user for each vector that users have, and
    ``(user_id, like)``: whose candidates are each user's. None: each has their own."""
    wanted = users.select("id", "vectorize_id").join(resume_vectors.select(F.col("id").alias("vectorize_id"), "embedding"), "vectorize_id").select("id", "embedding")
    hits, members = shared_similar(wanted, job_vectors, top_k) if isinstance(job_vectors, DataFrame) else (job_vectors.query(wanted, top_k), None)
    hits = hits.select(F.col("query_id").alias("user_id"), F.col("id").alias("job_id"), "rank")
    found = hits.join(recent(jobs, cutoff).withColumnRenamed("id", "job_id"), "job_id")
    return found, None if members is None else members.withColumnRenamed("query_id", "user_id")


def match_prompts(users: DataFrame, candidates: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``(user_id, prompt)``: what the ranking model is asked of each user.

    With the ``members`` of ``shared_candidates`` a list is written once for all
    users that share it, and meets them after their resumes, so that no list moves
    more than once.
    """
    lists = candidates.groupBy("user_id").agg(indented_array(F.col("rank"), job_entry()).alias("jobs"))
    own = users.select(F.col("id").alias("user_id"), "resume", "job_expectations")
    asked = lists.join(own, "user_id") if members is None else own.join(members, "user_id").join(lists.withColumnRenamed("user_id", "like"), "like")
    return asked.select("user_id", prompt_of(F.col("resume"), F.col("job_expectations"), F.col("jobs")).alias("prompt"))


def match_rows(ranked: DataFrame, now: str, threshold: float | None = None) -> DataFrame:
    """Rows of matches from ranked entries; those of a failed completion are left out."""
    rows = ranked.where("ok").select("user_id", F.explode("entries").alias("e")).select(
        "user_id", F.col("e.jobId").alias("job_id"), F.lit(now).alias("update_time"), F.lit(0).alias("notification"), F.col("e.matchScore").alias("match_score"), F.col("e.reason").alias("match_reason")
    )
    return rows if threshold is None else rows.where(F.col("match_score").try_cast("double") >= threshold)


class Pipeline:
    """``today`` and ``now`` are given, never read from a clock."""

    def __init__(self, store: SnapshotStore, embedder: EmbeddingProvider, ranker: RankProvider, today: str, now: str, top_k: int | None = None, config: Config = Config()):
        self.store, self.embedder, self.ranker, self.today, self.now, self.top_k = store, embedder, ranker, today, now, config.top_k if top_k is None else top_k

    @staticmethod
    def of(store: SnapshotStore, today: str, now: str, environment: Mapping[str, str]) -> Pipeline:
        config = Config.of(environment)
        return Pipeline(store, *config.models(), today, now, config=config)

    def crawl(self, listings: DataFrame, source: str, order: Column | None = None) -> int:
        """Appends listings whose link is new; returns how many."""
        jobs = self.store.read("job_detail")
        new = cut_lineage(insert_if_absent(jobs, to_jobs(listings, source, self.today), ["link"], [order if order is not None else F.asc("title"), F.asc("job_desc")]))
        added = new.count()
        if added:
            self.store.append("job_detail", new)
        return added

    def crawl_feeds(self, fetched: DataFrame, source: str) -> dict[str, object]:
        """Crawls fetched feeds ``(url, body, error)``. One that failed leaves the
        others; it is an error only if some failed and nothing came."""
        came, failed = union_with_failures(fetched)
        failures = [f"{r['url']}: {r['error']}" for r in failed.collect()]  # one row an address
        listings = cut_lineage(listings_of_feeds(came, "body"))
        checked(failures, listings.count())
        return {"added": self.crawl(listings, source), "failed": failures}

    def embed(self, limit: int | None = None) -> dict[str, int]:
        """Embeds the jobs that aren't (with a limit, the latest of them); those
        that fail stay for the next run. Vectors are written before marks."""
        open_ = unembedded_jobs(self.store.read("job_detail"), limit)
        marks = cut_lineage(open_.select("id", "job_desc", embedding_mark(F.col("id"), F.col("job_desc")).alias("vectorize_id")))
        done = cut_lineage(embed_texts(marks.where(F.col("vectorize_id") != NO_DESCRIPTION), "id", "job_desc", self.embedder))
        vectors = done.where("error is null").select("id", "embedding")
        counts = done.agg(F.count_if(F.col("error").isNull()).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("failed")).first().asDict()
        if counts["embedded"]:
            self.store.replace("job_vector", upsert_vectors(vectors.limit(0), vectors, [F.asc("id")]), ["id"])
        ready = marks.where(F.col("vectorize_id") == NO_DESCRIPTION).unionByName(marks.join(vectors.select("id"), "id", "left_semi")).select("id", "vectorize_id")
        self.store.update("job_detail", ready, "id")
        return counts | {"skipped": marks.where(F.col("vectorize_id") == NO_DESCRIPTION).count()}

    def drain(self, limit: int = 5) -> dict[str, int]:
        """Embeds ``limit`` jobs at a time until none is left or none gets further."""
        total = {"embedded": 0, "skipped": 0, "runs": 0}
        while True:
            done = self.embed(limit)
            total = {"embedded": total["embedded"] + done["embedded"], "skipped": total["skipped"] + done["skipped"], "runs": total["runs"] + 1}
            if not done["embedded"] + done["skipped"] or not unembedded_jobs(self.store.read("job_detail")).limit(1).count():
                return total

    def ingest_resumes(self, uploads: DataFrame) -> dict[str, int]:
        """Uploads ``(telegram_id, resume)``, one a user, also with ``first_name``
        and ``last_name``. An unknown user is created. An upload whose embedding
        fails changes nothing: the user keeps resume and vector.

        Users that share a telegram_id share the vector of the least id.
        """
        users = self.store.read("user_info")
        names = [F.col(c) if c in uploads.columns else F.lit(None).cast("string").alias(c) for c in ("first_name", "last_name")]
        given = uploads.select("telegram_id", "resume", *names)
        done = cut_lineage(embed_texts(given.where("telegram_id is not null"), "telegram_id", "resume", self.embedder))
        known = users.where("telegram_id is not null").groupBy("telegram_id").agg(F.min("id").alias("known_id"))
        ok = given.join(done.where("error is null").select(F.col("id").alias("telegram_id"), "embedding"), "telegram_id").join(known, "telegram_id", "left")
        # The id of a new user comes from the telegram_id, so a repeated run makes no second one.
        ok = cut_lineage(ok.withColumn("id", F.coalesce("known_id", F.sha2(F.concat(F.lit("user:"), "telegram_id"), 256))))
        self.store.replace("resume_vector", ok.select("id", "embedding"), ["id"])
        none = F.lit(None).cast("string")
        new = ok.where("known_id is null").select("id", person_name(F.col("first_name"), F.col("last_name")).alias("name"), none.alias("email"), "telegram_id", "resume", none.alias("job_expectations"), F.col("id").alias("vectorize_id"))
        counts = {"stored": ok.count(), "created": new.count(), "failed": done.where("error is not null").count()}
        self.store.update("user_info", ok.where("known_id is not null").select("telegram_id", "resume", F.col("id").alias("vectorize_id")), "telegram_id")
        if counts["created"]:
            self.store.append("user_info", new)
        return counts

    def match(self, exclude_matched: bool = False, threshold: float | None = None) -> int:
        """Ranks the recent jobs among each eligible user's most similar ones."""
        users, jobs, matches = eligible_users(self.store.read("user_info")), self.store.read("job_detail"), self.store.read("user_matched_job")
        cutoff = month_before(F.lit(self.today).cast("date")).cast("string")
        given = users, self.store.read("resume_vector"), jobs, self.store.read("job_vector"), cutoff, self.top_k
        if exclude_matched:
            prompts = match_prompts(users, match_candidates(*given).join(matches.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti"))
        else:
            prompts = match_prompts(users, *shared_candidates(*given))
        ranked = rank_prompts(prompts, "user_id", "prompt", self.ranker)
        new = cut_lineage(new_matches(matches, cut_lineage(match_rows(ranked, self.now, threshold))))
        added = new.count()
        if added:
            self.store.append("user_matched_job", new)
        return added

    def register_users(self, users: DataFrame) -> None:
        """Appends users whose telegram_id is new and changes no other."""
        known = self.store.read("user_info")
        self.store.append("user_info", insert_if_absent(known, users, ["telegram_id"], [F.asc("id")]).select(*known.columns))

    def set_expectations(self, said: DataFrame) -> None:
        """Expectations ``(telegram_id, job_expectations)`` of known users."""
        self.store.update("user_info", said.select("telegram_id", "job_expectations"), "telegram_id")

    def run_stage(self, name: str, *args, retries: int = 3, delay: float = 60.0, wait: Callable[[float], None] = time.sleep, **kwargs):
        """A stage by its name, repeated after ``delay`` seconds if it fails; all
        stages bear it."""
        if name not in STAGES:
            raise ValueError(f"no stage {name!r}; there are {', '.join(STAGES)}")
        for left in range(retries, -1, -1):
            try:
                return getattr(self, name)(*args, **kwargs)
            except Exception:
                if not left:
                    raise
                wait(delay)

    def run_all(self, fetched: dict[str, DataFrame], deliver: Callable[[DataFrame], DataFrame]) -> dict[str, object]:
        """One firing: every source is crawled for itself, so one that fails
        leaves the others; then embed, match and notify."""
        report: dict[str, object] = {}
        for source, listings in fetched.items():
            try:
                report[f"crawl {source}"] = self.run_stage("crawl", listings, source, retries=0)
            except Exception as e:
                report[f"crawl {source}"] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
        report["embed"] = self.run_stage("embed")
        report["match"] = self.run_stage("match")
        report["notify"] = self.run_stage("notify", deliver)
        return report

    def notify(self, deliver: Callable[[DataFrame], DataFrame]) -> int:
        """Messages to ``deliver``, which returns the ``user_id`` it reached; all
        un-notified matches of those are marked, of the others none."""
        users, jobs, matches = self.store.read("user_info"), self.store.read("job_detail"), self.store.read("user_matched_job")
        reached = cut_lineage(deliver(outbox(users, matches, jobs)).select("user_id").distinct())
        self.store.rewrite("user_matched_job", reached.withColumn("notification", F.lit(0)), ["user_id", "notification"], lambda part: mark_delivered(part, reached))
        return reached.count()


def mark_delivered(matches: DataFrame, reached: DataFrame) -> DataFrame:
    """Matches with all un-notified ones of the users reached marked."""
    marks = matches.join(reached.select("user_id").distinct().withColumn("_r", F.lit(True)), "user_id", "left")
    return update_where(marks, F.col("_r") & (F.col("notification") == 0), notification=F.lit(1)).select(*matches.columns)


def self_test(pipeline: Pipeline, width: int = 1024) -> dict[str, object]:
    """A run on made-up rows in the pipeline's store: embedding marks are reset, a
    user is put in with a vector of ``width`` numbers, all 0.01 but the first two,
    and is matched. For empty stores and trials: it changes the store."""
    spark, store = pipeline.store.spark, pipeline.store
    jobs = store.read("job_detail")
    store.write("job_detail", cut_lineage(update_where(jobs, F.lit(True), vectorize_id=F.lit(None).cast("string"))))
    embedded = pipeline.embed(100)
    store.replace("user_info", spark.sql("SELECT 'self-test' AS id, 'Self Test' AS name, CAST(NULL AS string) AS email, 'self-test' AS telegram_id, 'trial' AS resume, CAST(NULL AS string) AS job_expectations, 'self-test' AS vectorize_id"), ["id"])
    store.replace("resume_vector", spark.range(1).select(F.lit("self-test").alias("id"), trial_vector(width).alias("embedding")), ["id"])
    matched = pipeline.match()
    return {"embedded": embedded["embedded"], "matched": matched, "matches": store.read("user_matched_job").where("user_id = 'self-test'").count()}


def trial_vector(width: int) -> Column:
    """0.01 everywhere but 0.5 and -0.3 at the first two places."""
    return F.concat(F.array(F.lit(0.5), F.lit(-0.3)), F.array_repeat(F.lit(0.01), width - 2)).cast("array<float>")
