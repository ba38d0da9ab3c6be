"""The access paths over jobs, users and matches, as DataFrame functions.

Every page has an order that no two rows share; a null sorts last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import blank_to, joined_in_order, message_block, page_count, tags_of
from millrace.operators.store import insert_if_absent

MATCHED = ("user_id", "match_score", "match_reason")


def _page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def as_shown(jobs: DataFrame) -> DataFrame:
    """Jobs with empty texts for nulls; the tags as an array."""
    return jobs.select(*[tags_of(F.col(c)).alias("tags") if c == "job_tags" else F.col(c) if c in ("id", "vectorize_id") else F.coalesce(c, F.lit("")).alias(c) for c in jobs.columns])


def latest_jobs(jobs: DataFrame, page: int = 0, size: int = 10) -> DataFrame:
    return _page(jobs, [F.desc_nulls_last("update_time"), F.asc("id")], page, size)


def unembedded_jobs(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Jobs that aren't embedded; with a limit, the latest of them."""
    open_ = jobs.where("vectorize_id is null")
    return open_ if limit is None else latest_jobs(open_, 0, limit)


def jobs_in(jobs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return jobs.join(ids.select(F.col(key).alias("id")).distinct(), "id", "left_semi")


def eligible_users(users: DataFrame) -> DataFrame:
    """Users with a resume that is embedded."""
    return users.where("resume is not null and resume <> '' and vectorize_id is not null")


def users_page(users: DataFrame, page: int = 0, size: int = 100) -> DataFrame:
    return _page(users, [F.asc("id")], page, size)


def matched_details(matches: DataFrame, jobs: DataFrame, only_new: bool = False) -> DataFrame:
    """Matches with their jobs; those whose job is unknown drop out. The time is
    the job's, the match's is ``matched_at``."""
    m = matches.where("notification = 0") if only_new else matches
    m = m.select("job_id", *MATCHED, F.col("update_time").alias("matched_at"))
    return m.join(jobs.drop("vectorize_id").withColumnRenamed("id", "job_id"), "job_id")


def matched_page(details: DataFrame, user_id: Column | str, page: int = 0, size: int = 10) -> DataFrame:
    return _page(details.where(F.col("user_id") == user_id), [F.desc_nulls_last("matched_at"), F.asc("job_id"), F.asc("match_score"), F.asc("match_reason")], page, size)


def score_order(numeric: bool = False) -> Column:
    """Scores in the order of their text, or of their number."""
    return F.desc_nulls_last(F.col("match_score").try_cast("double") if numeric else F.col("match_score"))


def best_new_per_user(matches: DataFrame, jobs: DataFrame, n: int = 10, numeric: bool = False) -> DataFrame:
    """Each user's ``n`` best un-notified matches with their jobs, ranked."""
    details = matched_details(matches, jobs, only_new=True)
    w = Window.partitionBy("user_id").orderBy(score_order(numeric), F.asc("job_id"), F.desc_nulls_last("matched_at"), F.asc("match_reason"))
    return details.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def unmatched_recent(jobs: DataFrame, matches: DataFrame, user_id: Column | str, cutoff: str, ids: DataFrame | None = None) -> DataFrame:
    """Jobs after a day that a user has no match with, optionally of a list."""
    seen = matches.where(F.col("user_id") == user_id).select(F.col("job_id").alias("id"))
    recent = jobs.where(F.col("update_time") > cutoff)
    return (recent if ids is None else jobs_in(recent, ids)).join(seen, "id", "left_anti")


def recent(jobs: DataFrame, cutoff: str) -> DataFrame:
    """Jobs from a day on; one without a time is not recent."""
    return jobs.where(F.coalesce("update_time", F.lit("")) >= cutoff)


def counts_per_user(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("user_id").agg(F.count("*").alias(name))


def pages_per_user(details: DataFrame, size: int = 10) -> DataFrame:
    return counts_per_user(details, "n").select("user_id", page_count(F.col("n"), size).alias("pages"))


def users_with_resume(users: DataFrame) -> DataFrame:
    """Users who have given a resume, embedded or not."""
    return users.where("resume is not null and resume <> ''")


# The texts around the jobs of a message.
NEW_HEAD, NEW_FOOT = "You have new matched jobs, please check.\n\n", "\nYou can use /jobs to get all available jobs for you."
NO_JOBS, NO_MATCHES = "No jobs available.", "No matched job found, please try again later."
KEYS = ("Current Page ", "Total Page ", "Pre Page", "Next Page")


def outbox(users: DataFrame, matches: DataFrame, jobs: DataFrame, n: int = 10) -> DataFrame:
    """``(user_id, telegram_id, message)``: one message a user with a telegram id
    and un-notified matches whose jobs are known."""
    block = message_block("Title", "Link", "Location", "Salary", "Match Score", "Match Reason")
    texts = best_new_per_user(matches, jobs, n).select("user_id", "rank", block.alias("block"))
    bodies = texts.groupBy("user_id").agg(joined_in_order(F.col("rank"), F.col("block"), "\n").alias("body"))
    to = users.where(blank_to(F.col("telegram_id"), "") != "").select(F.col("id").alias("user_id"), "telegram_id")
    return to.join(bodies, "user_id").select("user_id", "telegram_id", F.concat(F.lit(NEW_HEAD), "body", F.lit(NEW_FOOT)).alias("message"))


def keyboard(page: Column, pages: Column) -> Column:
    """The labels under a page: which it is, of how many, back and on."""
    current, total, back, on = KEYS
    return F.array(F.concat(F.lit(current), (page + 1).cast("string")), F.concat(F.lit(total), pages.cast("string")), F.lit(back), F.lit(on))


def all_jobs_reply(jobs: DataFrame, page: int = 0, size: int = 10) -> DataFrame:
    """One row ``(text, keys)``: a page of the latest jobs as it is shown; past
    the end and without jobs the text says that there are none."""
    block = message_block("Title", "Link", "Location", "Salary")
    ranked = latest_jobs(jobs, page, size).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("update_time"), F.asc("id"))))
    body = ranked.select("rank", block.alias("block")).agg(joined_in_order(F.col("rank"), F.col("block"), "\n").alias("body"))
    pages = jobs.agg(page_count(F.count("*"), size).alias("pages"))
    both = body.unionByName(pages, allowMissingColumns=True).agg(F.max("body").alias("body"), F.max("pages").alias("pages"))
    return both.select(blank_to(F.col("body"), NO_JOBS).alias("text"), keyboard(F.lit(page), F.col("pages")).alias("keys"))


def callback_handler(text: Column) -> Column:
    """Which view a button's payload belongs to; null for none."""
    return F.when(text.startswith("all_jobs_callback_data_"), "all_jobs").when(text.startswith("matched_jobs_callback_data_"), "matched_jobs")


def matched_replies(users: DataFrame, matches: DataFrame, jobs: DataFrame, page: int = 0, size: int = 10) -> DataFrame:
    """``(user_id, text, keys)``: every user's page of matches as it is shown."""
    details = matched_details(matches, jobs)
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("matched_at"), F.asc("job_id"), F.asc("match_score"), F.asc("match_reason"))
    on_page = details.withColumn("rank", F.row_number().over(w)).where(F.col("rank").between(page * size + 1, (page + 1) * size))
    block = message_block("Title", "Link", "Location", "Salary", "Match Score")
    bodies = on_page.select("user_id", "rank", block.alias("block")).groupBy("user_id").agg(joined_in_order(F.col("rank"), F.col("block"), "\n").alias("body"))
    shown = users.select(F.col("id").alias("user_id")).join(bodies, "user_id", "left").join(pages_per_user(details.select("user_id"), size), "user_id", "left")
    return shown.select("user_id", blank_to(F.col("body"), NO_MATCHES).alias("text"), keyboard(F.lit(page), F.coalesce("pages", F.lit(1))).alias("keys"))


def new_matches(matches: DataFrame, batch: DataFrame) -> DataFrame:
    return insert_if_absent(matches, batch, ["user_id", "job_id"], [F.asc_nulls_last("update_time"), F.asc("match_score"), F.asc("match_reason")])
