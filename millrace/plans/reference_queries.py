"""Queries over the domain tables: the access paths, mutations and functions,
each over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import store as K
from millrace.operators.knn import top_similar
from millrace.plans import access as A
from millrace.streaming.sessions import session_actions

TODAY = "2026-03-31"
CUTOFF = "2026-03-03"
_J = "id, title, job_desc, job_tags, link, source, location, salary, update_time, vectorize_id"
_U = "id, name, email, telegram_id, resume, job_expectations, vectorize_id"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _first_user(matches: DataFrame) -> DataFrame:
    return matches.agg(F.min("user_id").alias("u"))


def _of_first_user(df: DataFrame, matches: DataFrame) -> DataFrame:
    return df.join(F.broadcast(_first_user(matches)), F.col("user_id") == F.col("u"), "left_semi")


# Scans, counts and pages.


@_query("q03_job_by_id", f"SELECT {_J} FROM job_detail WHERE id = (SELECT min(id) FROM job_detail)")
def _(t):
    jobs = t("job_detail")
    return jobs.join(jobs.agg(F.min("id").alias("id")), "id", "left_semi")


@_query("q04_job_count", "SELECT count(*) AS n FROM job_detail")
def _(t):
    return t("job_detail").agg(F.count("*").alias("n"))


@_query("q05_latest_jobs", f"SELECT {_J} FROM job_detail ORDER BY update_time DESC NULLS LAST, id LIMIT 10")
def _(t):
    return A.latest_jobs(t("job_detail"))


@_query("q05_latest_jobs_page_2", f"SELECT {_J} FROM job_detail ORDER BY update_time DESC NULLS LAST, id LIMIT 10 OFFSET 20")
def _(t):
    return A.latest_jobs(t("job_detail"), 2)


@_query("q06_unembedded_count", "SELECT count(*) AS n FROM job_detail WHERE vectorize_id IS NULL")
def _(t):
    return A.unembedded_jobs(t("job_detail")).agg(F.count("*").alias("n"))


@_query("q07_unembedded_jobs", f"SELECT {_J} FROM job_detail WHERE vectorize_id IS NULL")
def _(t):
    return A.unembedded_jobs(t("job_detail"))


@_query("q08_embedding_marks", "SELECT id, CASE WHEN vectorize_id IS NOT NULL THEN vectorize_id WHEN coalesce(job_desc, '') = '' THEN '__no_desc__' ELSE id END AS vectorize_id FROM job_detail")
def _(t):
    jobs = t("job_detail")
    marks = A.unembedded_jobs(jobs).select("id", S.embedding_mark(F.col("id"), F.col("job_desc")).alias("vectorize_id"))
    return K.update_by_key(jobs, marks, "id").select("id", "vectorize_id")


@_query("q09_matched_jobs_in", f"SELECT {_J} FROM job_detail WHERE id IN (SELECT job_id FROM user_matched_job)")
def _(t):
    return A.jobs_in(t("job_detail"), t("user_matched_job"), "job_id")


@_query("q10_chats_known", "SELECT c.chat_id, c.chat_id::VARCHAR IN (SELECT telegram_id FROM user_info WHERE telegram_id IS NOT NULL) AS known FROM (SELECT DISTINCT chat_id FROM session_event WHERE chat_id IS NOT NULL) c")
def _(t):
    chats = t("session_event").select("chat_id").distinct().where("chat_id is not null").withColumn("telegram_id", F.col("chat_id").cast("string"))
    return K.known_keys(chats, t("user_info"), ["telegram_id"]).select("chat_id", "known")


@_query("q13_user_by_telegram", f"SELECT {_U} FROM user_info WHERE telegram_id = (SELECT min(telegram_id) FROM user_info WHERE telegram_id <> '')")
def _(t):
    users = t("user_info")
    return users.join(users.where("telegram_id <> ''").agg(F.min("telegram_id").alias("telegram_id")), "telegram_id", "left_semi")


@_query("q17_user_count", "SELECT count(*) AS n FROM user_info")
def _(t):
    return t("user_info").agg(F.count("*").alias("n"))


@_query("q18_users_page", f"SELECT {_U} FROM user_info ORDER BY id LIMIT 100 OFFSET 100")
def _(t):
    return A.users_page(t("user_info"), 1)


@_query("q19_eligible_users", f"SELECT {_U} FROM user_info WHERE resume IS NOT NULL AND resume <> '' AND vectorize_id IS NOT NULL")
def _(t):
    return A.eligible_users(t("user_info"))


@_query("q20_eligible_count", "SELECT count(*) AS n FROM user_info WHERE resume IS NOT NULL AND resume <> '' AND vectorize_id IS NOT NULL")
def _(t):
    return A.eligible_users(t("user_info")).agg(F.count("*").alias("n"))


@_query("q21_orphan_matches", "SELECT m.user_id, m.job_id FROM user_matched_job m WHERE NOT EXISTS (SELECT 1 FROM job_detail j WHERE j.id = m.job_id)")
def _(t):
    return t("user_matched_job").join(t("job_detail").select(F.col("id").alias("job_id")), "job_id", "left_anti").select("user_id", "job_id")


_MATCHED = "m.user_id, m.match_score, m.match_reason, m.update_time AS matched_at, j.id AS job_id, j.title, j.job_desc, j.job_tags, j.link, j.source, j.location, j.salary, j.update_time"


@_query("q23_matched_details", f"SELECT {_MATCHED} FROM user_matched_job m JOIN job_detail j ON m.job_id = j.id WHERE m.user_id = (SELECT min(user_id) FROM user_matched_job)")
def _(t):
    matches = t("user_matched_job")
    return A.matched_details(_of_first_user(matches, matches), t("job_detail"))


@_query(
    "q23_matched_page",
    "SELECT m.job_id, m.match_score, m.update_time AS matched_at FROM user_matched_job m JOIN job_detail j ON m.job_id = j.id WHERE m.user_id = (SELECT min(user_id) FROM user_matched_job) "
    "ORDER BY m.update_time DESC NULLS LAST, m.job_id, m.match_score NULLS FIRST, m.match_reason NULLS FIRST LIMIT 10",
)
def _(t):
    matches = t("user_matched_job")
    details = A.matched_details(_of_first_user(matches, matches), t("job_detail"))
    return A.matched_page(details, F.col("user_id")).select("job_id", "match_score", "matched_at")


@_query("q24_matched_counts", "SELECT m.user_id, count(*) AS n FROM user_matched_job m JOIN job_detail j ON m.job_id = j.id GROUP BY m.user_id")
def _(t):
    return A.counts_per_user(A.matched_details(t("user_matched_job"), t("job_detail")).select("user_id"), "n")


@_query("q24_pages", "SELECT m.user_id, greatest(ceil(count(*) / 10.0), 1)::BIGINT AS pages FROM user_matched_job m JOIN job_detail j ON m.job_id = j.id GROUP BY m.user_id")
def _(t):
    return A.pages_per_user(A.matched_details(t("user_matched_job"), t("job_detail")).select("user_id"))


@_query(
    "q25_best_new_matches",
    "SELECT user_id, job_id, match_score, rank FROM (SELECT m.user_id, m.job_id, m.match_score, row_number() OVER (PARTITION BY m.user_id "
    "ORDER BY m.match_score DESC NULLS LAST, m.job_id, m.update_time DESC NULLS LAST, m.match_reason NULLS FIRST) AS rank "
    "FROM user_matched_job m JOIN job_detail j ON m.job_id = j.id WHERE m.notification = 0) WHERE rank <= 10",
)
def _(t):
    return A.best_new_per_user(t("user_matched_job"), t("job_detail")).select("user_id", "job_id", "match_score", "rank")


@_query("q26_new_match_counts", "SELECT user_id, count(*) AS n FROM user_matched_job WHERE notification = 0 GROUP BY user_id")
def _(t):
    return A.counts_per_user(t("user_matched_job").where("notification = 0"), "n")


@_query("q27_mark_notified", "SELECT user_id, job_id, update_time, CASE WHEN user_id = (SELECT min(user_id) FROM user_matched_job) THEN 1 ELSE notification END AS notification FROM user_matched_job")
def _(t):
    matches = t("user_matched_job")
    marked = matches.join(F.broadcast(_first_user(matches)), F.col("user_id") == F.col("u"), "left")
    return K.update_where(marked, F.col("u").isNotNull() & (F.col("notification") == 0), notification=F.lit(1)).select("user_id", "job_id", "update_time", "notification")


@_query("q28_unmatched_recent", f"SELECT {_J} FROM job_detail j WHERE update_time > '{CUTOFF}' AND NOT EXISTS (SELECT 1 FROM user_matched_job m WHERE m.job_id = j.id AND m.user_id = (SELECT min(user_id) FROM user_matched_job))")
def _(t):
    matches = t("user_matched_job")
    return A.unmatched_recent(t("job_detail"), _of_first_user(matches, matches), F.col("user_id"), CUTOFF)


@_query("q29_reset_embedding", "SELECT id, NULL::VARCHAR AS vectorize_id FROM job_detail")
def _(t):
    return K.update_where(t("job_detail"), F.lit(True), vectorize_id=F.lit(None).cast("string")).select("id", "vectorize_id")


@_query(
    "q30_insert_or_replace",
    "SELECT id, name, email, telegram_id FROM user_info WHERE coalesce(email, '') <> '' UNION ALL SELECT id, name, NULL AS email, 'new' AS telegram_id FROM user_info WHERE coalesce(email, '') = ''",
)
def _(t):
    users = t("user_info")
    batch = users.where(F.coalesce("email", F.lit("")) == "").select("id", "name", F.lit("new").alias("telegram_id"))
    return K.insert_or_replace(users, batch, ["id"]).select("id", "name", "email", "telegram_id")


@_query("q31_match_projection", "SELECT m.user_id, j.title, j.source, m.match_score, m.match_reason FROM user_matched_job m JOIN job_detail j ON m.job_id = j.id")
def _(t):
    return A.matched_details(t("user_matched_job"), t("job_detail")).select("user_id", "title", "source", "match_score", "match_reason")


# Mutations.


@_query(
    "k01_insert_jobs",
    "WITH batch AS (SELECT id, link, row_number() OVER (PARTITION BY link ORDER BY id) AS k FROM job_detail WHERE source <> 'outdesk') "
    "SELECT id, link FROM batch WHERE link IS NULL OR (k = 1 AND link NOT IN (SELECT link FROM job_detail WHERE source = 'outdesk' AND link IS NOT NULL))",
)
def _(t):
    jobs = t("job_detail").select("id", "link", "source")
    return K.insert_if_absent(jobs.where("source = 'outdesk'"), jobs.where("source <> 'outdesk'"), ["link"], [F.asc("id")]).select("id", "link")


@_query(
    "k02_upsert_users",
    "WITH chats AS (SELECT DISTINCT chat_id::VARCHAR AS telegram_id FROM session_event WHERE chat_id IS NOT NULL) "
    "SELECT u.id, CASE WHEN c.telegram_id IS NOT NULL THEN 'chat' ELSE u.name END AS name, CASE WHEN c.telegram_id IS NOT NULL THEN NULL ELSE u.resume END AS resume, u.telegram_id FROM user_info u LEFT JOIN chats c ON u.telegram_id = c.telegram_id "
    "UNION ALL SELECT 'new-' || telegram_id, 'chat', NULL, telegram_id FROM chats c WHERE NOT EXISTS (SELECT 1 FROM user_info u WHERE u.telegram_id = c.telegram_id)",
)
def _(t):
    users = t("user_info")
    none = F.lit(None).cast("string")
    chats = t("session_event").where("chat_id is not null").select(F.col("chat_id").cast("string").alias("telegram_id")).distinct()
    batch = chats.select(F.concat(F.lit("new-"), "telegram_id").alias("id"), F.lit("chat").alias("name"), none.alias("email"), "telegram_id", none.alias("resume"), none.alias("job_expectations"), none.alias("vectorize_id"))
    return K.upsert_users(users, batch).select("id", "name", "resume", "telegram_id")


@_query(
    "k03_insert_matches",
    "SELECT user_id, job_id, update_time FROM (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY update_time NULLS LAST, match_score NULLS FIRST, match_reason NULLS FIRST) AS k FROM user_matched_job WHERE notification = 0) b "
    "WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM user_matched_job m WHERE m.notification <> 0 AND m.user_id = b.user_id AND m.job_id = b.job_id)",
)
def _(t):
    matches = t("user_matched_job")
    return A.new_matches(matches.where("notification <> 0"), matches.where("notification = 0")).select("user_id", "job_id", "update_time")


@_query("k07_upsert_vectors", "SELECT vec_id::VARCHAR AS id, round(CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE embedding[1] END::DOUBLE, 6) AS x FROM embeddings")
def _(t):
    vectors = t("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    batch = vectors.where(F.col("id").cast("bigint") % 2 == 0).select("id", F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"))
    return K.upsert_vectors(vectors, batch, [F.asc("id")], width=64).select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@_query("k08_delete_vectors", "SELECT vec_id FROM embeddings WHERE label <> 0")
def _(t):
    vectors = t("embeddings").select("vec_id", "label")
    return K.delete_by_key(vectors, vectors.where("label = 0"), "vec_id").select("vec_id")


# Functions.


@_query("c01_trimmed_titles", "SELECT id, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title FROM job_detail")
def _(t):
    return t("job_detail").select("id", S.trim(F.col("title")).alias("title"))


@_query("c03_title_words", "SELECT id, len(string_split(title, ' '))::BIGINT AS words FROM job_detail WHERE title IS NOT NULL")
def _(t):
    return t("job_detail").where("title is not null").select("id", F.size(S.split_keeping(F.col("title"))).cast("bigint").alias("words"))


@_query("c04_match_days", "SELECT user_id, job_id, split_part(coalesce(update_time, ''), 'T', 1) AS day FROM user_matched_job")
def _(t):
    return t("user_matched_job").select("user_id", "job_id", S.day_part(F.col("update_time")).alias("day"))


@_query("c08_callback_pages", "SELECT chat_id, ts, try_cast(substr(text, length('matched_jobs_callback_data_') + 1) AS BIGINT) AS page FROM session_event WHERE kind = 'callback' AND starts_with(text, 'matched_jobs_callback_data_')")
def _(t):
    prefix = "matched_jobs_callback_data_"
    rows = t("session_event").where((F.col("kind") == "callback") & F.col("text").startswith(prefix))
    return rows.select("chat_id", "ts", F.expr(f"substring(text, {len(prefix) + 1})").try_cast("bigint").alias("page"))


@_query("c10_defaults", "SELECT id, coalesce(location, '') AS location, CASE WHEN salary IS NULL OR salary = '' THEN 'not stated' ELSE salary END AS salary FROM job_detail")
def _(t):
    return t("job_detail").select("id", F.coalesce("location", F.lit("")).alias("location"), S.blank_to(F.col("salary"), "not stated").alias("salary"))


def day_sql() -> str:
    """The UTC day of ``update_time`` in SQL; of times in other forms, ``TODAY``."""
    t = "trim(update_time, ' \n\r\t')"
    iso = f"regexp_replace(regexp_replace(replace({t}, 'Z', '+00:00'), 'T(\\d\\d:\\d\\d)($|[+-])', 'T\\1:00\\2'), '([+-]\\d\\d):?(\\d\\d)$', '\\1:\\2')"
    mail = f"regexp_replace(regexp_replace({t}, '^[A-Za-z]{{3}}, *', ''), ' (GMT|UT|UTC|Z)$', ' +0000')"
    return (
        f"coalesce(strftime(CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d\\d-\\d\\d') THEN try_cast({t} || ' 00:00:00+00' AS TIMESTAMPTZ) "
        f"WHEN regexp_full_match({t}, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d(:\\d\\d(\\.\\d{{1,9}})?)?(Z|[+-]\\d\\d:?\\d\\d)?') THEN try_cast({iso} AS TIMESTAMPTZ) "
        f"WHEN regexp_full_match({t}, '([A-Za-z]{{3}}, *)?\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}} \\d\\d:\\d\\d(:\\d\\d)? *(GMT|UT|UTC|Z|[+-]\\d{{4}})') "
        f"THEN try_strptime({mail}, ['%d %b %Y %H:%M:%S %z', '%d %b %Y %H:%M %z']) END AT TIME ZONE 'UTC', '%Y-%m-%d'), '{TODAY}')"
    )


@_query("c11_job_days", f"SELECT id, {day_sql()} AS day FROM job_detail")
def _(t):
    return t("job_detail").select("id", S.utc_day(F.col("update_time"), TODAY).alias("day"))


@_query("c12_cutoffs", "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day, (date_trunc('month', o_orderdate::DATE - INTERVAL (day(o_orderdate) - 1) DAY - INTERVAL 1 MONTH) + INTERVAL (day(o_orderdate) - 1) DAY)::DATE::VARCHAR AS cutoff FROM orders")
def _(t):
    days = t("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.select(F.col("d").cast("string").alias("day"), S.month_before(F.col("d")).cast("string").alias("cutoff"))


@_query("c15_job_tags", "SELECT id, len(CASE WHEN json_valid(job_tags) AND json_type(job_tags) = 'ARRAY' THEN from_json(job_tags, '[\"VARCHAR\"]') ELSE [] END)::BIGINT AS tags FROM job_detail")
def _(t):
    return t("job_detail").select("id", F.size(S.tags_of(F.col("job_tags"))).cast("bigint").alias("tags"))


@_query(
    "c24_notifications",
    "WITH b AS (SELECT user_id, rank, 'Title : ' || coalesce(title, '') || chr(10) || 'Link : ' || coalesce(link, '') || chr(10) || 'Location : ' || coalesce(location, '') || chr(10) || 'Salary : ' || coalesce(salary, '') || chr(10) "
    "|| 'Match Score : ' || coalesce(match_score, '') || chr(10) || 'Match Reason : ' || coalesce(match_reason, '') || chr(10) || 'Date : ' || split_part(coalesce(update_time, ''), 'T', 1) || chr(10) AS t FROM ("
    "SELECT j.title, j.link, j.location, j.salary, j.update_time, m.user_id, m.match_score, m.match_reason, row_number() OVER (PARTITION BY m.user_id ORDER BY m.match_score DESC NULLS LAST, m.job_id, m.update_time DESC NULLS LAST, m.match_reason NULLS FIRST) AS rank "
    "FROM user_matched_job m JOIN job_detail j ON m.job_id = j.id WHERE m.notification = 0) WHERE rank <= 10), d AS (SELECT user_id, string_agg(t, chr(10) ORDER BY rank) AS body FROM b GROUP BY user_id) "
    "SELECT u.id AS user_id, u.telegram_id, 'You have new matched jobs, please check.' || chr(10) || chr(10) || body || chr(10) || 'You can use /jobs to get all available jobs for you.' AS message FROM user_info u JOIN d ON u.id = d.user_id WHERE coalesce(u.telegram_id, '') <> ''",
)
def _(t):
    return A.outbox(t("user_info"), t("user_matched_job"), t("job_detail"))


@_query("t07_session_actions", """
WITH e AS (SELECT chat_id, ts, kind, text, CASE WHEN kind = 'document' THEN 'document' WHEN kind = 'command' AND text IN ('/upload_resume', '/expectation') THEN text END AS w,
    row_number() OVER (PARTITION BY chat_id ORDER BY ts, kind NULLS FIRST, text NULLS FIRST) AS n FROM session_event WHERE chat_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, last_value(w IGNORE NULLS) OVER p AS lw, last_value(CASE WHEN w IS NOT NULL THEN epoch_ms(ts) END IGNORE NULLS) OVER p AS lms, count(w) OVER (PARTITION BY chat_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn
    FROM e WINDOW p AS (PARTITION BY chat_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, coalesce(epoch_ms(ts) - lms < 600000, false) AS live, CASE WHEN kind = 'text' AND lw = '/expectation' AND epoch_ms(ts) - lms < 600000 THEN 1 ELSE 0 END AS uses FROM g),
i AS (SELECT *, coalesce(sum(uses) OVER (PARTITION BY chat_id, turn ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h)
SELECT chat_id, ts, kind, text, CASE WHEN kind = 'document' THEN 'store_resume' WHEN kind = 'command' THEN text WHEN kind = 'callback' THEN 'turn_page'
    WHEN kind = 'text' AND lw = '/upload_resume' AND live THEN 'ask_for_file' WHEN uses = 1 AND used = 0 THEN 'store_expectations' ELSE 'ignored' END AS action FROM i
""")  # fmt: skip
def _(t):
    return session_actions(t("session_event"))


# Nearest vectors. The stated queries are all vectors whose id is divisible by 50.

_KNN = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 30
"""


def _knn(t) -> DataFrame:
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return top_similar(vectors.where("id % 50 = 0"), vectors).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@_query("j10_nearest_vectors", _KNN)
def _(t):
    return _knn(t)


@_query("j10_match_candidates", _KNN.replace("SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 30", "SELECT r.query_id, d.doc_id, r.rank FROM r JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 30 AND coalesce(d.text, '') <> ''"))
def _(t):
    hits = _knn(t).select("query_id", F.col("id").alias("doc_id"), "rank")
    return hits.join(t("documents").where("text <> ''").select("doc_id"), "doc_id").select("query_id", "doc_id", "rank")
