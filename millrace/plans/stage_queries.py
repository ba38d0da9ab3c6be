"""Queries over the sources, stages, models and streams, each over whole tables,
with their SQL. Pages, feeds and completions are written from the domain tables,
so that SQL knows what must be read from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions.providers import PROMPT, HashedWords, KeepAll, embed_texts, rank_prompts
from millrace.operators.knn import ExactIndex, ListIndex, top_similar
from millrace.plans import access as A
from millrace.plans.pipeline import mark_delivered, match_candidates, match_prompts, match_rows, shared_candidates
from millrace.plans.reference_queries import CUTOFF, TODAY, day_sql
from millrace.plans.reference_queries import ORACLE as OTHERS
from millrace.schemas import RANKED, SESSION_EVENT, TABLES
from millrace.session import shared_folder
from millrace.sources.listings import listings_of_feeds, listings_of_pages, to_jobs, union_with_failures, uploaded_texts
from millrace.streaming.queue import events_from, messages_of_firing
from millrace.streaming.sessions import session_actions, session_stream

NOW = "2026-03-31T00:00:00.000Z"
ACTIONS_SQL = OTHERS["t07_session_actions"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Pages and feeds. White space at the ends is trimmed by all of them.

_TRIMMED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_TAGS = "CASE WHEN json_valid(job_tags) AND json_type(job_tags) = 'ARRAY' THEN from_json(job_tags, '[\"VARCHAR\"]') ELSE [] END"


def _escaped(text: Column | str) -> Column:
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _page_of(jobs: DataFrame) -> DataFrame:
    """A page of one posting: its header row and its detail row."""
    tags = F.array_join(F.transform(S.tags_of(F.col("job_tags")), lambda t: F.concat(F.lit("<h3>"), _escaped(t), F.lit("</h3>"))), "")
    parts = [
        F.lit('<tr class="job job-'), "id", F.lit('" data-url="'), _escaped("link"), F.lit('"><td class="company company_and_position"><h2>'), _escaped("title"), F.lit('</h2><div class="location">'), _escaped("location"),
        F.lit('</div><div class="location">'), _escaped("salary"), F.lit('</div></td><td class="tags">'), tags, F.lit('</td><td><time datetime="'), _escaped("update_time"), F.lit('">a day</time></td></tr><tr class="expand" data-id="'), "id",
        F.lit('"><td><div class="html">'), _escaped("job_desc"), F.lit("</div></td></tr>"),
    ]
    return jobs.select(F.concat(*[F.col(p) if isinstance(p, str) else p for p in parts]).alias("html"))


@_query(
    "s02_listings_of_pages",
    f"SELECT {_TRIMMED.format('coalesce(title, $$$$)')} AS title, 'https://remoteok.com' || coalesce(link, '') AS url, {_TRIMMED.format('coalesce(job_desc, $$$$)')} AS description, {_TRIMMED.format('coalesce(location, $$$$)')} AS location, "
    f"{_TRIMMED.format('coalesce(salary, $$$$)')} AS salary, coalesce(update_time, '') AS update_time, coalesce(array_to_string(list_transform({_TAGS}, lambda x: {_TRIMMED.format('x')}), '|'), '') AS tags FROM job_detail",
)
def _(t):
    found = listings_of_pages(_page_of(t("job_detail")))
    return found.withColumn("tags", F.array_join("tags", "|"))


def _feed_of(jobs: DataFrame) -> DataFrame:
    """A feed of one posting; its description is markup, written as text."""
    item = lambda tag, value: F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    markup = F.concat(F.lit("<p>"), _escaped("job_desc"), F.lit("</p>"))
    parts = [item("title", _escaped("title")), item("link", _escaped("link")), item("region", _escaped("location")), item("category", _escaped("source")), item("category", F.lit("second")), item("description", _escaped(markup)), item("pubDate", _escaped("update_time"))]
    return jobs.select(F.concat(F.lit("<rss><channel><item>"), *parts, F.lit("</item></channel></rss>")).alias("xml"))


@_query(
    "s04_listings_of_feeds",
    f"SELECT {_TRIMMED.format('coalesce(title, $$$$)')} AS title, coalesce(link, '') AS url, {_TRIMMED.format('coalesce(job_desc, $$$$)')} AS description, {_TRIMMED.format('coalesce(location, $$$$)')} AS location, '' AS salary, "
    f"{_TRIMMED.format('coalesce(update_time, $$$$)')} AS update_time, coalesce(source, '') AS tags FROM job_detail",
)
def _(t):
    return listings_of_feeds(_feed_of(t("job_detail"))).withColumn("tags", F.array_join("tags", " "))


@_query("u01_feeds_and_failures", "SELECT 'came' AS outcome, count(*) AS n FROM job_detail WHERE job_desc IS NOT NULL UNION ALL SELECT 'failed', count(*) FROM job_detail WHERE job_desc IS NULL")
def _(t):
    outcomes = t("job_detail").select(F.col("link").alias("url"), F.col("job_desc").alias("body"), F.when(F.col("job_desc").isNull(), "no body").alias("error"))
    came, failed = union_with_failures(outcomes)
    return came.agg(F.count("*").alias("n")).select(F.lit("came").alias("outcome"), "n").unionByName(failed.agg(F.count("*").alias("n")).select(F.lit("failed").alias("outcome"), "n"))


@_query("s08_uploaded_texts", "SELECT doc_id::VARCHAR AS telegram_id, text AS resume FROM documents WHERE doc_id % 3 <> 0 AND text <> ''")
def _(t):
    mime = F.when(F.col("doc_id") % 3 == 0, "application/pdf").otherwise("text/plain")
    return uploaded_texts(t("documents").select(F.col("doc_id").cast("string").alias("telegram_id"), mime.alias("mime"), F.encode("text", "UTF-8").alias("content")))


@_query(
    "c14_crawled_jobs",
    f"SELECT sha256(link) AS id, title, job_desc, to_json({_TAGS})::VARCHAR AS job_tags, link, 'board' AS source, location, salary, {day_sql()} AS update_time, NULL::VARCHAR AS vectorize_id FROM job_detail",
)
def _(t):
    listings = t("job_detail").select("title", F.col("link").alias("url"), F.col("job_desc").alias("description"), S.tags_of(F.col("job_tags")).alias("tags"), "location", "salary", "update_time")
    return to_jobs(listings, "board", TODAY)


@_query("k13_tables", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{f.name}', '{f.dataType.simpleString()}', {i}::BIGINT)" for t, s in TABLES.items() for i, f in enumerate(s)) + ") v(table_name, column_name, kind, place)")
def _(t):
    spark = t("region").sparkSession
    return spark.createDataFrame([(n, f.name, f.dataType.simpleString(), i) for n, s in TABLES.items() for i, f in enumerate(spark.createDataFrame([], s).schema)], "table_name string, column_name string, kind string, place bigint")


# What is shown.

_SHOWN = ("title", "job_desc", "link", "source", "location", "salary", "update_time")


@_query("s05_shown_jobs", f"SELECT id, {', '.join(f'coalesce({c}, $$$$) AS {c}' for c in _SHOWN)}, array_to_string({_TAGS}, '|') AS tags, vectorize_id FROM job_detail")
def _(t):
    return A.as_shown(t("job_detail")).withColumn("tags", F.array_join("tags", "|"))


def _block_sql(with_score: bool) -> str:
    labels = [("Title", "title"), ("Link", "link"), ("Location", "location"), ("Salary", "salary"), *([("Match Score", "match_score")] if with_score else [])]
    return " || ".join(f"'{label} : ' || coalesce({c}, '') || chr(10)" for label, c in labels) + " || 'Date : ' || split_part(coalesce(update_time, ''), 'T', 1) || chr(10)"


def _keys_sql(pages: str) -> str:
    return f"'Current Page 1|Total Page ' || {pages} || '|Pre Page|Next Page'"


@_query(
    "k12_all_jobs_reply",
    f"SELECT coalesce((SELECT string_agg({_block_sql(False)}, chr(10) ORDER BY update_time DESC NULLS LAST, id) FROM (SELECT * FROM job_detail ORDER BY update_time DESC NULLS LAST, id LIMIT 10)), 'No jobs available.') AS text, "
    f"{_keys_sql('(SELECT greatest(ceil(count(*) / 10.0), 1)::BIGINT FROM job_detail)')} AS keys",
)
def _(t):
    return A.all_jobs_reply(t("job_detail")).withColumn("keys", F.array_join("keys", "|"))


@_query(
    "k12_matched_replies",
    f"""WITH d AS (SELECT m.user_id, m.match_score, m.match_reason, m.job_id, m.update_time AS matched_at, j.title, j.link, j.location, j.salary, j.update_time, row_number() OVER (PARTITION BY m.user_id ORDER BY m.update_time DESC NULLS LAST, m.job_id, m.match_score NULLS FIRST, m.match_reason NULLS FIRST) AS r
    FROM user_matched_job m JOIN job_detail j ON m.job_id = j.id),
    b AS (SELECT user_id, string_agg({_block_sql(True)}, chr(10) ORDER BY r) AS text FROM d WHERE r <= 10 GROUP BY user_id), n AS (SELECT user_id, ceil(count(*) / 10.0)::BIGINT AS pages FROM d GROUP BY user_id)
    SELECT u.id AS user_id, coalesce(b.text, 'No matched job found, please try again later.') AS text, {_keys_sql("coalesce(n.pages, 1)")} AS keys FROM user_info u LEFT JOIN b ON b.user_id = u.id LEFT JOIN n ON n.user_id = u.id""",
)
def _(t):
    return A.matched_replies(t("user_info"), t("user_matched_job"), t("job_detail")).withColumn("keys", F.array_join("keys", "|"))


@_query(
    "o09_page_turns",
    """WITH c AS (SELECT chat_id, ts, text, split_part(text, '_callback_data_', 1) AS view, split_part(text, '_callback_data_', 2) AS what FROM session_event WHERE kind = 'callback' AND chat_id IS NOT NULL AND ts IS NOT NULL AND regexp_matches(text, '^(all_jobs|matched_jobs)_callback_data_')),
    p AS (SELECT *, coalesce(last_value(try_cast(what AS BIGINT) IGNORE NULLS) OVER (PARTITION BY chat_id, view ORDER BY ts, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page FROM c)
    SELECT chat_id, ts, view, what, page, CASE WHEN what = 'NEXT' THEN page + 1 WHEN what = 'PREV' AND page > 0 THEN page - 1 END AS turned FROM p""",
)
def _(t):
    rows = t("session_event").where((F.col("kind") == "callback") & F.col("chat_id").isNotNull() & F.col("ts").isNotNull() & F.col("text").rlike("^(all_jobs|matched_jobs)_callback_data_"))
    parts = rows.select("chat_id", "ts", "text", F.split_part("text", F.lit("_callback_data_"), F.lit(1)).alias("view"), F.split_part("text", F.lit("_callback_data_"), F.lit(2)).alias("what"))
    before = Window.partitionBy("chat_id", "view").orderBy("ts", "text").rowsBetween(Window.unboundedPreceding, -1)
    paged = parts.withColumn("page", F.coalesce(F.last(F.col("what").try_cast("bigint"), ignorenulls=True).over(before), F.lit(0)))
    action = F.when(F.col("what") == "NEXT", "next").when(F.col("what") == "PREV", "previous")
    return paged.select("chat_id", "ts", "view", "what", "page", S.next_page(F.col("page"), action).alias("turned"))


# Filters and functions.


@_query("f05_recent_jobs", f"SELECT id FROM job_detail WHERE coalesce(update_time, '') >= '{CUTOFF}'")
def _(t):
    return A.recent(t("job_detail"), CUTOFF).select("id")


@_query("f10_users_with_resume", "SELECT id FROM user_info WHERE resume <> ''")
def _(t):
    return A.users_with_resume(t("user_info")).select("id")


@_query("f12_routed_callbacks", "SELECT chat_id, ts, CASE WHEN starts_with(text, 'all_jobs_callback_data_') THEN 'all_jobs' WHEN starts_with(text, 'matched_jobs_callback_data_') THEN 'matched_jobs' END AS handler FROM session_event WHERE kind = 'callback'")
def _(t):
    rows = t("session_event").where("kind = 'callback'")
    return rows.select("chat_id", "ts", A.callback_handler(F.col("text")).alias("handler"))


@_query("o02_unembedded_page", "SELECT id, update_time FROM job_detail WHERE vectorize_id IS NULL ORDER BY update_time DESC NULLS LAST, id LIMIT 100")
def _(t):
    return A.unembedded_jobs(t("job_detail"), 100).select("id", "update_time")


@_query("c03_words_kept", "SELECT id, array_to_string(string_split(title, ' '), '|') AS words FROM job_detail WHERE title IS NOT NULL")
def _(t):
    return t("job_detail").where("title is not null").select("id", F.array_join(S.split_keeping(F.col("title")), "|").alias("words"))


@_query("c07_first_replaced", "SELECT id, regexp_replace(title, 'Engineer', coalesce(location, '')) AS title FROM job_detail WHERE coalesce(location, '') NOT LIKE '%\\%'")
def _(t):
    rows = t("job_detail").where(~F.coalesce("location", F.lit("")).contains("\\"))
    return rows.select("id", S.replace_first(F.col("title"), "Engineer", F.col("location")).alias("title"))


@_query("c15_tag_values", f"SELECT id, array_to_string({_TAGS}, '|') AS tags FROM job_detail")
def _(t):
    return t("job_detail").select("id", F.array_join(S.tags_of(F.col("job_tags")), "|").alias("tags"))


@_query("c16_tags_as_json", f"SELECT id, to_json({_TAGS})::VARCHAR AS tags FROM job_detail")
def _(t):
    return t("job_detail").select("id", S.tags_json(S.tags_of(F.col("job_tags"))).alias("tags"))


@_query("c18_cosines", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    a = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(S.cosine(F.col("a"), F.col("b")), 6).alias("score"))


@_query("c21_person_names", "SELECT id, trim(coalesce(nullif(split_part(name, ' ', 2), ''), '') || ' ' || coalesce(split_part(name, ' ', 1), '')) AS name FROM user_info")
def _(t):
    return t("user_info").select("id", S.person_name(F.split_part("name", F.lit(" "), F.lit(1)), F.nullif(F.split_part("name", F.lit(" "), F.lit(2)), F.lit(""))).alias("name"))


@_query("k07_upserted_numbers", "SELECT vec_id::VARCHAR AS id, i, round(CASE WHEN vec_id % 2 = 0 THEN CASE i WHEN 1 THEN 0.5 WHEN 2 THEN -0.3 ELSE 0.01 END ELSE embedding[i] END::DOUBLE, 6) AS x FROM embeddings, generate_series(1, 64) s(i)")
def _(t):
    from millrace.operators.store import upsert_vectors
    from millrace.plans.pipeline import trial_vector

    vectors = t("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    batch = vectors.where(F.col("id").cast("bigint") % 2 == 0).select("id", trial_vector(64).alias("embedding"))
    upserted = upsert_vectors(vectors, batch, [F.asc("id")], width=64)
    return upserted.select("id", F.posexplode("embedding").alias("i", "x")).select("id", (F.col("i") + 1).cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


@_query("s07_vectors_by_id", "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE text <> '')")
def _(t):
    index = ExactIndex(t("embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return index.get(t("documents").where("text <> ''").select(F.col("doc_id").alias("id"))).select("id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


# Models and the match stage. Users and jobs have vectors by the hash of their ids.

_SLOT = "(('0x' || substr(md5({0}), 1, 7))::BIGINT % (SELECT count(*) FROM embeddings))"


def _vectors_of(ids: DataFrame, embeddings: DataFrame) -> DataFrame:
    n = embeddings.count()
    slot = F.conv(F.substring(F.md5("id"), 1, 7), 16, 10).cast("bigint") % max(1, n)
    return ids.select("id", slot.alias("vec_id")).join(embeddings.select("vec_id", "embedding"), "vec_id").select("id", "embedding")


@_query(
    "x01_embedded_titles",
    """WITH w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> '')) AS word FROM job_detail WHERE title IS NOT NULL),
    v AS (SELECT id, ('0x' || substr(md5(word), 1, 7))::BIGINT % 64 AS i, sum(CASE WHEN substr(md5(word), 8, 1) < '8' THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL),
    n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM v GROUP BY id)
    SELECT id, i, round((x / norm)::FLOAT::DOUBLE, 6) AS x FROM v JOIN n USING (id) WHERE x <> 0""",
)
def _(t):
    found = embed_texts(t("job_detail").where("title is not null"), "id", "title", HashedWords())
    numbers = found.where("error is null").select("id", F.posexplode("embedding").alias("i", "x")).where("x <> 0")
    return numbers.select("id", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))


@_query("t10_failures_stay_alone", "SELECT id, contains(job_desc, 'Kubernetes') AS failed FROM job_detail WHERE job_desc <> ''")
def _(t):
    class Fails(HashedWords):
        """Fails on some texts, and with them on every batch that holds one."""

        def embed(self, texts):
            if any("Kubernetes" in x for x in texts):
                raise ValueError("refused")
            return HashedWords.embed(self, texts)

    found = embed_texts(t("job_detail").where("job_desc <> ''"), "id", "job_desc", Fails())
    return found.select("id", F.col("error").isNotNull().alias("failed"))


_HITS = f"""
u AS (SELECT i.id, e.embedding FROM user_info i JOIN embeddings e ON e.vec_id = {_SLOT.format("i.id")} WHERE i.resume <> '' AND i.vectorize_id IS NOT NULL),
v AS (SELECT j.id, e.vec_id, e.embedding FROM job_detail j JOIN embeddings e ON e.vec_id = {_SLOT.format("j.id")}),
s AS (SELECT u.id AS user_id, v.id AS job_id, list_cosine_similarity(u.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM u, v),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, job_id) AS rank FROM s),
hits AS (SELECT r.user_id, r.rank, j.* FROM r JOIN job_detail j ON j.id = r.job_id WHERE r.rank <= 30 AND coalesce(j.update_time, '') >= '{CUTOFF}')
"""


def _matching(t) -> tuple:
    """Users, their vectors, jobs, their vectors and the cutoff."""
    users, jobs, vectors = A.eligible_users(t("user_info")), t("job_detail"), t("embeddings")
    mine = _vectors_of(users.select("id"), vectors).select("id", "embedding")
    return users.withColumn("vectorize_id", F.col("id")), mine, jobs, _vectors_of(jobs.select("id"), vectors), CUTOFF


@_query("j10_match_stage", f"WITH {_HITS} SELECT user_id, id AS job_id, rank, title FROM hits")
def _(t):
    return match_candidates(*_matching(t)).select("user_id", "job_id", "rank", "title")


def _prompts(t) -> DataFrame:
    given = _matching(t)
    return match_prompts(given[0], *shared_candidates(*given))


_ENTRY_SQL = " || ',' || chr(10) || ".join(f"""'    "{name}": ' || to_json({value})::VARCHAR""" for name, value in (("jobId", "id"), *((n, f"coalesce({c}, '')") for n, c in (("jobTitle", "title"), ("jobLink", "link"), ("jobDescription", "job_desc"), ("location", "location"), ("salary", "salary")))))
_LIST_SQL = f"'[' || chr(10) || string_agg('  {{' || chr(10) || {_ENTRY_SQL} || chr(10) || '  }}', ',' || chr(10) ORDER BY rank) || chr(10) || ']'"


def _prompt_sql() -> str:
    head, rest = PROMPT.split("{resume}")
    middle, rest = rest.split("{expectations}")
    tail, end = rest.split("{jobs}")
    return f"{_sql_text(head)} || coalesce(u.resume, '') || {_sql_text(middle)} || coalesce(u.job_expectations, '') || {_sql_text(tail)} || l.jobs || {_sql_text(end)}"


@_query("x04_prompts", f"WITH {_HITS}, l AS (SELECT user_id, {_LIST_SQL} AS jobs FROM hits GROUP BY user_id) SELECT l.user_id, {_prompt_sql()} AS prompt FROM l JOIN user_info u ON u.id = l.user_id")
def _(t):
    return _prompts(t)


@_query(
    "x02_ranked_matches",
    f"WITH {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) - 1 AS place FROM hits) SELECT user_id, id AS job_id, '{NOW}' AS update_time, 0 AS notification, greatest(10 - place, 0)::VARCHAR AS match_score, 'place' AS match_reason FROM k WHERE place <= 4",
)
def _(t):
    return match_rows(rank_prompts(_prompts(t), "user_id", "prompt", KeepAll()), NOW, threshold=6)


@_query(
    "x03_completions_read",
    "SELECT user_id, job_id AS job, match_score AS score, match_reason AS reason FROM user_matched_job WHERE NOT starts_with(md5(job_id), '0') AND match_reason IS NOT NULL",
)
def _(t):
    """Completions as an object, a bare array and (of one in sixteen jobs) fenced text, which gives none."""
    rows = t("user_matched_job").where("match_reason is not null")
    entry = F.struct(F.col("job_id").alias("jobId"), F.lit("").alias("jobTitle"), F.lit("").alias("jobLink"), F.col("match_score").alias("matchScore"), F.col("match_reason").alias("reason"))
    bare, digit = F.to_json(F.array(entry)), F.substring(F.md5("job_id"), 1, 1)
    text = F.when(digit == "0", F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).when(digit < "8", bare).otherwise(F.concat(F.lit('{"matched_jobs": '), bare, F.lit("}")))
    return rows.select("user_id", F.explode(S.ranked_entries(text)).alias("e")).select("user_id", F.col("e.jobId").alias("job"), F.col("e.matchScore").alias("score"), F.col("e.reason").alias("reason"))


@_query("x07_list_index", "SELECT true AS enough, count(*) AS queries FROM embeddings WHERE vec_id % 50 = 0")
def _(t):
    """Whether an index of 32 lists, of which a query sees 28, finds nine tenths of
    the exact result. (These vectors lie evenly in all directions.)"""
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = vectors.where("id % 50 = 0")
    recall = ListIndex(vectors, probes=28, lists=32).recall(queries)
    return queries.agg(F.count("*").alias("queries")).select(F.lit(recall >= 0.9).alias("enough"), "queries")


@_query(
    "j10_all_vectors",
    "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 30",
)
def _(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return top_similar(vectors, vectors).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# Triggers, delivery and streams.


@_query(
    "k10_messages_of_a_firing",
    "WITH n AS (SELECT count(*) AS n FROM user_info WHERE resume <> '' AND vectorize_id IS NOT NULL) SELECT 'crawl' AS type, NULL::BIGINT AS \"offset\", 0::BIGINT AS seq UNION ALL SELECT 'embed', NULL, 1 UNION ALL SELECT 'match', i, i + 2 FROM n, generate_series(0, n - 1) s(i) UNION ALL SELECT 'notify', NULL, n + 2 FROM n",
)
def _(t):
    return messages_of_firing(t("user_info"))


@_query(
    "t09_delivered",
    "WITH reached AS (SELECT DISTINCT u.id FROM user_info u JOIN user_matched_job m ON m.user_id = u.id JOIN job_detail j ON j.id = m.job_id WHERE m.notification = 0 AND coalesce(u.telegram_id, '') <> '' AND NOT starts_with(md5(u.id), '0')) "
    "SELECT user_id, job_id, update_time, CASE WHEN user_id IN (SELECT id FROM reached) THEN 1 ELSE notification END AS notification FROM user_matched_job",
)
def _(t):
    """Messages that reach all but one user in sixteen."""
    matches = t("user_matched_job")
    reached = A.outbox(t("user_info"), matches, t("job_detail")).where(~F.md5("user_id").startswith("0")).select("user_id")
    return mark_delivered(matches, reached).select("user_id", "job_id", "update_time", "notification")


def _session_stream(t) -> DataFrame:
    events = t("session_event")
    spark, folder = events.sparkSession, f"{shared_folder(events.sparkSession)}/stream-{uuid.uuid4().hex}"
    # The files of a folder are a stream's one micro-batch, so every chat's events come in order.
    events.select("chat_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "text").write.parquet(f"{folder}/in")
    stream = session_stream(events_from(spark, f"{folder}/in", SESSION_EVENT.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_query("t06_session_stream", ACTIONS_SQL)
def _(t):
    return _session_stream(t)


@_query("t06_stream_and_batch_agree", "SELECT 0::BIGINT AS only_in_stream, 0::BIGINT AS only_in_batch")
def _(t):
    batch = session_actions(t("session_event")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    stream = _session_stream(t)
    count = lambda a, b, name: a.exceptAll(b.select(*a.columns)).agg(F.count("*").alias(name))
    both = count(stream, batch, "only_in_stream").unionByName(count(batch, stream, "only_in_batch"), allowMissingColumns=True)
    return both.agg(F.max("only_in_stream").alias("only_in_stream"), F.max("only_in_batch").alias("only_in_batch"))
