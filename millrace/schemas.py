"""Schemas of the engine's tables and of what passes between its stages."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _S) for n in names]


#: A listing as an extractor gives it.
LISTING = T.StructType([*_strings("title", "url", "description"), T.StructField("tags", T.ArrayType(_S)), *_strings("location", "salary", "update_time")])
JOB = T.StructType(_strings("id", "title", "job_desc", "job_tags", "link", "source", "location", "salary", "update_time", "vectorize_id"))
USER = T.StructType(_strings("id", "name", "email", "telegram_id", "resume", "job_expectations", "vectorize_id"))
MATCH = T.StructType([*_strings("user_id", "job_id", "update_time"), T.StructField("notification", T.IntegerType()), *_strings("match_score", "match_reason")])
VECTOR = T.StructType([T.StructField("id", _S), T.StructField("embedding", T.ArrayType(T.FloatType()))])
#: One entry of a ranking completion; its fields keep the names of the JSON.
RANKED = T.StructType(_strings("jobId", "jobTitle", "jobLink", "matchScore", "reason"))
SESSION_EVENT = T.StructType([T.StructField("chat_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("kind", _S), T.StructField("text", _S)])
SESSION_STATE = T.StructType([T.StructField("awaiting_upload", T.BooleanType()), T.StructField("last_bot_message", _S)])

#: The mark of a job that has nothing to embed.
NO_DESCRIPTION = "__no_desc__"
EMBEDDING_WIDTH = 1024
TABLES = {"job_detail": JOB, "user_info": USER, "user_matched_job": MATCH, "job_vector": VECTOR, "resume_vector": VECTOR}
