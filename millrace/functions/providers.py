"""Models behind two small protocols, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import indented_json, ranked_entries
from millrace.operators.arrowmap import arrow_map


class EmbeddingProvider(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class RankProvider(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashedWords:
    """Embeds a text as signed counts of its hashed words, of unit length. Words
    are runs without white space in lower case; the first seven digits of a
    word's MD5 in hexadecimal give its place, the eighth its sign."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.width)
            for word in text.lower().split():
                h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
                v[int(h[:7], 16) % self.width] += 1 if h[7] < "8" else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class KeepAll:
    """Ranks every job of a prompt with a score from its place in the list."""

    def complete(self, prompt: str) -> str:
        start = prompt.rindex(JOBS_HEAD) + len(JOBS_HEAD)
        jobs, _ = json.JSONDecoder().raw_decode(prompt, start)
        return json.dumps({"matched_jobs": [{"jobId": j["jobId"], "jobTitle": j["jobTitle"], "jobLink": j.get("jobLink", ""), "matchScore": str(max(0, 10 - i)), "reason": "place"} for i, j in enumerate(jobs)]})


#: Models by the names that a configuration gives.
EMBEDDERS = {"hashed-words": HashedWords}
RANKERS = {"keep-all": KeepAll}


@dataclass(frozen=True)
class Config:
    """Settings; an empty value of the environment counts as absent."""

    embedding_model: str = "hashed-words"
    rank_model: str = "keep-all"
    top_k: int = 30
    page_size: int = 10
    session_ttl_ms: int = 600_000

    @staticmethod
    def of(environment: Mapping[str, str] = os.environ) -> Config:
        d = Config()
        get = lambda name, default: environment.get(f"MILLRACE_{name}") or default
        return Config(get("EMBEDDING_MODEL", d.embedding_model), get("RANK_MODEL", d.rank_model), int(get("TOP_K", d.top_k)), int(get("PAGE_SIZE", d.page_size)), int(get("SESSION_TTL_MS", d.session_ttl_ms)))

    def models(self) -> tuple[EmbeddingProvider, RankProvider]:
        return EMBEDDERS[self.embedding_model](), RANKERS[self.rank_model]()


JOBS_HEAD = "Jobs, as JSON:\n"
#: What is asked of a ranking model.
PROMPT = """You advise people on their careers. Compare one resume with a list of jobs and name the jobs that suit it.

Expectations come first. Where the candidate states any, each of them must be met: a job that misses one has the score "0" and is left out of the answer. Where none are stated, judge by skills and experience alone.

Proceed so:
1. From the resume take skills, qualifications, certificates, earlier roles, industries and years of experience.
2. From each job take the required skills, qualifications and experience, its title, industry, location, pay and whether it is remote, hybrid or on site.
3. Drop the jobs that miss an expectation (location, pay, language, way of working, title and the like).
4. Give each job that is left a score from 0 to 10 for how well it fits, with a short reason.
5. Answer only with the jobs whose score is 6 or more.

Answer with JSON alone, without any other text or markup, in this form:
{"matched_jobs": [{"jobId": "<id>", "jobTitle": "<title>", "jobLink": "<link>", "matchScore": "<score>", "reason": "<why it fits>"}]}

Resume:
{resume}

Expectations:
{expectations}

""" + JOBS_HEAD + "{jobs}\n"


def prompt_of(resume: Column, expectations: Column, jobs_json: Column, template: str = PROMPT) -> Column:
    """The template with its placeholders filled; what a resume holds that looks
    like a placeholder stays as it is. Null counts as empty."""
    parts = re.split(r"(\{resume\}|\{expectations\}|\{jobs\})", template)
    values = {"{resume}": resume, "{expectations}": expectations, "{jobs}": jobs_json}
    return F.concat(*[F.coalesce(values[p], F.lit("")) if p in values else F.lit(p) for p in parts])


def job_entry() -> Column:
    """A job as an entry of the list in a prompt; nulls as empty texts."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return indented_json({"jobId": F.col("job_id"), "jobTitle": empty("title"), "jobLink": empty("link"), "jobDescription": empty("job_desc"), "location": empty("location"), "salary": empty("salary")})


def embed_texts(df: DataFrame, key: str, text: str, provider: EmbeddingProvider, batch: int = 64) -> DataFrame:
    """``(id, embedding, error)``: a text that the provider fails on has an error
    and no vector, and the others come through."""

    def setup():
        def run(keys, texts):
            vectors: list = []
            errors: list = []
            for at in range(0, len(keys), batch):
                part = [t or "" for t in texts[at : at + batch]]
                try:
                    vectors += provider.embed(part)
                    errors += [None] * len(part)
                except Exception:
                    for t in part:  # one by one, to keep the failure to its text
                        try:
                            vectors += provider.embed([t])
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
            return keys, vectors, errors

        return run

    return arrow_map(df.select(F.col(key).cast("string"), text), setup, "id string, embedding array<float>, error string")


def rank_prompts(df: DataFrame, key: str, prompt: str, provider: RankProvider) -> DataFrame:
    """``(user_id, ok, error, entries)``: each prompt's completion, read."""

    def setup():
        def run(keys, prompts):
            answers, errors = [], []
            for p in prompts:
                try:
                    answers.append(provider.complete(p))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            return keys, answers, errors

        return run

    raw = arrow_map(df.select(key, prompt), setup, "user_id string, completion string, error string")
    return raw.select("user_id", F.col("error").isNull().alias("ok"), "error", ranked_entries(F.col("completion")).alias("entries"))
