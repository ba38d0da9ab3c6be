"""Scalar functions as Column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schemas import NO_DESCRIPTION, RANKED

# What the trim of a browser's language strips, as a regular-expression class.
_SPACE = "\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_ISO = r"^\d{4}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?(?:Z|[+-]\d\d:?\d\d)?)?$"
_MAIL = r"^(?:[A-Za-z]{3}, *)?(\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d(?::\d\d)?) *(?:(GMT|UT|UTC|Z)|([+-]\d{4}))$"


def trim(text: Column) -> Column:
    """Without white space at either end, of any kind and with line ends."""
    return F.regexp_replace(text, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def blank_to(text: Column, default: Column | str) -> Column:
    """``default`` where a text is null or empty."""
    return F.when(text.isNull() | (text == ""), F.lit(default) if isinstance(default, str) else default).otherwise(text)


def split_keeping(text: Column, delimiter: str = " ") -> Column:
    """Parts of a text with the empty ones; an empty text has one empty part."""
    return F.split(text, f"\\Q{delimiter}\\E", -1)


def day_part(text: Column) -> Column:
    """What stands before the T of an instant; empty for null."""
    return F.split_part(F.coalesce(text, F.lit("")), F.lit("T"), F.lit(1))


def replace_first(text: Column, placeholder: str, value: Column) -> Column:
    """The first occurrence of a literal replaced by a literal; null values count as empty."""
    at = F.locate(placeholder, text)
    replaced = F.concat(F.substring(text, F.lit(1), at - 1), F.coalesce(value, F.lit("")), F.substring(text, at + len(placeholder), F.length(text)))
    return F.when(at > 0, replaced).otherwise(text)


def instant(text: Column) -> Column:
    """A written date or time as a timestamp: ISO 8601, or the form of mails and
    feeds. Null for anything else. The session's zone must be UTC."""
    t = trim(text)
    full = F.regexp_replace(F.regexp_replace(t, r"T(\d\d:\d\d)(?=$|Z|[+-])", "T$1:00"), r"(T.*[+-]\d\d)(\d\d)$", "$1:$2")
    iso = F.when(t.rlike(_ISO), full.try_cast("timestamp"))
    spelled, shift = F.regexp_extract(t, _MAIL, 1), F.regexp_extract(t, _MAIL, 3)
    local = F.coalesce(F.try_to_timestamp(spelled, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(spelled, F.lit("d MMM yyyy HH:mm")))
    minutes = F.coalesce(F.concat(F.substring(shift, 1, 1), F.substring(shift, 2, 2)).try_cast("int") * 60 + F.concat(F.substring(shift, 1, 1), F.substring(shift, 4, 2)).try_cast("int"), F.lit(0))
    return F.coalesce(iso, F.when(t.rlike(_MAIL), F.timestamp_seconds(F.unix_timestamp(local) - minutes * 60)))


def utc_day(text: Column, today: str) -> Column:
    """The UTC day of a written time as ``yyyy-MM-dd``; ``today`` where there is none."""
    return F.coalesce(F.date_format(instant(text), "yyyy-MM-dd"), F.lit(today))


def month_before(day: Column) -> Column:
    """A month before a day, rolling over where that month is shorter:
    31 March leads to 2 or 3 March, not to the end of February."""
    return F.date_add(F.trunc(F.add_months(day, -1), "MM"), F.dayofmonth(day) - 1)


def tags_of(json_text: Column) -> Column:
    """A JSON array as an array of strings; empty for null and unreadable text."""
    return F.coalesce(F.from_json(json_text, T.ArrayType(T.StringType())), F.array().cast("array<string>"))


def tags_json(tags: Column) -> Column:
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def ranked_entries(completion: Column) -> Column:
    """The entries of a ranking completion: of an object's ``matched_jobs``, of a
    bare array, and none for anything else."""
    whole = F.from_json(completion, T.StructType([T.StructField("matched_jobs", T.ArrayType(RANKED))]))["matched_jobs"]
    # A lone object would be read as an array of one.
    bare = F.when(F.ltrim(completion).startswith("["), F.from_json(completion, T.ArrayType(RANKED)))
    return F.coalesce(F.when(F.ltrim(completion).startswith("{"), whole), bare, F.array().cast(T.ArrayType(RANKED)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal width, 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    wide = F.raise_error(F.concat(F.lit("vectors of different width: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(F.size(a) != F.size(b), wide.cast("double")).when(both == 0, F.lit(0.0)).otherwise(dot / both)


def person_name(first: Column, last: Column) -> Column:
    """Last and first name with a space between, trimmed; null parts count as empty."""
    return trim(F.concat(F.coalesce(last, F.lit("")), F.lit(" "), F.coalesce(first, F.lit(""))))


def embedding_mark(job_id: Column, description: Column) -> Column:
    """What a job's ``vectorize_id`` becomes: its id, or that it has no text."""
    return F.when(F.coalesce(description, F.lit("")) == "", F.lit(NO_DESCRIPTION)).otherwise(job_id)


def page_count(rows: Column, size: int = 10) -> Column:
    """Pages of ``size`` rows, at least one."""
    return F.greatest(F.ceil(rows / size), F.lit(1)).cast("bigint")


def next_page(page: Column, action: Column) -> Column:
    """The page that an action leads to, counted from 0; null where nothing changes."""
    return F.when(action == "next", page + 1).when((action == "previous") & (page > 0), page - 1)


def json_value(text: Column) -> Column:
    """A text as a JSON string; null as ``null``."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def indented_json(fields: dict[str, Column]) -> Column:
    """An object of texts as indented JSON, two spaces a level, as an entry of an array."""
    lines = [F.concat(F.lit(f'    "{name}": '), json_value(value)) for name, value in fields.items()]
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *lines), F.lit("\n  }"))


def indented_array(rank: Column, entry: Column) -> Column:
    """An aggregate: the entries of a group in the order of ``rank`` as an indented JSON array."""
    return F.concat(F.lit("[\n"), joined_in_order(rank, entry, ",\n"), F.lit("\n]"))


# The labels of a message's lines with the columns they show.
_FIELDS = {"Title": "title", "Link": "link", "Location": "location", "Salary": "salary", "Match Score": "match_score", "Match Reason": "match_reason"}


def message_block(*labels: str, date: str = "update_time") -> Column:
    """Lines ``label : value`` of a row, with the day last; null counts as empty."""
    parts = [F.concat(F.lit(f"{label} : "), F.coalesce(F.col(_FIELDS[label]), F.lit("")), F.lit("\n")) for label in labels]
    return F.concat(*parts, F.lit("Date : "), day_part(F.col(date)), F.lit("\n"))


def joined_in_order(rank: Column, text: Column, between: str) -> Column:
    """An aggregate: texts of a group joined in the order of ``rank``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), text.alias("t")))), lambda x: x["t"]), between)
