"""Queries of the language-model text operators over whole tables, and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.multivalue import COUNTRY_NAMES, country_spellings
from millrace.llm.bpe import count_tokens, decode_ids, encode_texts
from millrace.llm.lookalikes import ARMENIAN, BREAKS, CHEROKEE, CYRILLIC, GREEK, HYPHENS, LIGATURES, canonical_texts, look_alike_classes, look_alike_pairs
from millrace.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from millrace.llm.packing import CAPACITY, pack
from millrace.llm.pii import find_personal_data, redact_personal_data
from millrace.llm.places import AFTER, BEFORE, EDITS, UNMATCHED, map_places, plain_letters, short_forms
from millrace.llm.topn import readable_score, top_per_group
from millrace.plans.problem_queries import values_sql
from millrace.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of personal data in a resume, by kind and place."""
    return find_personal_data(_table(spark, sf_dir, "user_info"), "id", "resume", "name")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resume with its personal data replaced by placeholders."""
    return redact_personal_data(_table(spark, sf_dir, "user_info"), "id", "resume", "name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place named in a location, by its entry in the place list."""
    return map_places(_table(spark, sf_dir, "job_detail"), "id", "location", _table(spark, sf_dir, "place_ref"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that are edited versions of one another."""
    return near_duplicate_pairs(_table(spark, sf_dir, "job_detail"), "id", "title", "job_desc")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every posting, and to how many postings it is linked."""
    return near_duplicate_groups(_table(spark, sf_dir, "job_detail"), "id", "title", "job_desc")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best jobs of every user."""
    matches = _table(spark, sf_dir, "user_matched_job")
    return top_per_group(matches, "user_id", "job_id", readable_score(F.col("match_score")), F.col("update_time").try_cast("timestamp"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document from its token ids."""
    return decode_ids(encode_texts(_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "ids")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens in which every part of a document lies."""
    return pack(count_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: none is over the capacity, no document that
    fits in one is cut, and every token of every document lies in exactly one."""
    sizes = cut_lineage(count_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    placed = cut_lineage(pack(sizes, "doc_id", "n_tokens"))
    fills = placed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    parts = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("parts"), F.max(F.col("start_at") + F.col("n_tokens")).alias("end"), F.count_if(F.col("container").isNull()).alias("nowhere"))
    each = sizes.join(parts, "doc_id", "left").agg(
        F.count("*").alias("documents"), F.sum("nowhere").alias("without_container"), F.count_if((F.col("n_tokens") <= CAPACITY) & (F.col("parts") > 1)).alias("cut_needlessly"),
        F.count_if(F.coalesce("placed", F.lit(-1)) != F.col("n_tokens")).alias("tokens_lost"), F.count_if(F.col("end") != F.col("n_tokens")).alias("gaps"),
    )
    over = fills.agg(F.count_if(F.col("fill") > CAPACITY).alias("over_capacity"), F.sum("fill").alias("fill"), F.count("*").alias("n"))
    wasteful = over.select("over_capacity", (F.col("n") > F.ceil(F.col("fill") / CAPACITY) * 1.01 + 1).alias("wasteful"))
    both = each.unionByName(wasteful, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("documents", "without_container", "cut_needlessly", "tokens_lost", "gaps", "over_capacity", "wasteful")])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose texts differ but look the same."""
    return look_alike_pairs(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document among those that look the same, and to how many it is linked."""
    return look_alike_classes(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one consistent form."""
    return canonical_texts(_table(spark, sf_dir, "documents"), "doc_id", "text")


P6_SQL = """
WITH cleaned AS (
  SELECT user_id, job_id, try_cast(update_time AS timestamptz) AS t,
         replace(trim(regexp_replace(match_score, '\\s+', ' ', 'g')), ',', '.') AS s
  FROM user_matched_job
), scored AS (
  SELECT user_id, job_id, t, CASE
      WHEN regexp_full_match(s, '\\d+(\\.\\d*)?') THEN try_cast(s AS double)
      WHEN regexp_full_match(s, '\\d+(\\.\\d*)? ?%') THEN round(try_cast(trim(replace(s, '%', '')) AS double) / 10, 6)
      WHEN regexp_full_match(s, '\\d+(\\.\\d*)? ?/ ?\\d+(\\.\\d+)?')
        THEN round(try_cast(trim(split_part(s, '/', 1)) AS double) * 10 / try_cast(trim(split_part(s, '/', 2)) AS double), 6)
    END AS score
  FROM cleaned
), best AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY score DESC, t DESC NULLS LAST) AS k
  FROM scored WHERE score BETWEEN 0 AND 10 AND user_id IS NOT NULL AND job_id IS NOT NULL
), ranked AS (
  SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, t DESC NULLS LAST, job_id) AS rank_no
  FROM best WHERE k = 1
)
SELECT user_id, job_id, rank_no FROM ranked WHERE rank_no <= 10
"""

_PAIRS_SQL = r"""
w AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || job_desc), '[\p{L}\p{N}]+') AS ws FROM job_detail WHERE len(regexp_extract_all(lower(job_desc), '[\p{L}\p{N}]+')) >= 20),
r AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM w, generate_series(1, len(ws) - 2) s(i)),
n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM r a JOIN r b ON a.run = b.run AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b FROM shared s JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE 2 * s.n >= a.n + b.n - s.n)
"""
P4_SQL = f"WITH {_PAIRS_SQL} SELECT id_a, id_b FROM pairs"
P4_GROUPS_SQL = f"""
WITH RECURSIVE {_PAIRS_SQL},
both_ways AS MATERIALIZED (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b)
SELECT j.id, least(j.id, coalesce((SELECT min(b) FROM reach WHERE a = j.id), j.id)) AS group_id, (SELECT count(*) FROM both_ways WHERE a = j.id) AS links FROM job_detail j
"""



def _place_sql() -> str:
    """Every value of a location against every name of the place list, by the keys
    that the operator uses."""
    source, target = plain_letters()
    longer = lambda x: f"regexp_replace(lower({x}), '[^\\pL\\pN]', '', 'g')"
    plain = lambda x: f"translate({x}, '{source}', '{target}')"

    def accent(x: str) -> str:
        x = f"trim({x})"
        for short, word in short_forms().items():
            x = f"regexp_replace({x}, '(?i)^{short}(?:\\.\\s*|\\s+)(\\S)', '{word} \\1')"
        return longer(x)

    before, after = ("|".join(sorted(x, key=len, reverse=True)) for x in (BEFORE, AFTER))
    bare = "regexp_replace(regexp_replace(name, '[(\\[][^)\\]]*[)\\]]', ' ', 'g'), '^[^\\pL]+|[^\\pL]+$', '', 'g')"
    stripped = f"regexp_replace(regexp_replace(trim({bare}), '(?i)^(?:(?:{before})\\s+)+', ''), '(?i)(?:\\s+(?:{after})\\b)+\\W*$', '')"
    codes = {spelled: code for spelled, code in country_spellings(COUNTRY_NAMES).items()}
    spelled = "|".join(sorted(codes, key=lambda c: (-len(c), c)))
    tail = f"'(?i)\\s*(?:,\\s*({spelled})|\\(\\s*({spelled})\\s*\\))[\\s.*]*$'"
    allowed = "CASE " + " ".join(f"WHEN length(r.plain) >= {n} THEN {k}" for n, k in sorted(EDITS.items(), reverse=True)) + " ELSE -1 END"
    return f"""
WITH {values_sql(1)},
codes AS (SELECT unnest(map_entries(MAP {{{", ".join(f"'{a}': '{b}'" for a, b in sorted(codes.items()))}}})) AS e),
refs AS (SELECT place_id, country_code, accent, {plain("accent")} AS plain FROM (SELECT DISTINCT place_id, country_code, {accent("n")} AS accent FROM (SELECT place_id, country_code, unnest(list_prepend(place_name, coalesce(alt_names, []))) AS n FROM place_ref) WHERE n IS NOT NULL) WHERE accent <> ''),
parts AS (SELECT piece, regexp_replace(piece, {tail}, '') AS name, (SELECT e.value FROM codes WHERE e.key = lower(regexp_extract(piece, {tail}, 1) || regexp_extract(piece, {tail}, 2))) AS country FROM (SELECT DISTINCT piece FROM cut)),
forms AS (SELECT *, {plain("accent")} AS plain FROM (SELECT piece, country, 0 AS form, {accent("name")} AS accent FROM parts UNION ALL SELECT piece, country, 1, {accent(stripped)} FROM parts) WHERE accent <> ''),
equal AS (SELECT piece, place_id, country IS NOT DISTINCT FROM country_code AS same, form * 2 + CASE WHEN f.accent = r.accent THEN 0 ELSE 1 END AS level, 0 AS edits FROM forms f JOIN refs r ON f.plain = r.plain),
alike AS (SELECT piece, place_id, country IS NOT DISTINCT FROM country_code AS same, 4 AS level, levenshtein(f.plain, r.plain) AS edits FROM forms f JOIN refs r ON levenshtein(f.plain, r.plain) <= {allowed} WHERE piece NOT IN (SELECT piece FROM equal)),
chosen AS (SELECT piece, arg_min(place_id, (level, edits, NOT same, place_id)) AS place_id FROM (FROM equal UNION ALL FROM alike) GROUP BY piece)
SELECT DISTINCT cut.id, coalesce(chosen.place_id, {UNMATCHED}) AS place_id FROM cut LEFT JOIN chosen USING (piece)
"""


def _skeleton_sql(text: str) -> str:
    """A text with all look-alikes as Latin letters, in SQL. Without regard to
    scripts this is no readable form, but it is equal for texts that look the same."""
    pairs = {chr(c): "-" if chr(c) in HYPHENS else " " for c in (*map(ord, HYPHENS), *(c for c in range(0x80, 0x3400) if unicodedata.category(chr(c)) == "Zs"))}
    pairs |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(BREAKS, "\n") | {"\uff0d": "-"}
    latin = CYRILLIC | GREEK | ARMENIAN | CHEROKEE
    for c in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))):
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and apart[0] in latin and len(whole := unicodedata.normalize("NFC", latin[apart[0]] + apart[1:])) == 1:
            latin = latin | {c: whole}
    lit = lambda t: "'" + "".join(f"' || chr({ord(c)}) || '" if not c.isascii() or c in "'\\\n\r" else c for c in t) + "'"
    out = f"replace({text}, chr(13) || chr(10), chr(10))"
    out = f"regexp_replace({out}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}\\x{{034F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}\\x{{FFA0}}]', '', 'g')"
    for c in LIGATURES:
        out = f"replace({out}, chr({ord(c)}), '{unicodedata.normalize('NFKC', c)}')"
    for table in (pairs, latin):
        out = f"nfc_normalize(translate({out}, {lit(''.join(table))}, {lit(''.join(table.values()))}))"
    return out


_LOOKS = f"s AS (SELECT doc_id, text, {_skeleton_sql('text')} AS look FROM documents WHERE text IS NOT NULL), v AS (SELECT * FROM s WHERE regexp_replace(look, '[\\p{{Z}}\\p{{C}}]', '', 'g') <> '')"
P10_SQL = f"WITH {_LOOKS} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM v a JOIN v b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text"
P10_CLASSES_SQL = f"""
WITH {_LOOKS}, n AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY look) AS class_id, count(*) OVER (PARTITION BY look) - count(*) OVER (PARTITION BY look, text) AS links FROM v)
SELECT d.doc_id, coalesce(n.class_id, d.doc_id) AS class_id, coalesce(n.links, 0) AS links FROM documents d LEFT JOIN n USING (doc_id)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_containers": p9_containers,
    "p9_checked": p9_checked,
    "p10_found": p10_found,
    "p10_classes": p10_classes,
    "p10_canonical": p10_canonical,
}
ORACLE = {
    "p2_found": _place_sql(),
    "p4_found": P4_SQL,
    "p4_groups": P4_GROUPS_SQL,
    "p6_found": P6_SQL,
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_found": P10_SQL,
    "p10_classes": P10_CLASSES_SQL,
    "p9_checked": "SELECT count(*) AS documents, count(*) FILTER (coalesce(text, '') = '') AS without_container, 0::BIGINT AS cut_needlessly, 0::BIGINT AS tokens_lost, 0::BIGINT AS gaps, 0::BIGINT AS over_capacity, false AS wasteful FROM documents",
}
