"""Freely written places mapped to a list of canonical ones.

SQL alone. A field is split by one regular expression, an alternation of
delimiters and values. Distinct values are matched once each: by equal keys
first, and the rest by a pigeonhole join. A reference key that may differ in k
edits is cut into k + 1 segments; a value within k edits of it must hold one
segment unchanged, at a position that the edits before and after it allow. Those
substrings are joined by equality and verified with ``levenshtein``. What no
candidate survives for is found by anti-join and reported as ``UNMATCHED``.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame

from millrace.functions.multivalue import BRACKETS, MARKS, QUOTES, WORDS, contains_delimiter, country_spellings
from millrace.operators.splitting import country_codes, names_with_delimiters
from millrace.session import cut_lineage

#: Edits allowed between a value and a reference key, by the least length of the
#: key: up to a third of it. One edit turns a shorter key into another word.
EDITS = {6: 2, 5: 1}
UNMATCHED = -1

# Words around a place that don't belong to its name.
BEFORE = ("the", "greater", "downtown", "near", "on-site", "onsite", "on site", "central", "hybrid", "metro")
AFTER = ("area", "metro", "metro area", "metropolitan area", "region", "hq", "headquarters", "city centre", "city center", "hybrid", "on-site", "onsite", "office", "site")
# Words that begin many names and are written short.
LEADING = ("saint", "mount", "port", "fort", "upper", "lower", "lake", "new", "north", "south", "east", "west")

_LETTERS = [chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha()]


def plain_letters() -> tuple[str, str]:
    """Accented Latin letters and, at the same position, their base letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in _LETTERS]
    pairs = [(c, b.lower()) for c, b in pairs if b != c and b.isascii()] + [("ø", "o"), ("Ø", "o"), ("đ", "d"), ("ł", "l"), ("Ł", "l"), ("ı", "i")]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def _lit(text: str) -> str:
    """A text as a literal of the SQL that ``spark.sql`` formats."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"


#: White space of any kind, in a class of a regular expression and for ``trim``.
_SPACES = r"\s\u00A0\u2000-\u200A\u202F\u3000"
_WHITE = "' \\t\\n\\r\\u000C\\u000B\\u00A0\\u2002\\u2003\\u2009\\u202F\\u3000'"


def _edits(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} >= {least} THEN {k}" for least, k in sorted(EDITS.items(), reverse=True)) + " END"


def _letters_only(expr: str) -> str:
    return f"regexp_replace({expr}, '[^\\\\pL\\\\pN]', '')"


def short_forms(words: tuple[str, ...] = LEADING) -> dict[str, str]:
    """How words are written short: their first letter with the consonants after it
    (``prt``, ``upr``), with the last of them alone (``pt``, ``lk``), and ``n`` for new."""
    out = {"n": "new"}
    for word in words:
        after = re.sub(r"(.)\1", r"\1", re.sub("[aeiou]", "", word[1:]))
        for short in (word[0] + after, word[0] + after[-1:]):
            if 1 < len(short) < len(word):
                out.setdefault(short, word)
    return out


def _spelled_out(expr: str) -> str:
    forms = short_forms()
    begins = f"'(?i)^({'|'.join(sorted(forms, key=len, reverse=True))})(?:\\\\.\\\\s*|\\\\s+)(?=\\\\S)'"
    words = ", ".join(f"'{short}', '{word} '" for short, word in forms.items())
    return f"concat(coalesce(element_at(map({words}), lower(regexp_extract({expr}, {begins}, 1))), ''), regexp_replace({expr}, {begins}, ''))"


def _accent_key(expr: str) -> str:
    return _letters_only(f"lower({_spelled_out(f'trim({expr})')})")


def _plain_key(expr: str) -> str:
    source, target = plain_letters()
    return f"translate(regexp_replace({expr}, '\\\\pM', ''), {_lit(source)}, {_lit(target)})"


def _stripped(expr: str) -> str:
    before, after = "|".join(sorted(BEFORE, key=len, reverse=True)), "|".join(sorted(AFTER, key=len, reverse=True))
    bare = f"regexp_replace(regexp_replace({expr}, '[(\\\\[][^)\\\\]]*[)\\\\]]', ' '), '^[^\\\\pL]+|[^\\\\pL]+$', '')"
    return f"regexp_replace(regexp_replace(trim({bare}), '(?i)^(?:(?:{before})\\\\s+)+', ''), '(?i)(?:\\\\s+(?:{after})\\\\b)+\\\\W*$', '')"


def value_pattern(protected: list[str], qualifiers: list[str]) -> str:
    """A regular expression whose second group is a value of a field; its first
    matches what stands between values.

    A quote counts where a value begins and only if it is closed; brackets hold
    their delimiters back, nested up to three deep; a backslash makes the next
    character ordinary; ``protected`` names are never cut; a comma with one of
    ``qualifiers`` (a country) belongs to the value before it, once a value.
    """
    quote = lambda text: re.sub(r"([^\w\s])", r"\\\1", text)
    marks, word = f"[{quote(MARKS)}]", r"[\pL\pN_]"
    words, white, black = "|".join(WORDS), f"[{_SPACES}]", f"[^{_SPACES}]"
    names = "|".join(f"{white}+".join(map(quote, n.split())) for n in sorted({n.strip() for n in protected if contains_delimiter(n)}, key=lambda n: (-len(n), n)))
    name = rf"(?<!{word})(?iu:{names})(?!{word})" if names else r"(?!)"
    opening, closing = (f"[{quote(''.join(x))}]" for x in (BRACKETS, BRACKETS.values()))
    plain, nested = f"[^{opening[1:-1]}{closing[1:-1]}]", "(?!)"
    for _ in range(3):
        nested = f"{opening}(?:{plain}++|{nested})*+{closing}"
    quoted = []
    for first, last in QUOTES.items():
        inside = [quote(last) * 2] * (first == last) + [f"[^{quote(last)}]"] + [rf"{quote(last)}(?=[\pL\pN])"] * (last in "'’")
        quoted.append(f"{quote(first)}(?:{'|'.join(inside)})*+{quote(last)}")
    part = rf"(?:\\.|{name}|{nested}|{word}++|(?!{white}+(?:{words}){white})[^{marks[1:-1]}])"
    spelled = "|".join(quote(q) for q in sorted(qualifiers, key=lambda q: (-len(q), q)))
    country = rf"(?iu:,{white}*+(?!{name})(?:{spelled})(?={white}*(?:\z|{marks}|{white}(?:{words}){white})))" if spelled else "(?!)"
    value = rf"(?:{'|'.join(quoted)}|(?!{white}){part}){part}*+(?:{country}{part}*+)?"
    return f"(?s)({marks}|{white}+(?:{words})(?={white})|{white}+(?!{black}))|(?:{white}*+({value}))"


#: A value in quotes, which are no part of it.
_ENCLOSED = "(?s)" + "|".join(f"^{first}(.*){last}$" for first, last in QUOTES.items())


def map_places(df: DataFrame, key: str, field: str, place_ref: DataFrame) -> DataFrame:
    """``(key, place_id)``: one row per row key and distinct place its field names.

    A value that means no entry adds ``UNMATCHED``, once a key. Equal names in
    two countries are told apart by the country written; without one, the
    smaller place_id holds. Null and blank fields give no row; null keys are
    kept; repeated rows count once; with an empty reference every value is
    unmatched. Only ``key`` and ``field`` of ``df`` are read.
    """
    spark = df.sparkSession
    countries = country_spellings(country_codes(place_ref))
    pattern = value_pattern(names_with_delimiters(place_ref), sorted(countries))
    split = f"""
        SELECT DISTINCT k, trim({_WHITE}, regexp_replace(trim({_WHITE}, piece), {_lit(_ENCLOSED)}, '$1$2$3$4$5$6')) AS piece
        FROM {{rows}} LATERAL VIEW explode(regexp_extract_all(field, {_lit(pattern)}, 2)) AS piece WHERE trim({_WHITE}, piece) <> ''
    """
    pieces = cut_lineage(spark.sql(split, rows=df.selectExpr(f"`{key}` AS k", f"`{field}` AS field")))
    spelled = "|".join(sorted(countries, key=lambda c: (-len(c), c))) or "-"
    tail = f"'(?i)\\\\s*(?:,\\\\s*({spelled})|\\\\(\\\\s*({spelled})\\\\s*\\\\))[\\\\s.*]*$'"
    codes = ", ".join(f"{_lit(s)}, {_lit(c)}" for s, c in sorted(countries.items())) or "'-', '-'"

    refs = spark.sql(
        f"""
        WITH names AS (
          SELECT place_id, country_code, explode(concat(array(place_name), coalesce(alt_names, array()))) AS name FROM {{places}}
        ), keys AS (SELECT DISTINCT place_id, country_code, {_accent_key("name")} AS accent_key FROM names WHERE name IS NOT NULL)
        SELECT place_id, country_code, accent_key, {_plain_key("accent_key")} AS plain_key FROM keys WHERE accent_key <> ''
        """,
        places=place_ref,
    )
    values = spark.sql(
        f"""
        WITH parts AS (
          SELECT piece, regexp_replace(piece, {tail}, '') AS name,
                 element_at(map({codes}), lower(concat(regexp_extract(piece, {tail}, 1), regexp_extract(piece, {tail}, 2)))) AS country
          FROM (SELECT DISTINCT piece FROM {{pieces}})
        ), forms AS (
          SELECT piece, country, 0 AS form, {_accent_key("name")} AS accent_key FROM parts
          UNION ALL SELECT piece, country, 1 AS form, {_accent_key(_stripped("name"))} AS accent_key FROM parts
        )
        SELECT piece, country, form, accent_key, {_plain_key("accent_key")} AS plain_key FROM forms WHERE accent_key <> ''
        """,
        pieces=pieces,
    )
    values = cut_lineage(values)
    equal = spark.sql(
        """
        SELECT v.piece, r.place_id, v.country <=> r.country_code AS same_country,
               v.form * 2 + CASE WHEN v.accent_key = r.accent_key THEN 0 ELSE 1 END AS level, 0 AS edits
        FROM {values} v JOIN {refs} r ON v.plain_key = r.plain_key
        """,
        values=values,
        refs=refs,
    )
    equal = cut_lineage(equal)
    similar = spark.sql(
        f"""
        WITH open AS (
          SELECT piece, country, form, plain_key, length(plain_key) AS n
          FROM {{values}} v LEFT ANTI JOIN {{equal}} e ON v.piece = e.piece
        ), keys AS (SELECT place_id, country_code, plain_key AS ref_key, length(plain_key) AS m, {_edits("length(plain_key)")} AS k FROM {{refs}}
        ), built AS (
          SELECT place_id, country_code, ref_key, m, i, substring(ref_key, m * i div (k + 1) + 1, m * (i + 1) div (k + 1) - m * i div (k + 1)) AS part
          FROM keys LATERAL VIEW explode(sequence(0, k)) AS i WHERE k IS NOT NULL
        ), lengths AS (
          SELECT *, {_edits("m")} AS k FROM open LATERAL VIEW explode(sequence(greatest(1, n - {max(EDITS.values())}), n + {max(EDITS.values())})) AS m
        ), cuts AS (
          SELECT *, n - m AS longer, m * i div (k + 1) AS at, m * (i + 1) div (k + 1) - m * i div (k + 1) AS width
          FROM lengths LATERAL VIEW explode(sequence(0, k)) AS i WHERE k IS NOT NULL AND abs(n - m) <= k
        ), shifts AS (
          SELECT *, greatest(-i, longer - (k - i)) AS least_shift, least(i, longer + (k - i)) AS most_shift FROM cuts
        ), probes AS (
          SELECT DISTINCT piece, country, form, plain_key, m, k, i, substring(plain_key, at + shift + 1, width) AS part
          FROM shifts LATERAL VIEW explode(sequence(least_shift, most_shift)) AS shift
          WHERE least_shift <= most_shift AND at + shift >= 0 AND at + shift + width <= n
        ), candidates AS (
          SELECT DISTINCT p.piece, p.country, p.form, p.plain_key, p.k, b.place_id, b.country_code, b.ref_key
          FROM probes p JOIN built b ON p.m = b.m AND p.i = b.i AND p.part = b.part
        ), verified AS (
          SELECT piece, place_id, country <=> country_code AS same_country, form, k, levenshtein(plain_key, ref_key) AS edits FROM candidates
        )
        SELECT piece, place_id, same_country, 4 AS level, edits FROM verified WHERE edits <= k
        """,
        values=values,
        equal=equal,
        refs=refs,
    )
    return spark.sql(
        f"""
        WITH hits AS (SELECT * FROM {{equal}} UNION ALL SELECT * FROM {{similar}}
        ), chosen AS (
          SELECT piece, min_by(place_id, struct(level, edits, NOT same_country, place_id)) AS place_id FROM hits GROUP BY piece
        ), matched AS (SELECT p.k, c.place_id FROM {{pieces}} p JOIN chosen c ON p.piece = c.piece
        ), unmatched AS (SELECT p.k, CAST({UNMATCHED} AS bigint) AS place_id FROM {{pieces}} p LEFT ANTI JOIN chosen c ON p.piece = c.piece)
        SELECT DISTINCT k AS `{key}`, CAST(place_id AS bigint) AS place_id FROM (SELECT * FROM matched UNION ALL SELECT * FROM unmatched)
        """,
        equal=equal,
        similar=similar,
        pieces=pieces,
    )
