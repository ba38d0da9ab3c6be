"""Queries of the general data-cleaning operators over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.instants import ABBREVIATIONS
from millrace.functions.multivalue import COUNTRY_NAMES, MARKS, QUOTES
from millrace.functions.units import CURRENCY_WORDS, NEEDS_LEAD, PERIOD_WORDS, SCALE_WORDS, STATEMENT_PARTS
from millrace.operators.instants import to_instants
from millrace.operators.quantities import to_usd_per_year
from millrace.operators.splitting import split_values


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable pay figure as US dollars a year."""
    return to_usd_per_year(_table(spark, sf_dir, "job_detail"), "id", "salary", "job_desc", _table(spark, sf_dir, "unit_ref"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per place of every location that holds several."""
    return split_values(_table(spark, sf_dir, "job_detail"), "id", "location", _table(spark, sf_dir, "place_ref"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting time that states an instant, in UTC."""
    return to_instants(_table(spark, sf_dir, "job_detail"), "id", "update_time", "source", _table(spark, sf_dir, "board_ref"))


# The SQL splits in another way than the operator: what must not be cut is first
# rewritten with stand-ins for its delimiters, one replacement for names of the
# place list, one for quotes, one for brackets and one for countries; then the
# rest is cut at every delimiter, and the stand-ins are turned back.
_HELD = "".join(chr(0xE000 + i) for i in range(len(MARKS)))
_BREAK = "\uf8ff"


def _sql(text: str) -> str:
    """A text as SQL, with characters that are hard to see by their number."""
    return "'" + "".join(f"' || chr({ord(c)}) || '" if c in "'\n\r\t" or not c.isascii() else c for c in text) + "'"


def values_sql(least: int) -> str:
    """``cut``: ``(id, pos, piece)`` of locations that hold at least ``least`` values."""
    marks = "[" + "".join("\\" + c if c.isascii() and c.isprintable() else c for c in MARKS) + "]"
    between = rf"(?:{marks}|\s(?:and|or)\s)"
    quoted = "|".join(rf"{a}(?:{b}{b}|[^{b}]" + (rf"|{b}[\pL\pN]" if b in "'’" else "") + rf")*{b}" if a == b else rf"{a}[^{b}]*{b}" for a, b in QUOTES.items())
    spelled = "|".join(sorted((re.escape(x) for code, names in COUNTRY_NAMES.items() for x in (code, *names)), key=lambda x: (-len(x), x)))
    hold = lambda x: f"regexp_replace(translate({x}, {_sql(MARKS)}, {_sql(_HELD)}), ' (and|or) ', ' ' || {_sql(_BREAK)} || '\\1 ', 'g')"
    inside = lambda x: f"(CASE WHEN length({x}) = 1 THEN {x} ELSE regexp_extract({x}, {_sql(f'^(?s:{between}?)')}) || {hold(f'regexp_replace({x}, {_sql(f"^(?s:{between}?)")}, $$$$)')} END)"
    enclosed = " ".join(f"WHEN starts_with(x, {_sql(a)}) AND ends_with(x, {_sql(b)}) AND length(x) > 1 THEN replace(x[2:-2], {_sql(b + b)}, {_sql(b if a == b else b + b)})" for a, b in QUOTES.items())
    pieces = lambda pattern, change, of: f"array_to_string(list_transform(regexp_extract_all({of}, {_sql('(?s)' + pattern + '|.')}), lambda x: {change}), '')"
    return f"""
names AS (SELECT list(n ORDER BY length(n) DESC, n) AS ns FROM (SELECT DISTINCT unnest(list_prepend(place_name, coalesce(alt_names, []))) AS n FROM place_ref) WHERE regexp_matches(n, {_sql(marks + '| (and|or) ')})),
c0 AS (SELECT id, location AS t FROM job_detail WHERE regexp_matches(location, '\\S')),
c1 AS (SELECT id, list_reduce(list_prepend(t, coalesce((SELECT ns FROM names), [])), lambda a, n: regexp_replace(a, '(?i)\\b(' || regexp_replace(regexp_replace(regexp_escape(n), {_sql('(\\\\)?(' + marks + ')')}, ')(\\1\\2)(', 'g'), '(\\\\ | )(and|or)(\\\\ | )', ' )(\\2)( ', 'g') || ')\\b',
    '\\1' || CASE WHEN regexp_matches(n, ' (and|or) ') THEN {_sql(_BREAK)} || '\\2' ELSE translate(regexp_extract(n, {_sql(marks)}), {_sql(MARKS)}, {_sql(_HELD)}) END || '\\3', 'g')) AS t FROM c0),
c2 AS (SELECT id, {pieces(rf"(?:^|{between})\s*(?:{quoted})", inside("x"), "t")} AS t FROM c1),
c3 AS (SELECT id, {pieces(r"[(\[{][^()\[\]{}]*[)\]}]", f"CASE WHEN length(x) = 1 THEN x ELSE {hold('x')} END", "t")} AS t FROM c2),
c4 AS (SELECT id, regexp_replace(t, {_sql(rf"([^\s{marks[1:-1]}])(\s*),(\s*(?i:{spelled})\s*)($|{marks}|\s(?:and|or)\s)")}, '\\1\\2' || {_sql(_HELD[MARKS.index(",")])} || '\\3\\4', 'g') AS t FROM c3),
c5 AS (SELECT id, list_transform(regexp_split_to_array(t, {_sql(rf"{marks}|\s+(?:and|or)\s")}), lambda x: regexp_replace(translate(replace(x, {_sql(_BREAK)}, ''), {_sql(_HELD)}, {_sql(MARKS)}), '^\\s+|\\s+$', '', 'g')) AS xs FROM c4),
c6 AS (SELECT id, list_filter(list_transform(xs, lambda x: CASE {enclosed} ELSE x END), lambda x: trim(x) <> '') AS xs FROM c5),
cut AS (SELECT id, unnest(generate_series(1, len(xs))) AS pos, trim(unnest(xs)) AS piece FROM c6 WHERE len(xs) >= {least})
"""


# The SQL takes a time apart from left to right, one expression for the date, one
# for the time and one for the zone, and leaves the calendar to the database.
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DATE_FORMS = (
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", "ymd"), (r"(\d{4})/(\d{1,2})/(\d{1,2})", "ymd"), (r"(\d{4})\.(\d{1,2})\.(\d{1,2})", "ymd"), (r"(\d{4})(\d\d)(\d\d)", "ymd"),
    *((rf"(\d{{1,2}}){mark}(\d{{1,2}}){mark}(\d{{4}})", "aby") for mark in ("-", r"\.", "/")),
    (rf"(\d{{1,2}})(?:st|nd|rd|th)?[ -]({_MONTHS})\.?[ -](\d{{4}})", "dny"), (rf"({_MONTHS})\.? {{1,2}}(\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})", "ndy"),
)
_DAY_NAME = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? "


def _instants_sql() -> str:
    x = "regexp_replace(regexp_replace(update_time, '\\s+$', ''), '(?i)^\\s*(?:[A-Za-z][A-Za-z ]*:\\s*|(?:posted|updated|published|last updated|as of)(?: on)?\\s+)?', '')"
    empty = "{'a': '', 'b': '', 'c': '', 'r': ''}"
    # A line break of a mail's form, day name first and year last, is written like the others.
    last = rf"regexp_replace(t, '(?i)^{_DAY_NAME}({_MONTHS})\.? {{1,2}}(\d{{1,2}}) (\d\d:\d\d:\d\d)((?: [A-Z]{{1,5}})?) (\d{{4}})$', '\1 \2, \5 \3\4')"
    dates = " ".join(rf"WHEN regexp_matches(t, '(?i)^{form}(?:$|[Tt, ])') THEN struct_pack(f := '{names}', v := regexp_extract(t, '(?i)^{form}(.*)$', ['a', 'b', 'c', 'r']))" for form, names in _DATE_FORMS)
    part = lambda name: "CASE f " + " ".join(f"WHEN '{n}' THEN v.{'abc'[n.index(name)]}" for n in ("ymd", "dny", "ndy") if name in n) + " END"
    months = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1))
    time = r"^(?:T|,? (?:at )?)(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?: ?([ap])(?:m|\.m\.)((?:[^a-z].*)?)|(.*))$"
    basic = r"^T(\d\d)(\d\d)(?:(\d\d)(?:[.,](\d+))?)?((?:z|[+-]\d\d:?(?:\d\d)?)?)$"
    zone = r"^ ?(?:(?:UTC|GMT)?([+\-−])(\d\d?):?(\d\d)?(?: ?\[[\w/+\-]+\]| ?\([^)]*\))?|([A-Za-z]{1,5})|\[?([A-Za-z_]+(?:/[A-Za-z_+\-]+)+)\]?)?$"
    abbreviations = ", ".join(f"('{a}', {m})" for a, m in ABBREVIATIONS.items())
    return rf"""
WITH z(abbr, minutes) AS (VALUES {abbreviations}),
t0 AS (SELECT j.id, {x} AS t, coalesce(b.zone_name, 'UTC') AS zone_name, coalesce(b.date_order, 'YMD') AS date_order FROM job_detail j LEFT JOIN board_ref b ON b.source = j.source WHERE update_time IS NOT NULL),
e0 AS (SELECT id, regexp_extract(t, '^([+-]?)(\d{{10,}})(?:[.,](\d+))?$', ['sign', 'n', 'f']) AS e FROM t0 WHERE regexp_matches(t, '^[+-]?\d{{10,}}(?:[.,]\d+)?$')),
e1 AS (SELECT id, CASE e.sign WHEN '-' THEN -1 ELSE 1 END * CASE WHEN length(e.n) <= 11 THEN try_cast(e.n AS BIGINT) * 1000 + rpad(left(e.f, 3), 3, '0')::BIGINT WHEN length(e.n) <= 14 THEN try_cast(e.n AS BIGINT) WHEN length(e.n) <= 17 THEN try_cast(e.n AS HUGEINT) // 1000 ELSE try_cast(e.n AS HUGEINT) // 1000000 END AS epoch_ms FROM e0),
t1 AS (SELECT * REPLACE (regexp_replace({last}, '(?i)^{_DAY_NAME}', '') AS t) FROM t0 WHERE id NOT IN (SELECT id FROM e0)),
t2 AS (SELECT *, CASE {dates} END AS fv FROM t1),
t3 AS (SELECT *, fv.f AS f, fv.v AS v FROM t2 WHERE fv IS NOT NULL),
t4 AS (SELECT id, zone_name, v.r AS r, CASE WHEN f = 'aby' THEN v.c ELSE {part("y")} END::INT AS y,
  CASE WHEN f = 'aby' THEN CASE WHEN date_order = 'MDY' THEN v.a WHEN date_order = 'DMY' OR try_cast(v.a AS INT) > 12 THEN v.b END WHEN f = 'ymd' THEN v.b END::INT AS m0, CASE left(lower({part("n")}), 3) {months} END AS mn,
  CASE WHEN f = 'aby' THEN CASE WHEN date_order = 'MDY' THEN v.b WHEN date_order = 'DMY' OR try_cast(v.a AS INT) > 12 THEN v.a END ELSE {part("d")} END::INT AS d FROM t3),
t5 AS (SELECT id, zone_name, r, try_cast(printf('%04d-%02d-%02d', y, coalesce(m0, mn), d) AS DATE) AS day, regexp_extract(r, '(?i){time}', ['h', 'mi', 's', 'f', 'ap', 'z', 'z2']) AS a, regexp_extract(r, '(?i){basic}', ['h', 'mi', 's', 'f', 'z']) AS b FROM t4),
t6 AS (SELECT id, zone_name, day, CASE WHEN b.h <> '' THEN {{'h': b.h, 'mi': b.mi, 's': b.s, 'f': b.f, 'ap': '', 'z': b.z}} ELSE {{'h': a.h, 'mi': a.mi, 's': a.s, 'f': a.f, 'ap': a.ap, 'z': a.z || a.z2}} END AS c, r FROM t5 WHERE day IS NOT NULL AND (r = '' OR a.h <> '' OR b.h <> '')),
t7 AS (SELECT id, zone_name, day, c, CASE WHEN c.ap = '' THEN CASE WHEN c.h = '' THEN 0 ELSE try_cast(c.h AS INT) END WHEN try_cast(c.h AS INT) BETWEEN 1 AND 12 THEN try_cast(c.h AS INT) % 12 + CASE lower(c.ap) WHEN 'p' THEN 12 ELSE 0 END END AS h, coalesce(nullif(c.mi, ''), '0')::INT AS mi, coalesce(nullif(c.s, ''), '0')::INT AS s,
  rpad(left(c.f, 3), 3, '0')::BIGINT AS ms, regexp_extract(c.z, '(?i){zone}', ['sign', 'oh', 'om', 'abbr', 'zone']) AS o FROM t6 WHERE regexp_matches(c.z, '(?i){zone}')),
t8 AS (SELECT *, day + to_hours(h) + to_minutes(mi) + to_seconds(s) AS local, CASE WHEN o.sign <> '' AND try_cast(o.oh AS INT) <= 18 AND coalesce(nullif(o.om, ''), '0')::INT <= 59 THEN (try_cast(o.oh AS INT) * 60 + coalesce(nullif(o.om, ''), '0')::INT) * CASE o.sign WHEN '+' THEN 1 ELSE -1 END WHEN o.abbr <> '' THEN (SELECT minutes FROM z WHERE z.abbr = upper(o.abbr)) END AS minutes,
  CASE WHEN o.sign = '' AND o.abbr = '' THEN coalesce(nullif(o.zone, ''), zone_name) END AS named FROM t7 WHERE h <= 23 AND mi <= 59 AND s <= 59),
t9 AS (SELECT *, CASE WHEN named IN (SELECT name FROM pg_timezone_names()) THEN timezone(named, local) END AS inst FROM t8)
SELECT id, epoch_ms::BIGINT AS epoch_ms FROM e1 UNION ALL
SELECT id, CASE WHEN minutes IS NOT NULL THEN epoch_ms(local) - minutes * 60000 WHEN timezone(named, inst - INTERVAL 1 HOUR) = local THEN epoch_ms(inst) - 3600000 ELSE epoch_ms(inst) END + ms AS epoch_ms FROM t9 WHERE minutes IS NOT NULL OR inst IS NOT NULL
"""


# The SQL reads the first figure or range with one expression, and looks for the
# currency and the period on their own.


def _pay_sql() -> str:
    either = lambda words: "|".join(re.escape(w).replace("'", "''").replace("\\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w)))
    as_map = lambda table: "MAP {" + ", ".join(f"'{w.lower()}': '{code}'" for code, words in table.items() for w in words) + "}"
    scales = "MAP {" + ", ".join(f"'{w}': {n}" for w, n in SCALE_WORDS.items()) + "}"
    words = [w for ws in CURRENCY_WORDS.values() for w in ws]
    symbols, named = [w for w in words if not w.isalpha() and " " not in w], [w for w in words if w.isalpha() or " " in w]
    currency = rf"(?:{either(symbols)}|(?:^|[^\pL])(?:{either(named)})(?:$|[^\pL]))"
    periods = [w for ws in PERIOD_WORDS.values() for w in ws]
    alone = [w for w in periods if w not in NEEDS_LEAD]
    number = r"\d{1,3}(?:[ \x{A0}\x{202F}]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[''’]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*"
    scale = rf"(?:\s*({either(SCALE_WORDS)})(?:$|[^\pL]))?"
    money = rf"(?:\s*(?:{either(words)}))?"
    figure = rf"({number})(?:\s*({either(SCALE_WORDS)})\b)?{money}(?:\s*(?:[-–—~‒−]|\b(?:to|bis|do|until|through|and)\b)\s*(?:(?:{either(words)})\s*)?({number})(?:\s*({either(SCALE_WORDS)})\b)?)?(.*)$"
    plain = lambda x: rf"regexp_replace({x}, '[''’\s\x{{A0}}\x{{202F}}]', '', 'g')"

    def value(x: str) -> str:
        t, marks = plain(x), f"regexp_extract_all({x}, '[.,]')"
        whole = f"regexp_matches({t}, '[.,]\\d{{3}}$') AND CASE WHEN len({marks}) > 1 THEN {marks}[1] = {marks}[-1] OR NOT starts_with({t}, '0') ELSE NOT starts_with({t}, '0') END"
        return f"try_cast(CASE WHEN {whole} THEN regexp_replace({t}, '[.,]', '', 'g') ELSE regexp_replace(regexp_replace({t}, '[.,](\\d*)$', '~\\1'), '[.,]', '', 'g').replace('~', '.') END AS DOUBLE)"

    subject, thing, place, said = (x.replace("'", "''") for x in STATEMENT_PARTS)
    statement = rf"(?i)[^.\n]*\b(?:{thing} in the {subject} field|{subject} {thing}|{subject})(?: {place})*(?: ?:| (?:is|are|means?)\b| {said}\b| in\b)[^.\n]*"
    money_in = lambda x: rf"regexp_extract({x}, '(?i)(?:^|[^\pL])({either(named)})(?:$|[^\pL])|([€£₹$])', ['a', 'b'])"
    period_in = rf"(?i)(?:^|[^\pL])({either([w for w in periods if len(w) > 2 and w not in ('hour', 'days')])}|hour)(?:$|[^\pL])"
    return rf"""
WITH money AS (SELECT {as_map(CURRENCY_WORDS)} AS m), time AS (SELECT {as_map(PERIOD_WORDS)} AS m), scales AS (SELECT {scales} AS m),
s0 AS (SELECT id, job_desc, regexp_replace(salary, '(?is)\s(?:\+|plus|incl\b|including|excl\b|and (?:a )?bonus|zzgl\b).*$|[;,]\s+\d+\s*(?:days?|weeks?|hours?|%).*$|\([^)]*\)|\b\d+(?:[.,]\d+)?\s*%.*$', ' ', 'g') AS t FROM job_detail WHERE regexp_matches(salary, '\d')),
s1 AS (SELECT id, job_desc, t, regexp_extract(t, '(?is){figure}', ['a', 'ka', 'b', 'kb', 'r']) AS f, trim(lower(regexp_replace(regexp_extract(t, '(?i){currency}'), '^[^\pL$€£₹]+|[^\pL$€£₹.]+$', '', 'g'))) AS cur FROM s0),
s2 AS (SELECT *, {value("f.a")} AS low0, {value("f.b")} AS high0, (SELECT m[lower(f.ka)] FROM scales) AS k, (SELECT m[lower(f.kb)] FROM scales) AS q,
  coalesce((SELECT m[cur] FROM money), CASE WHEN regexp_matches(lower(f.ka || ' ' || f.kb), 'la[kc]|lpa|cr') THEN 'INR' END) AS currency,
  lower(regexp_extract(' ' || f.r, '(?i)(?:/\s*|(?:^|[^\pL])(?:per|an|a|each|every|pro|im|am|al|por|par|na|de)\s+|de\s+l[''’])({either(periods)})(?:$|[^\pL])|(?:^|[^\pL])({either(alone)})(?:$|[^\pL])', ['a', 'b']).a) AS led,
  lower(regexp_extract(' ' || f.r, '(?i)(?:^|[^\pL])({either(alone)})(?:$|[^\pL])', 1)) AS bare FROM s1 WHERE f.a <> ''),
s3 AS (SELECT id, job_desc, t, low0, coalesce(high0, low0) AS high0, high0 IS NULL AS single, k, CASE WHEN high0 IS NULL THEN k ELSE q END AS q, currency, coalesce((SELECT m[led] FROM time), (SELECT m[bare] FROM time), CASE WHEN regexp_matches(lower(f.ka || ' ' || f.kb), 'lpa') THEN 'year' END) AS period FROM s2),
s4 AS (SELECT *, CASE WHEN k IS NULL AND q IS NOT NULL AND low0 <= high0 THEN q ELSE k END AS k1 FROM s3),
s5 AS (SELECT *, low0 * coalesce(k1, 1) AS a, high0 * coalesce(CASE WHEN q IS NULL AND k1 IS NOT NULL AND high0 < low0 * k1 THEN k1 ELSE q END, 1) AS b FROM s4
  WHERE currency IS NOT NULL OR NOT regexp_matches(t, '(?i)\b(?:401\s?k|equity|bonus|unpaid|trial|leave|holidays?|vacation|pension|stipend|budget|options)\b')),
s6 AS (SELECT *, CASE WHEN currency IS NULL AND period IS NULL THEN list_filter(regexp_extract_all(job_desc, '{statement}'), lambda x: {money_in("x")}.a <> '' OR {money_in("x")}.b <> '')[1] END AS told FROM s5),
s7 AS (SELECT id, a, b, coalesce(currency, (SELECT m[lower({money_in("told")}.a || {money_in("told")}.b)] FROM money)) AS currency, coalesce(period, (SELECT m[lower(regexp_extract(told, '{period_in}', 1))] FROM time), 'year') AS period FROM s6)
SELECT id, floor(round(least(a, b) * c.factor * p.factor, 6) + 0.5)::BIGINT AS low_usd, floor(round(greatest(a, b) * c.factor * p.factor, 6) + 0.5)::BIGINT AS high_usd
FROM s7 JOIN unit_ref c ON c.unit_kind = 'currency' AND c.unit_code = currency JOIN unit_ref p ON p.unit_kind = 'period' AND p.unit_code = period
"""


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p7_found": p7_found}
ORACLE = {"p5_found": f"WITH {values_sql(2)} SELECT id, pos, piece FROM cut", "p3_found": _pay_sql(), "p7_found": _instants_sql()}
