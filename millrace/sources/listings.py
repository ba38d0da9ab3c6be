"""Extractors that turn fetched pages and feeds into listings."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.arrowmap import arrow_map

BASE_URL = "https://remoteok.com"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements that an opening tag ends, up to the elements they can't leave.
_ENDS = {
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "li": ({"li"}, {"ul", "ol"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
    **{t: ({"p"}, {"td", "li", "div", "body"}) for t in ("p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4")},
}


class Node:
    """An element with its attributes and children (elements and texts)."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)

    def all(self, tag: str | None = None, cls: str | None = None) -> list[Node]:
        """Descendants in document order."""
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if not isinstance(x, str):
                if (tag is None or x.tag == tag) and (cls is None or cls in x.classes):
                    out.append(x)
                todo.extend(reversed(x.children))
        return out

    def first(self, tag: str | None = None, cls: str | None = None) -> Node | None:
        return next(iter(self.all(tag, cls)), None)


class _Builder(HTMLParser):
    """A lenient tree: unclosed cells, rows, items and paragraphs end by themselves."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self._open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends, within = _ENDS.get(tag, (set(), set()))
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag in within:
                break
            if self._open[i].tag in ends:
                del self._open[i:]
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self._open[-1].children.append(node)
        if tag not in _VOID:
            self._open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                del self._open[i:]
                return

    def handle_data(self, data):
        self._open[-1].children.append(data)


def parse_html(text: str) -> Node:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


def _trim(text: str) -> str:
    return text.strip(" \t\n\r\f\v\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


def html_text(fragment: str | None) -> str:
    """The text of every ``div`` of a fragment, each div on its own: the text of
    a nested one counts again."""
    root = parse_html(f"<div>{fragment or ''}</div>")
    return _trim("".join(d.text() for d in root.all("div")))


def listing_rows(page: str | None) -> list[dict]:
    """The listings of a page of job rows.

    A detail row is ``tr.expand`` with a ``data-id``; the header row
    ``tr.job-<id>`` of the same id gives link, title, places, time and tags.
    Detail rows without header give nothing, and neither does a row that can't
    be read. Of several places in a header the last is the pay.
    """
    if not page:
        return []
    text = _trim(page)
    root = parse_html(f"<table>{text}</table>" if text.startswith("<tr") else text)
    rows = root.all("tr")
    out = []
    for detail in rows:
        number = detail.attrs.get("data-id", "")
        if "expand" not in detail.classes or not number:
            continue
        headers = [r for r in rows if f"job-{number}" in r.classes]
        if not headers:
            continue
        within = lambda tag, cls=None: [x for h in headers for x in h.all(tag, cls)]
        titles = [h2 for cell in within("td", "company_and_position") for h2 in cell.all("h2")]
        body = detail.all("div", "html") or detail.all("div", "markdown")
        places = [_trim(p.text()) for p in within("div", "location")]
        time = next(iter(within("time")), None)
        out.append(
            {
                "title": _trim("".join(t.text() for t in titles)),
                "url": BASE_URL + headers[0].attrs.get("data-url", ""),
                "description": _trim("".join(b.text() for b in body)),
                "tags": [_trim(h3.text()) for cell in within("td", "tags") for h3 in cell.all("h3")],
                "location": ",".join(places[:-1]),
                "salary": places[-1] if places else "",
                "update_time": time.attrs.get("datetime", "") if time else "",
            }
        )
    return out


_FIELDS = ("title", "url", "description", "tags", "location", "salary", "update_time")
_SCHEMA = "title string, url string, description string, tags array<string>, location string, salary string, update_time string"


def listings_of_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The listings of a column of pages; null and empty pages give none."""

    def setup():
        def run(texts):
            found = [row for t in texts for row in listing_rows(t)]
            return [[row[f] for row in found] for f in _FIELDS]

        return run

    return arrow_map(pages.select(html), setup, _SCHEMA)


_ITEM = "title string, link string, region string, category array<string>, description string, pubDate string"


def listings_of_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """The listings of a column of RSS documents; one without items gives none.

    Tags are the words of the first category, an absent one counts as empty;
    the pay is empty; the description is the text of its markup.
    """
    items = feeds.select(F.explode(F.from_xml(F.col(xml), f"channel struct<item: array<struct<{_ITEM.replace(' string', ':string').replace(' array', ':array')}>>>")["channel"]["item"]).alias("i"))

    def setup():
        return lambda title, url, description, tags, location, salary, time: (title, url, [html_text(d) for d in description], tags, location, salary, time)

    empty = F.lit("")
    flat = items.select(
        F.coalesce("i.title", empty).alias("title"), F.coalesce("i.link", empty).alias("url"), "i.description",
        F.split(F.coalesce(F.get("i.category", F.lit(0)), empty), " ", -1).alias("tags"), F.coalesce("i.region", empty).alias("location"), empty.alias("salary"), F.coalesce("i.pubDate", empty).alias("update_time"),
    )
    return arrow_map(flat, setup, _SCHEMA)


def to_jobs(listings: DataFrame, source: str, today: str) -> DataFrame:
    """Listings as jobs: an id from the link, the source, and the UTC day of the
    time (``today`` where it can't be read)."""
    from millrace.functions.scalars import tags_json, utc_day

    return listings.select(
        F.sha2(F.col("url"), 256).alias("id"), "title", F.col("description").alias("job_desc"), tags_json(F.col("tags")).alias("job_tags"), F.col("url").alias("link"),
        F.lit(source).alias("source"), "location", "salary", utc_day(F.col("update_time"), today).alias("update_time"), F.lit(None).cast("string").alias("vectorize_id"),
    )


def union_with_failures(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetched documents ``(url, body, error)`` as those that came and those that failed."""
    return outcomes.where("error is null"), outcomes.where("error is not null").select("url", "error")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder as uploads; the name without its ending is the telegram_id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return uploaded_texts(files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("telegram_id"), F.lit("text/plain").alias("mime"), "content"))


def uploaded_texts(files: DataFrame) -> DataFrame:
    """Uploads ``(telegram_id, mime, content)`` that are text and not empty, decoded."""
    ok = files.where(F.col("mime").startswith("text/") & (F.length("content") > 0))
    return ok.select("telegram_id", F.decode(F.col("content"), "UTF-8").alias("resume"))
