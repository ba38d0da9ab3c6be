import pytest

from millrace.sources import http
from millrace.sources import listings as L

PAGE = """<html><body><table>
<tr class="job job-1" data-url="/remote-jobs/1"><td class="company_and_position"><h2> Data Engineer </h2><div class="location">Berlin</div><div class="location">Lisbon</div><div class="location">$90k</div>
<td class="tags"><h3> python </h3><h3>spark</h3></td><td><time datetime="2024-03-05T10:00:00+00:00">1d</time></td></tr>
<tr class="expand" data-id="1"><td><div class="html"></div><div class="markdown">ignored</div></td></tr>
<tr class="job job-2" data-url="/remote-jobs/2"><td class="company_and_position"><h2>QA<td><div class="location">only</div>
<tr class="expand" data-id="2"><td><div class="markdown">Test <b>things</b><br>now</div>
<tr class="expand" data-id="3"><td><div class="html">no header</div></td></tr>
<tr class="expand"><td><div class="html">no id</div></td></tr>
</table></body></html>"""


def test_page():
    a, b = L.listing_rows(PAGE)
    assert a == {"title": "Data Engineer", "url": L.BASE_URL + "/remote-jobs/1", "description": "", "tags": ["python", "spark"], "location": "Berlin,Lisbon", "salary": "$90k", "update_time": "2024-03-05T10:00:00+00:00"}
    assert (b["title"], b["description"], b["location"], b["salary"], b["update_time"], b["tags"]) == ("QA", "Test thingsnow", "", "only", "", [])


@pytest.mark.parametrize("page", [None, "", "  ", "<p>nothing", "<tr class='expand'>"])
def test_pages_without_listings(page):
    assert L.listing_rows(page) == []


def test_bare_rows_are_wrapped():
    rows = L.listing_rows("  <tr class='job-7' data-url='/x'><td class='company_and_position'><h2>T</h2></td></tr><tr class='expand' data-id='7'><td></td></tr>")
    assert [(r["title"], r["salary"]) for r in rows] == [("T", "")]


def test_nested_divs_count_again():
    assert L.html_text("a <div>b</div>") == "a bb"
    assert L.html_text(None) == ""


def test_pages_and_jobs(spark, rows):
    pages = spark.createDataFrame([(PAGE,), (None,), ("",)], "html string")
    found = L.listings_of_pages(pages)
    jobs = L.to_jobs(found, "board", "2024-03-31")
    assert rows(jobs, "title", "source", "update_time", "job_tags") == [("Data Engineer", "board", "2024-03-05", '["python","spark"]'), ("QA", "board", "2024-03-31", "[]")]


def test_feeds(spark, rows):
    item = "<item><title>T{0}</title><link>https://x.example/{0}</link>{1}<description><![CDATA[<p>Hi</p> <div>there</div>]]></description><pubDate>Tue, 05 Mar 2024 23:11:12 -0500</pubDate></item>"
    feed = lambda *items: "<rss><channel><title>c</title>" + "".join(items) + "</channel></rss>"
    one = feed(item.format(1, "<region>Anywhere</region><category>Full  Stack</category>"))
    two = feed(item.format(2, ""), item.format(3, "<category>A</category><category>B</category>"))
    got = rows(L.listings_of_feeds(spark.createDataFrame([(one,), (two,), (feed(),), (None,)], "xml string")), "title", "tags", "location", "description", "salary")
    assert got == [("T1", ["Full", "", "Stack"], "Anywhere", "Hi therethere", ""), ("T2", [""], "", "Hi therethere", ""), ("T3", ["A"], "", "Hi therethere", "")]


def test_uploads(spark, rows):
    files = spark.createDataFrame([("1", "text/plain", b"cv"), ("2", "image/png", b"x"), ("3", "text/plain", b"")], "telegram_id string, mime string, content binary")
    assert rows(L.uploaded_texts(files)) == [("1", "cv")]


def test_documents_source(spark, tmp_path):
    good = tmp_path / "a.html"
    good.write_text("<p>hi</p>")
    http.register(spark)
    df = spark.read.format("documents").option("urls", f"file://{good} file://{tmp_path}/missing").load()
    came, failed = L.union_with_failures(df)
    assert [r["body"] for r in came.collect()] == ["<p>hi</p>"]
    assert failed.count() == 1
    with pytest.raises(http.AllSourcesFailed):
        http.checked(["x"], 0)
    http.checked(["x"], 1)
