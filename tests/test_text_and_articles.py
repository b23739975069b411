"""Cleaning, articles and feeds on literal inputs."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from vecflow.functions import text as T
from vecflow.sources import html


@pytest.fixture(scope="module")
def clean(spark):
    def run(build, *given):
        rows = spark.createDataFrame(list(enumerate(given)), "i int, t string")
        return [r.r for r in rows.select("i", build(F.col("t")).alias("r")).orderBy("i").collect()]

    return run


def test_composed_form(clean):
    given = ["é", "가", "Å", "plain", "", None, "tiếng Việt", "क़"]
    assert clean(T.nfc, *given) == [t if t is None else unicodedata.normalize("NFC", t) for t in given]


def test_markup_is_taken_out_by_a_parser(clean):
    given = ["<p>a &amp; b</p><!-- gone -->c", "1 < 2", "no brackets &amp; stay", "<script>x=1</script>y", "<b>é</b>", "a<br/>b > c", None]
    assert clean(T.normal, *given) == ["a & b c", "1 < 2", "no brackets &amp; stay", "x=1 y", "é", "a b > c", None]


def test_the_whole_chain(clean):
    given = ["  <p>Xin  chào</p> https://x.vn/a?b WWW.y.vn/1 (100%) #ok_1, thế!\x1c?", None, "", "tiếng <i>Việt</i>"]
    assert clean(T.cleaned, *given) == ["Xin chào 100 ok_1, thế! ?", "", "", "tiếng Việt"]
    assert clean(lambda c: T.cleaned(c, urls=False, special=False), "a http://b  (c)") == ["a http://b (c)"]


def test_first_category_wins(clean):
    got = clean(T.category, "Ngân hàng và bệnh viện", "bệnh viện", "robot ở trường học", "không có gì", "GIAO THÔNG")
    assert got == ["Kinh doanh & Tài chính", "Y tế & Sức khỏe", "Khoa học & Công nghệ", "Văn hóa & Đời sống", "Giao thông & Xây dựng"]


LONG = "a paragraph that is long enough "


def test_places_of_articles_in_order():
    page = f"<html><head><title>T</title><meta property='og:description' content=' S '></head><body><main><p>{LONG} main</p></main><div class='x entry-content'><p>{LONG} entry</p></div></body></html>"
    got = html.parse_article(page)
    assert got == {"title": "T", "summary": "S", "content": f"T\n\nS\n\n{LONG} entry"}
    got = html.parse_article(page.replace("<main>", "<article>").replace("</main>", "</article>"))
    assert got["content"].endswith("main")
    got = html.parse_article(f"<div itemprop='articleBody'><p>{LONG} <b>one</b>\n</p><p>Nguồn: somewhere in the world at large</p></div><p>{LONG} outside</p>", "F", "G")
    assert got == {"title": "F", "summary": "G", "content": f"F\n\nG\n\n{LONG.strip()} one"}


def test_titles_summaries_and_what_is_left_out():
    page = f"<meta property='og:title' content='O'><p class='Sapo big'>{LONG} lead</p><aside><p>{LONG} aside</p></aside><figure><p>{LONG} figure</p></figure><p>{LONG} body</p><p>short</p>"
    got = html.parse_article(page)
    assert got["title"] == "O" and got["summary"] == f"{LONG} lead" and "aside" not in got["content"] and "figure" not in got["content"]
    assert got["content"].count("lead") == 2 and got["content"].endswith("body")
    assert html.parse_article(None, "t", "s") == {"title": "t", "summary": "s", "content": "t\n\ns"} and html.parse_article("<p>") == {"title": "", "summary": "", "content": ""}
    assert html.parse_article("<h1>a <b>b</b></h1><title>c</title>")["title"] == "ab"


def test_plainer_extraction():
    page = f"<nav><p>{LONG}</p></nav><div class='fck_detail'><p>{LONG} one</p><p>tiny</p></div><p>{LONG} two</p>"
    assert html.parse_body(page) == f"{LONG} one" and html.parse_body(None) == "" and html.parse_body(f"<p>{LONG}</p>") == ""
    assert html.parse_body(f"<body><p>{LONG} x<p>{LONG} y</body>").count("\n") == 1


def test_feeds(spark):
    feed = "<rss><channel><item><title>a & b</title><link> u </link><description>&lt;b&gt;c&lt;/b&gt;  d</description><guid>g</guid></item><item><title>only</title></item></channel></rss>"
    rows = spark.createDataFrame([("f", feed), ("g", "<broken"), ("h", None), ("i", "")], "feed_url string, xml string")
    got = [tuple(r) for r in html.rss_items(rows).collect()]
    assert got == [("f", "a & b", "u", "c d", "g", "")]
    assert sorted(r.title for r in html.rss_items(rows, titled=True).collect()) == ["a & b", "only"]
