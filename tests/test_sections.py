"""Splitting pages, section ids, paragraphs and tables by id, page sentences, table names."""

from pyspark.sql import functions as F

from cellquery.functions import text
from cellquery.operators import sections

PAGE = (
    'lead<h2 class="c" id="a">A</h2><p>one<p>tail'
    '<h2>no id</h2><p>two</p>'
    '<h2 id="b">never closed <p>three</p>'
    '<h2 id="a">A again</h2><p class="x">four</p> and <p>fi<b>ve</b></p>'
    '<h2 id="z">Z</h2><p>last</p>'
)


def pages(spark, *htmls):
    rows = [(i, f"https://x/{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_sections(spark):
    def cut(df, **options):
        found = sections.sections(df, **options).orderBy("page_id", "section_idx")
        return [(r["section_idx"], r["section_id"], r["content"]) for r in found.collect()]

    got = cut(pages(spark, PAGE))
    assert got == [
        (0, "a", "<p>one<p>tail"),
        (1, None, "<p>two</p>"),
        (2, "b", ' id="b">never closed <p>three</p>'),
        (3, "a", '<p class="x">four</p> and <p>fi<b>ve</b></p>'),
    ]
    assert cut(pages(spark, PAGE), drop_last=False) == [*got, (4, "z", "<p>last</p>")]
    assert cut(pages(spark, "no heading", "<h2>only</h2>x")) == []
    assert cut(pages(spark, "no heading", "<h2>only</h2>x"), drop_last=False) == [(0, None, "x")]


def test_skip_list_as_values_and_as_table(spark):
    df = spark.createDataFrame([("a",), ("Kapcsolódó_szócikkek",), (None,)], "section_id string")
    assert [r[0] for r in sections.skip_sections(df).collect()] == ["a", None]
    listed = spark.createDataFrame([("a",), ("a",)], "section_id string")
    kept = sections.skip_sections(df, listed).collect()
    assert sorted(str(r["section_id"]) for r in kept) == ["Kapcsolódó_szócikkek", "None"]


def test_paragraphs_by_id(spark):
    got = {r["section_id"]: r["paragraph"] for r in sections.paragraphs_by_id(pages(spark, PAGE)).collect()}
    assert got == {"a": '<p class="x">four fi<b>ve</b>', None: "two", "b": "three", "z": "last"}


def test_tables_by_id_keeps_last_with_tables(spark):
    table = "<table><tr><td>{}</td></tr></table>"
    html = "".join(
        f'<h2 id="{i}">t</h2>{body}'
        for i, body in (("a", table.format(1)), ("b", "none"), ("a", table.format(2) + table.format(3)), ("a", "none"))
    )
    got = sections.tables_by_id(pages(spark, html)).orderBy("table_idx").collect()
    assert [(r["section_id"], r["table_idx"], r["cell"]) for r in got] == [("a", 0, "2"), ("a", 1, "3")]


def test_read_sections(spark):
    html = (
        '<h2 id="a">A</h2><p>1990–91<sup class="reference">[1]</sup> 5,5&nbsp;m &lt;b&gt;</p><p>unclosed <i>tail'
        '<h2 id="mw-fr-revisionratings-box">S</h2><p>no</p><h2 id="z">Z</h2>'
    )
    row = sections.read_sections(pages(spark, html)).collect()
    assert len(row) == 1
    assert row[0]["paragraph"] == "1990-91 5.5\xa0m &lt;b&gt; unclosed tail"
    assert row[0]["tables"] == [] and "html" not in row[0].asDict()


def test_page_sentences(spark):
    html = "<h1>t</h1><p>One[12]  two. Three\n</p><div>no</div><p>Four. five</p>"
    got = sections.page_sentences(pages(spark, html)).orderBy("sentence_idx").collect()
    assert [r["sentence"] for r in got] == ["One two", "Three Four", "five"]


def test_table_id(spark):
    urls = {
        "https://hu.wikipedia.org/wiki/Győr": "Gy?r_Történelem_0",
        "https://hu.wikipedia.org/wiki/Gy%C5%91r": "Gy?r_Történelem_0",
        "https://hu.wikipedia.org/wiki/A+B–C": "A+B-C_Történelem_0",
        "https://hu.wikipedia.org/wiki/100%": "100%_Történelem_0",
    }
    df = spark.createDataFrame(list(urls.items()), "url string, expected string")
    got = df.select("url", sections.table_id(F.col("url"), F.lit("Történelem"), F.lit(0)).alias("id")).collect()
    assert {r["url"]: r["id"] for r in got} == urls


def test_tail_rule_of_paragraphs(spark):
    df = spark.createDataFrame([("<pre>a</p>b<p>c",)], "h string")
    assert df.select(text.paragraph_spans(F.col("h"), keep_tail=True)).first()[0] == "<pre>a c"
    assert df.select(text.paragraph_spans(F.col("h"), keep_tail=False)).first()[0] == "<pre>a"
