"""Queries over pages: H1 to H8, H10, H12, H14 to H16, S1."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellquery.catalog import inputs
from cellquery.catalog.registry import Registry, table
from cellquery.functions import text
from cellquery.operators import sections, tables
from cellquery.sources.files import read_pages

QUERIES = Registry()
query = QUERIES.query


@query("s1_read_pages", "SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def s1_read_pages(spark, folder):
    return read_pages(spark, f"{folder}/pages.parquet").select("page_id", "url", F.md5("html").alias("html_md5"))


@query("h1_normalize_dash", "SELECT page_id, md5(replace(replace(html, '/', '–'), '–', '-')) AS html_md5 FROM pages")
def h1_normalize_dash(spark, folder):
    dashed = F.replace("html", F.lit("/"), F.lit("–"))
    return table(spark, folder, "pages").select("page_id", F.md5(text.normalize_dash(dashed)).alias("html_md5"))


def _doc_html(spark, folder):
    """Two sections with the language as id around a skipped one, and a last section."""
    html = F.concat(
        F.lit('<p id="lead">x</p><h2 class="t" id="'), "lang", F.lit('">A</h2>'), "text",
        F.lit('<h2 id="mw-fr-revisionratings-box">S</h2>s<h2 id="'), "lang", F.lit('"><i>B</i></h2>'), "source",
        F.lit("<h2>no id<h2>end</h2>last"),
    )
    return table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))


@query(
    "h2_h3_sections",
    """SELECT doc_id AS page_id, 0 AS section_idx, lang AS section_id, md5(text) AS content_md5 FROM documents
    UNION ALL SELECT doc_id, 1, 'mw-fr-revisionratings-box', md5('s') FROM documents
    UNION ALL SELECT doc_id, 2, lang, md5(source) FROM documents
    UNION ALL SELECT doc_id, 3, NULL, md5('>no id') FROM documents""",
)
def h2_h3_sections(spark, folder):
    return sections.sections(_doc_html(spark, folder)).select(
        "page_id", "section_idx", "section_id", F.md5("content").alias("content_md5")
    )


@query(
    "h4_skip_sections",
    """SELECT doc_id AS page_id, 0 AS section_idx, lang AS section_id FROM documents
    UNION ALL SELECT doc_id, 2, lang FROM documents UNION ALL SELECT doc_id, 3, NULL FROM documents""",
)
def h4_skip_sections(spark, folder):
    cut = sections.sections(_doc_html(spark, folder)).select("page_id", "section_idx", "section_id")
    return sections.skip_sections(cut)


@query(
    "h5_remove_citations",
    "SELECT doc_id, md5('<p>' || replace(text, '&', '&amp;') || '</p>') AS html_md5 FROM documents",
)
def h5_remove_citations(spark, folder):
    cite = '.<sup class="reference" id="c"><a href="#n">[<b>1</b>]</a></sup><i class="x cite-bracket">[2]</i> '
    html = F.concat(F.lit("<p>"), F.replace("text", F.lit(". "), F.lit(cite)), F.lit("</p>"))
    return table(spark, folder, "documents").select("doc_id", F.md5(tables.remove_citations(html)).alias("html_md5"))


_SPANS = "array_to_string(regexp_extract_all({html}, '(?s)<p.*?{end}'), ' ')"


def _spans(html: str, end: str) -> str:
    joined = _SPANS.format(html=html, end=end)
    return inputs.sql_strip(f"replace(replace({joined}, '<p>', ''), '</p>', '')")


_TAGLESS = f"regexp_replace({_spans('html', '(?:</p>|$)')}, '<.*?>', '', 'g')"


def _points(x: str) -> str:
    return rf"regexp_replace({x}, '(-?\p{{Nd}}+),(\p{{Nd}}+)', '\1.\2', 'g')"



@query("h6_paragraph", f"SELECT page_id, {_points(_TAGLESS)} AS paragraph FROM pages")
def h6_paragraph(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.paragraph(F.col("html")).alias("paragraph"))


@query("h7_strip_tags", "SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS stripped FROM pages")
def h7_strip_tags(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.strip_tags(F.col("html")).alias("stripped"))


@query(
    "h8_decimal_comma",
    "SELECT doc_id, " + _points("replace(text, '.', ',')") + " AS pointed FROM documents",
)
def h8_decimal_comma(spark, folder):
    commas = F.replace("text", F.lit("."), F.lit(","))
    return table(spark, folder, "documents").select("doc_id", text.decimal_comma_to_point(commas).alias("pointed"))


_CHUNKS = """chunks AS (SELECT page_id, unnest(range(len(c)))  AS pos, unnest(c) AS chunk
  FROM (SELECT page_id, string_split(html, '<h1') AS c FROM pages)),
content AS (SELECT page_id, pos, chunk, CASE WHEN contains(chunk, '</h1>')
  THEN substr(chunk, strpos(chunk, '</h1>') + 5) ELSE chunk END AS html,
  CASE WHEN contains(chunk, 'id="') THEN split_part(split_part(chunk, 'id="', 2), '"', 1) END AS section_id
  FROM chunks WHERE pos > 0)"""


@query(
    "h10_paragraphs_by_id",
    f"""WITH {_CHUNKS} SELECT page_id, section_id, arg_max({_spans('html', '</p>')}, pos) AS paragraph
    FROM content GROUP BY page_id, section_id""",
)
def h10_paragraphs_by_id(spark, folder):
    return sections.paragraphs_by_id(table(spark, folder, "pages"), tag="h1")


_LINE = "replace(replace(" + inputs.sql_strip("concat(text, chr(10), source)") + ", chr(10), ' '), '  ', ' ')"


@query(
    "h12_page_sentences",
    f"""SELECT doc_id AS page_id, unnest(range(len(s)))::INT AS sentence_idx, unnest(list_transform(s, lambda x: {inputs.sql_strip('x')})) AS sentence
    FROM (SELECT doc_id, string_split({_LINE}, '. ') AS s FROM documents)""",
)
def h12_page_sentences(spark, folder):
    body = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit(". "), F.lit("[12]. "))
    html = F.concat(F.lit("<div><h1>no</h1><p>"), body, F.lit("</p>no<p><b>"), "source", F.lit("</b></p></div>"))
    pages = table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return sections.page_sentences(pages)


_CANONICAL = """linked AS (SELECT page_id, CASE WHEN contains(url, '?') THEN split_part(url, '?', 1)
  ELSE 'https://hu.wikipedia.org/wiki/' || page_id END AS canonical_url, url FROM pages)"""


def _linked_pages(spark, folder):
    """Pages with a query string in their URL name the URL without it as canonical."""
    link = F.concat(F.lit('<link rel="canonical" href="'), F.split_part("url", F.lit("?"), F.lit(1)), F.lit('"/>'))
    html = F.when(F.contains("url", F.lit("?")), F.replace("html", F.lit("<title>"), F.concat(link, F.lit("<title>"))))
    page = table(spark, folder, "pages").select("page_id", "url", F.coalesce(html, "html").alias("html"))
    default = sections.page_url(F.col("page_id").cast("string"))
    return page.select("page_id", "url", sections.canonical_url(F.col("html"), default).alias("canonical_url"))


@query("h14_canonical_url", f"WITH {_CANONICAL} SELECT page_id, canonical_url FROM linked")
def h14_canonical_url(spark, folder):
    return _linked_pages(spark, folder).select("page_id", "canonical_url")


_KNOWN = "(SELECT canonical_url FROM linked WHERE starts_with(url, 'http://'))"


def _known(pages):
    return pages.filter(F.startswith("url", F.lit("http://")))


@query("h14_known_pages", f"WITH {_CANONICAL} SELECT page_id, canonical_url FROM linked WHERE canonical_url IN {_KNOWN}")
def h14_known_pages(spark, folder):
    pages = _linked_pages(spark, folder)
    return sections.known_pages(pages, _known(pages)).select("page_id", "canonical_url")


@query("h14_drop_known", f"WITH {_CANONICAL} SELECT page_id, canonical_url FROM linked WHERE canonical_url NOT IN {_KNOWN}")
def h14_drop_known(spark, folder):
    pages = _linked_pages(spark, folder)
    return sections.drop_known(pages, _known(pages)).select("page_id", "canonical_url")


@query(
    "h15_next_titles",
    """WITH found AS (SELECT c_name AS title FROM customer WHERE c_name >= 'Customer#000000100' ORDER BY title LIMIT 500)
    SELECT title, title = (SELECT max(title) FROM found) AS is_next_start FROM found""",
)
def h15_next_titles(spark, folder):
    titles = table(spark, folder, "customer").select(F.col("c_name").alias("title"))
    return sections.next_titles(titles, "Customer#000000100")


@query(
    "h15_title_batches",
    "SELECT c_name AS title, (row_number() OVER (ORDER BY c_name) - 1) // 499 AS batch FROM customer",
)
def h15_title_batches(spark, folder):
    return sections.title_batches(table(spark, folder, "customer").select(F.col("c_name").alias("title")))


_LAST = "replace(split_part(url_decode(replace(url, '#', '/Gy%C5%91r+–%20%C5%B1')), '/', -1), '–', '-')"


@query(
    "h16_table_id",
    rf"SELECT page_id, regexp_replace({_LAST}, '[^\x00-\x7F]', '?', 'g') || '_Történelem_' || page_id AS table_id FROM pages",
)
def h16_table_id(spark, folder):
    url = F.replace("url", F.lit("#"), F.lit("/Gy%C5%91r+–%20%C5%B1"))
    name = sections.table_id(url, F.lit("Történelem"), F.col("page_id"))
    return table(spark, folder, "pages").select("page_id", name.alias("table_id"))
