"""Pages to sections, paragraphs, sentences, URLs and titles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellquery.functions import text
from cellquery.functions.fragments import ParagraphTexts
from cellquery.operators.numbering import dense_number
from cellquery.operators.tables import explode_tables, read_fragments, type_cells

# Section ids that are not content.
SKIPPED_SECTIONS = ["Kapcsolódó_szócikkek", "mw-fr-revisionratings-box"]


def sections(pages: DataFrame, tag: str = "h2", drop_last: bool = True) -> DataFrame:
    """Chunks of ``html`` between headings: ``section_idx, section_id, content`` beside the page columns.

    What precedes the first heading is never a section; ``drop_last`` also leaves the last one out.
    The id is the first ``id="`` after the heading starts (null if none); the content follows the
    first closing tag (the whole chunk if none).
    """
    rest = [c for c in pages.columns if c != "html"]
    close = f"</{tag}>"
    chunks = pages.select(*rest, F.split("html", rf"\Q<{tag}\E").alias("_chunks"))
    n = F.greatest(F.size("_chunks") - (2 if drop_last else 1), F.lit(0))
    chunk = F.col("_chunk")
    close_at = F.locate(close, chunk)
    return chunks.select(
        *rest, F.posexplode(F.slice("_chunks", F.lit(2), n)).alias("section_idx", "_chunk")
    ).select(
        *rest,
        "section_idx",
        F.when(
            chunk.contains('id="'),
            F.split_part(F.split_part(chunk, F.lit('id="'), F.lit(2)), F.lit('"'), F.lit(1)),
        ).alias("section_id"),
        F.when(close_at > 0, F.substring(chunk, close_at + len(close), F.length(chunk)))
        .otherwise(chunk)
        .alias("content"),
    )


def skip_sections(df: DataFrame, ids: list[str] | DataFrame = SKIPPED_SECTIONS) -> DataFrame:
    """Drop sections with a listed id; a long list can come as a DataFrame with ``section_id``."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("section_id").distinct(), "section_id", "left_anti")
    return df.filter(F.col("section_id").isNull() | ~F.col("section_id").isin(ids))


def read_sections(pages: DataFrame) -> DataFrame:
    """Sections with their ``paragraph`` and nested ``tables``, from pages with ``page_id, url, html``."""
    cut = skip_sections(sections(pages.withColumn("html", text.normalize_dash(F.col("html")))))
    read = read_fragments(cut, "content")
    return read.withColumn("paragraph", text.paragraph(F.col("clean_html"))).drop("clean_html")


def paragraphs_by_id(pages: DataFrame, tag: str = "h2") -> DataFrame:
    """``page_id, section_id, paragraph`` of all sections; a repeated id keeps its last section."""
    cut = sections(pages.select("page_id", "html"), tag, drop_last=False).select(
        "page_id",
        "section_id",
        "section_idx",
        text.paragraph_spans(F.col("content"), keep_tail=False).alias("paragraph"),
    )
    return cut.groupBy("page_id", "section_id").agg(
        F.max_by("paragraph", "section_idx").alias("paragraph")
    )


def tables_by_id(pages: DataFrame) -> DataFrame:
    """Typed cells by ``page_id, section_id``; a repeated id keeps its last section that has tables."""
    cut = sections(pages.select("page_id", "html"), drop_last=False)
    read = read_fragments(cut, "content", clean=False).filter(F.size("tables") > 0)
    last = read.groupBy("page_id", "section_id").agg(F.max_by("tables", "section_idx").alias("tables"))
    return type_cells(explode_tables(last))


@F.pandas_udf(T.StringType())
def _paragraph_text(html: pd.Series) -> pd.Series:
    return html.map(
        lambda page: "\n".join("".join(t) for t in ParagraphTexts().read(page).texts),
        na_action="ignore",
    )


def page_sentences(pages: DataFrame) -> DataFrame:
    """``page_id, sentence_idx, sentence`` over the text of all ``p`` elements of a page."""
    marks = F.regexp_replace(_paragraph_text("html"), r"(?U)\[\d+\]", "")
    line = F.replace(text.strip(marks), F.lit("\n"), F.lit(" "))
    single = F.replace(line, F.lit("  "), F.lit(" "))
    return pages.select(
        "page_id", F.posexplode(F.split(single, r"\. ")).alias("sentence_idx", "sentence")
    ).withColumn("sentence", text.strip(F.col("sentence")))


# -- URLs and titles ---------------------------------------------------------------------------


def page_url(title: Column, lang: str = "hu") -> Column:
    return F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), title)


def canonical_url(html: Column, default: Column) -> Column:
    """``href`` of the page's canonical link, else ``default``."""
    link = F.regexp_extract(html, r"(?i)<link\s[^>]*?rel=[\"']?canonical\b[^>]*>", 0)
    href = F.regexp_extract(link, r"(?i)\shref=(?:\"([^\"]*)\"|'[^']*')", 1)
    single = F.regexp_extract(link, r"(?i)\shref='([^']*)'", 1)
    found = F.coalesce(F.nullif(href, F.lit("")), F.nullif(single, F.lit("")))
    return F.coalesce(F.replace(found, F.lit("&amp;"), F.lit("&")), default)


def known_pages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages whose ``canonical_url`` is among the known ones."""
    return pages.join(known.select("canonical_url").distinct(), "canonical_url", "left_semi")


def drop_known(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages whose ``canonical_url`` is not among the known ones."""
    return pages.join(known.select("canonical_url").distinct(), "canonical_url", "left_anti")


def next_titles(titles: DataFrame, start: str, n: int = 500) -> DataFrame:
    """``title, is_next_start``: the first ``n`` titles from ``start`` on.

    The last of ``n`` is where the next call starts, so only the others belong to this batch.
    """
    found = titles.filter(F.col("title") >= start).orderBy("title").limit(n)
    last = found.agg(F.max("title").alias("_last"))
    return found.select("title", (F.col("title") == last.scalar()).alias("is_next_start"))


def title_batches(titles: DataFrame, n: int = 500) -> DataFrame:
    """``title, batch`` for all batches at once: ``n - 1`` titles each, in title order."""
    numbered = dense_number(titles.select("title"), ["title"], "_n")
    return numbered.select("title", F.floor(F.col("_n") / (n - 1)).alias("batch"))


def table_id(url: Column, section_id: Column, table_idx: Column) -> Column:
    """Display name of a table: last URL part in ASCII, section id, table number.

    Names of different pages can be equal; joins use ``page_id, section_idx, table_idx``.
    """
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    last = text.normalize_dash(F.split_part(decoded, F.lit("/"), F.lit(-1)))
    return F.concat_ws(
        "_", F.regexp_replace(last, r"[^\x00-\x7F]", "?"), section_id, table_idx.cast("string")
    )
