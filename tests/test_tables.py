"""HTML tables, cell typing and whole-table operators."""

import csv
import io
import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellquery.functions import fragments
from cellquery.functions.fragments import ParagraphTexts, SectionReader
from cellquery.functions.text import WHITESPACE
from cellquery.functions.typing import coded_rows, float_text
from cellquery.operators import tables
from cellquery.operators.evaluation import qa_with_tables

NBSP = "\xa0"


def cells_of(spark, header, rows, key="cell_str", **options):
    df = spark.createDataFrame([(1, header, rows)], "t int, header array<string>, rows array<array<string>>")
    got = tables.type_cells(df, **options).orderBy("row_idx", "col_idx").collect()
    n = len(header)
    return [[r[key] for r in got[i : i + n]] for i in range(0, len(got), n)]


def test_typing_golden(spark):
    nan = {"null_as_nan": True}
    rows = [["1 234", "3,5", "x", "5", "5"], ["2", "1 000,25", "N/A", "", "6"]]
    assert cells_of(spark, list("abcde"), rows, **nan) == [
        ["1234", "3.5", "x", "5.0", "5"], ["2", "1000.25", "nan", "nan", "6"],
    ]
    assert cells_of(spark, list("abcde"), rows, "col_type")[0] == ["int", "float", "text", "float", "int"]
    assert cells_of(spark, list("abcde"), rows)[1] == ["2", "1000.25", None, None, "6"]
    upcast = [["5", "1,5"], ["7", "2"]]
    assert cells_of(spark, list("an"), upcast) == [["5.0", "1.5"], ["7.0", "2.0"]]
    assert cells_of(spark, list("an"), upcast, "word") == [["5", "1.5"], ["7", "2.0"]]
    assert cells_of(spark, list("ab"), [["1 2", "2020"], ["x", "1e3"]]) == [["12", "2020.0"], ["x", "1000.0"]]
    assert cells_of(spark, list("ab"), [["3", "2,5"], ["4", "x"]]) == [["3", "2.5"], ["4", "x"]]
    assert cells_of(spark, ["a", "a.1"], [["1", "True"], ["2", "False"]]) == [["1", "true"], ["2", "false"]]
    assert cells_of(spark, ["a", "a.1"], [["1", "True"], ["2", "False"]], "col_type")[0] == ["int", "bool"]
    assert cells_of(spark, ["y"], [[f"1{NBSP}234"], ["2"]]) == [[f"1{NBSP}234"], ["2"]]
    default = cells_of(spark, ["y", "z"], [["1,234", "5"], ["2", "a,b"]], decimal=".", thousands=",")
    assert default == [["1234", "5"], ["2", "a,b"]]


def test_float_text_is_pythons(spark):
    values = ["5", "5.", ".5", "007", "-0.50", "1e3", "1e16", "1E-5", "12345678.5", "0.00001", "0.0001",
              "123456789012345678", "1e22", "-2.5e-7", "0.1", "100000000000000000000", "3.50", "+4.0", "0"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", float_text(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == {v: str(float(v)) for v in values}


def test_float_text_over_all_magnitudes(spark):
    pick = random.Random(4)
    values = {f"{pick.choice(['', '-'])}{pick.randint(0, 10 ** pick.randint(1, 19))}.{pick.randint(0, 10 ** pick.randint(1, 19))}" for _ in range(1500)}
    values |= {f"{pick.randint(0, 10 ** 17)}e{pick.randint(-330, 300)}" for _ in range(1500)}
    values |= {repr(struct.unpack("d", pick.randbytes(8))[0]) for _ in range(1500)}
    values = [v for v in values | {"1e400", "-1e400", "1e23", "2e-3", "0e5", "-0e1"} if v != "nan" and not 0 < abs(float(v)) < 1e-307]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", float_text(F.col("v")).alias("t"))
    wrong = {r["v"]: (r["t"], str(float(r["v"]))) for r in df.collect() if r["t"] != str(float(r["v"]))}
    assert not wrong, (len(wrong), list(wrong.items())[:5])


def test_tables_without_rows(spark):
    html = "<table><tr><th>a</th><th>%</th></tr></table><table><tr><th>b</th></tr><tr><td>x,\"y\"</td></tr></table>"
    nested = tables.read_tables(spark.createDataFrame([(1, html), (2, "none")], "p int, html string"), "html")
    listed = tables.table_list(nested)
    assert sorted(tuple(r) for r in listed.collect()) == [(1, 0, ["a", "%"], 0, 2), (1, 1, ["b"], 1, 1)]
    texts = tables.table_to_csv(tables.type_cells(nested), ["p", "table_idx"], tables=listed)
    assert {r["table_idx"]: r["csv"] for r in texts.collect()} == {0: "a,%\n", 1: 'b\n"x,""y"""\n'}


def test_typing_against_pandas(spark):
    header = ["a", "b", "c", "d"]
    rows = [["1", "2.5", "", "x"], ["-3", "1e-3", "7", "NaN"], ["+4", ".5", "8", "12"], ["05", "inf", "9", ""]]
    text = io.StringIO()
    csv.writer(text).writerows([header, *rows])
    frame = pd.read_csv(io.StringIO(text.getvalue()))
    expected = [[str(c).strip().lower() for c in row] for _, row in frame.iterrows()]
    assert cells_of(spark, header, rows, decimal=".", thousands=None, null_as_nan=True) == expected


def read(html):
    return SectionReader().read(html)


def test_table_shapes():
    spans = (
        "<table><tr><th>A</th><th>A</th><th></th></tr><tr><td rowspan=2>1</td><td colspan='2'>x</td></tr>"
        "<tr><td>y\nz<br>w<td>q</table>"
    )
    assert read(spans).grids() == [
        {"header": ["A", "A.1", "Unnamed: 2"], "rows": [["1", "x", "x"], ["1", "y z w", "q"]]}
    ]
    overhang = "<table><tr><td rowspan=3>a</td><td>b</td></tr></table>"
    assert read(overhang).grids()[0] == {"header": ["0", "1"], "rows": [["a", "b"], ["a", ""], ["a", ""]]}
    nested = "<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>"
    assert [g["rows"] for g in read(nested).grids()] == [[["oi"]], [["i"]]]
    two = "<table><thead><tr><th>X</th><th>X</th></tr><tr><th>p</th><th>q</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table>"
    assert read(two).grids() == [{"header": ["X p", "X q"], "rows": [["1", ""]]}]
    foot = "<table><tfoot><tr><td>f</td></tr></tfoot><tr><td>b</td></tr><tr><td> </td></tr></table>"
    assert read(foot).grids()[0]["rows"] == [["b"], ["f"]]
    hidden = "<table><tr><td>a<span style='display: none'>h</span></td><td style='display:none'>z</td></tr></table>"
    assert read(hidden).grids()[0]["rows"] == [["a"]]
    assert read("<table><tr><td> </td></tr></table>").grids() == []


def test_citations_and_entities():
    html = (
        'A&nbsp;&amp;&lt;b&eacute;<sup class="reference" id="r"><a href="#">[1]</a></sup>'
        '<span class="x cite-bracket">[<b>2</b></span> c<sup>2</sup><br><p>open <i>x'
    )
    assert read(html).html == f"A{NBSP}&amp;&lt;bé c<sup>2</sup><br/><p>open <i>x</i></p>"
    assert read('<td title="a&quot;b">x</td></p>').html == "<td title='a\"b'>x</td>"
    cited = "<table><tr><td>5<sup class='reference'>[1]</sup></td></tr></table>"
    assert read(cited).grids()[0]["rows"] == [["5"]]
    assert read("<script>if (a<b) c()</script>").html == "<script>if (a<b) c()</script>"


def test_paragraph_texts():
    html = "<div><p>a<b>b</b></p><p>c<p>d</div>e<p><script>s</script>f"
    assert ["".join(t) for t in ParagraphTexts().read(html).texts] == ["ab", "cd", "d", "f"]


def test_extract_cells(spark):
    html = "<p>t</p><table><tr><th>n</th><th>v</th></tr><tr><td>Ada</td><td>1 234,5</td></tr></table><table><tr><td>7</td></tr></table>"
    df = spark.createDataFrame([(9, html), (10, "none")], "page_id int, html string")
    got = tables.extract_cells(df, "html").orderBy("table_idx", "col_idx").collect()
    assert [(r.page_id, r.table_idx, r.row_idx, r.col_name, r.col_type, r.cell_str) for r in got] == [
        (9, 0, 0, "n", "text", "ada"), (9, 0, 0, "v", "float", "1234.5"), (9, 1, 0, "0", "int", "7"),
    ]


def frame_cells(spark, name, frame):
    rows = [
        (name, i, j, str(column), None if pd.isna(frame.iat[i, j]) else str(frame.iat[i, j]))
        for i in range(len(frame))
        for j, column in enumerate(frame.columns)
    ]
    return spark.createDataFrame(rows, "table_id string, row_idx int, col_idx int, col_name string, cell string")


def test_table_to_csv(spark):
    frames = {
        "people": pd.DataFrame({"Name": ["Ál,ice", 'B"ob', None], "Age": ["25", "3\n0", ""]}),
        "one": pd.DataFrame({"x": ["", "a", None]}),
        "long": pd.DataFrame({"k": [str(i) for i in range(57)], "v": ["é"] * 57}),
    }
    cells = None
    for name, frame in frames.items():
        part = frame_cells(spark, name, frame)
        cells = part if cells is None else cells.union(part)
    for block in (10, 10_000):
        got = {r["table_id"]: r["csv"] for r in tables.table_to_csv(cells, ["table_id"], block).collect()}
        assert got == {name: frame.to_csv(index=False) for name, frame in frames.items()}


def test_reduce_tables(spark):
    def kept(n_rows, n_cols, limit=64):
        frame = pd.DataFrame([[f"{i}" for _ in range(n_cols)] for i in range(n_rows)])
        cut = tables.reduce_tables(frame_cells(spark, "t", frame), ["table_id"], limit)
        return cut.select("row_idx").distinct().count()

    assert kept(20, 4) == 16
    assert kept(16, 4) == 16
    assert kept(15, 4) == 15


def test_nested_and_lookup(spark):
    rows = [("q#0", (["h", "%"], [["a", "1"], ["b", "2"]]), "Which?", ["x", "y|z"])]
    df = spark.createDataFrame(
        rows,
        "question_id string, table struct<header:array<string>,rows:array<array<string>>>, question string, answers array<string>",
    )
    cells, qa = tables.flatten_nested_qa(df)
    assert [tuple(r) for r in cells.orderBy("row_idx", "col_idx").collect()] == [
        ("q#0", 0, 0, "h", "a"), ("q#0", 0, 1, "%", "1"), ("q#0", 1, 0, "h", "b"), ("q#0", 1, 1, "%", "2"),
    ]
    assert tuple(qa.first()) == ("q#0", "Which?", "q#0", "x y|z")
    found = qa_with_tables(qa, tables.table_to_csv(cells, ["table_id"])).first()
    assert found["answers"] == ["x y", "z"] and found["csv"] == "h,%\na,1\nb,2\n"
    names = spark.createDataFrame([("%",), ("",), ("a%",)], "h string")
    assert [r[0] for r in names.select(tables.normalize_headers(F.col("h"))).collect()] == ["Percentage", "Empty", "a%"]


def test_pages_of_one_row_group_are_read_by_many_tasks(spark, tmp_path):
    from cellquery.catalog import inputs

    row = "id AS c_custkey, 'C' AS c_name, 1 AS c_nationkey, 1.5D AS c_acctbal, 'M' AS c_mktsegment"
    spark.range(0, 64, 1, 1).selectExpr(row.split(", ")).write.parquet(f"{tmp_path}/customer.parquet")
    pages = inputs.customer_pages(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/customer.parquet").rdd.getNumPartitions() == 1
    sizes = pages.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 64 and max(sizes) <= 16


class _ByParser(SectionReader):
    """All of it by the parser."""

    def _read_plain(self, html):
        return 0


@pytest.mark.parametrize(
    "html",
    [
        "a<!-- c --><p>b & c &amp; d</p>x < y<",
        '<table><TR><td colspan="2">1</td><td rowspan=2>2</td></tr><tr><td>3</td></table >',
        "<style>a<b</style><table><tr><th>n</th><th>n</th></tr><tr><td>1<td>2</table>",
        '<b c="d"e="f">x</b><a href="?a=1&amp;b">y</a><img src="u"/><br><p/><b\x0b>z</b></br></>',
        '<sup class="reference">[<b>1</b>]</sup><!-- open',
    ],
)
def test_plain_tags_read_as_the_parser_reads_them(html):
    here, there = SectionReader().read(html), _ByParser().read(html)
    assert (here.html, here.grids()) == (there.html, there.grids())
    assert fragments.grids(html) == there.grids()


def test_tables_alone_are_read_without_writing_html(spark, monkeypatch):
    page = '<style><table></style><p>x</p><TABLE><tr><th>n</th></tr><tr><td>1 & 2<sup class="reference">[1]</sup></td></tr>'
    df = spark.createDataFrame([(1, page), (2, "<p>no table</p>"), (3, None)], "k int, html string")
    read = tables.read_fragments(df, "html", clean=False)
    assert read.columns == ["k", "tables"]
    both = tables.read_fragments(df, "html").drop("clean_html")
    assert sorted(map(str, read.collect())) == sorted(map(str, both.collect()))
    tables_of = fragments.grids(page)
    monkeypatch.setattr(fragments, "_start_tag", None)  # written tags would call it
    assert fragments.grids(page) == tables_of == [{"header": ["n"], "rows": [["1 & 2"]]}]
    monkeypatch.setattr(SectionReader, "read", None)
    assert fragments.grids("<p>no table</p>") == []


def test_cells_are_coded_without_the_space_around_them(spark):
    _, whole, real, _, text = range(5)
    shapes = {"7": whole, "-7": whole, "1.5": real, ".5e3": real, "Inf": real, "1 2": text, "x": text, "7\n7": text}
    rows = [[f"{a}{shape}{b}" for shape in shapes] for a, b in [("", ""), *[(w, w + "\n") for w in WHITESPACE], ("", "\r\n"), ("\n", "\n\n")]]
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    coded = df.select(coded_rows(F.col("rows"), ".", None)).first()[0]
    assert [[c["code"] for c in row] for row in coded] == [list(shapes.values())] * len(rows)
    spaced = spark.createDataFrame([([["1 234,5", "1 a,b", "1,5", "12", "a b", " ", None]],)], "rows array<array<string>>")
    assert [c["text"] for c in spaced.select(coded_rows(F.col("rows"), ",", " ")).first()[0][0]] == [
        "1234.5", "1 a,b", "1.5", "12", "a b", " ", None,
    ]


def test_plain_tags_do_not_go_through_the_parser(monkeypatch):
    def never(self, at):
        raise AssertionError("parsed")

    monkeypatch.setattr(SectionReader, "parse_starttag", never)
    monkeypatch.setattr(SectionReader, "parse_endtag", never)
    html = '<p id="a">b &amp; c<sup class="reference">[1]</sup></p>'
    assert SectionReader().read(html).html == '<p id="a">b &amp; c</p>'
