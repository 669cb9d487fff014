"""The core join against nested loops, and its behaviour under hot keys."""

import random
import re

from pyspark.sql import functions as F

from cellquery.functions import text
from cellquery.operators import matching, questions
from cellquery.operators.numbering import dense_number
from cellquery.plans.harvest import harvest

LEXICON = ["ada", "11.2", "5", "é", "de", "la_b", "kék", "-5", "two words.", "a.b.c", "²", "nan", "Kék."]


def expected_hits(paragraphs, tables, strict):
    """The definition as sets: a cell text, last seen at one place of its table, hits the sentences of
    its section that it equals; if there are none, those that have it as a word."""
    cut = lambda p, marks: re.split(rf"(?<=[{marks}])\s+", p)
    said = {(s, n, t) for s, p in paragraphs.items() for n, t in enumerate(cut(p, ".!?"))}
    if not strict:
        said = {(s, 0, t) for s, p in paragraphs.items() for t in cut(p, ".!?") + cut(p, ".!?;,")}
    place = {
        (*key, cell.strip().lower()): (i, j)
        for key, rows in tables.items()
        for i, row in enumerate(rows)
        for j, cell in enumerate(row)
    }
    inside = {(k, t) for k in place for t in said if k[0] == t[0]}
    whole = {(k, t) for k, t in inside if t[2].lower() == k[2]}
    rest = inside - {(k, t) for k, t in inside if k in {w for w, _ in whole}}
    word = {(k, t) for k, t in rest if k[2] in re.findall(r"\b\w+(?:\.\w+)?\b", t[2].lower())}
    return [(*k[:2], *place[k], t[2]) for k, t in whole | word]


def fixture(spark, seed, n_sections=12):
    pick = random.Random(seed)
    paragraphs, tables = {}, {}
    for section in range(n_sections):
        words = [pick.choice(LEXICON) + pick.choice(["", ".", "!", ",", ";"]) for _ in range(pick.randint(0, 60))]
        paragraphs[section] = pick.choice([" ", "  ", "\n"]).join(words)
        for number in range(pick.randint(0, 3)):
            tables[section, number] = [
                [pick.choice(LEXICON + [" ADA ", ""]) for _ in range(3)] for _ in range(pick.randint(1, 4))
            ]
    sections = spark.createDataFrame([(1, s, p) for s, p in paragraphs.items()], "page_id long, section_idx int, paragraph string")
    cells = spark.createDataFrame(
        [(1, s, n, i, j, c) for (s, n), rows in tables.items() for i, row in enumerate(rows) for j, c in enumerate(row)],
        "page_id long, section_idx int, table_idx int, row_idx int, col_idx int, cell string",
    ).withColumn("cell_str", text.strip(F.lower("cell")))
    return paragraphs, tables, sections, cells


def found(matches):
    columns = ["section_idx", "table_idx", "row_idx", "col_idx", "sentence"]
    return sorted(tuple(r) for r in matches.select(*columns).collect())


def test_same_as_nested_loops(spark):
    for seed, strict in ((1, True), (2, False), (3, True)):
        paragraphs, tables, sections, cells = fixture(spark, seed)
        sentences = matching.sentence_rows(sections, strict=strict)
        expected = sorted(expected_hits(paragraphs, tables, strict))
        assert expected
        assert found(matching.match_cells(cells, sentences)) == expected
        shuffled = matching.match_cells(cells.repartition(5), sentences.repartition(7, "sentence"))
        assert found(shuffled) == expected


def test_whole_and_word_hits_are_disjoint(spark):
    _, _, sections, cells = fixture(spark, 5)
    hits = matching.match_cells(cells, matching.sentence_rows(sections))
    both = hits.groupBy("section_idx", "table_idx", "cell_str").agg(F.countDistinct("whole").alias("n"))
    assert both.filter("n > 1").count() == 0


def test_cell_index_order(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, i, 0, c) for i, c in enumerate("xyx")],
        "page_id long, section_idx int, table_idx int, row_idx int, col_idx int, cell_str string",
    )
    got = matching.cell_index(cells).orderBy("first_pos").collect()
    assert [(r["cell_str"], r["row_idx"], r["col_idx"]) for r in got] == [("x", 2, 0), ("y", 1, 0)]


def test_dense_number(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("p").alias("same"))
    got = dense_number(rows.repartition(6), ["same", "k"], "n", start=10).orderBy("n").collect()
    assert [(r["n"], r["k"]) for r in got] == [(10 + i, i) for i in range(5000)]


def test_sample_cells(spark):
    cells = spark.range(0, 200).select(
        (F.col("id") % 2).alias("t"), F.col("id").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("id").cast("string").alias("cell")
    )
    def draw(seed):
        rows = questions.sample_cells(cells, ["t"], 7, seed).collect()
        return sorted((r["t"], r["draw"], r["cell"]) for r in rows)

    first = draw(1)
    assert len(first) == 14 and first == draw(1) and first != draw(2)
    assert all(int(cell) % 2 == t for t, _, cell in first)


def test_harvest(spark):
    html = (
        '<p>x</p><h2 id="Győr">T</h2><p>Az ég kék. Ada 11,2 éves&nbsp;volt; Ada.</p>'
        "<table><tr><th>n</th><th>v</th></tr><tr><td>Ada</td><td>11,20</td></tr><tr><td>ég</td><td>N/A</td></tr></table>"
        '<h2 id="last">L</h2><p>Ada</p>'
    )
    pages = spark.createDataFrame([(3, "https://hu.wikipedia.org/wiki/Gy%C5%91r", html)], "page_id long, url string, html string")
    job = harvest(pages, start=5)
    got = [tuple(r) for r in job.qa().orderBy("id").collect()]
    sentence = "ada 11.2 éves\xa0volt; ada."
    assert got == [
        ("nt-5", "e", "Gy?r_Győr_0", "ada", False, sentence),
        ("nt-6", "e", "Gy?r_Győr_0", "11.2", False, sentence),
        ("nt-7", "e", "Gy?r_Győr_0", "ég", False, "az ég kék."),
    ]
    candidates = spark.createDataFrame(
        [("nt-6", 1, "Mennyi"), ("nt-6", 0, "X"), ("nt-7", 0, "Fa")], "statement_id string, rank int, token string"
    )
    asked = {r["id"]: (r["utterance"], r["valid"]) for r in job.qa(candidates).collect()}
    assert asked == {
        "nt-5": (None, False),
        "nt-6": ("ada Mennyi éves\xa0volt; ada?", True),
        "nt-7": ("az fa kék?", False),
    }
    numbers = harvest(pages, numbers_only=True).qa()
    assert [r["targetValue"] for r in numbers.collect()] == ["11.2"]
    stored = {r["cell"] for r in job.stored_cells().collect()}
    assert stored == {"Ada", "11.20", "ég", None}


def test_rework(spark):
    qa = spark.createDataFrame(
        [
            ("nt-0", "e", "t", "kék", False, "az ég kék."),
            ("nt-1", "e", "t", "5", False, "15 és 5."),
            ("nt-2", "e", "t", "y", True, "x y"),
            ("nt-3", "e", "t", "a", True, "a" + "b" * 512),
        ],
        "id string, utterance string, context string, targetValue string, valid boolean, original string",
    )
    candidates = spark.createDataFrame([(f"nt-{i}", 0, "mi") for i in range(4)], "statement_id string, rank int, token string")
    kept = {r["id"]: (r["utterance"], r["valid"]) for r in questions.rework_qa(qa, candidates).collect()}
    assert kept == {
        "nt-0": ("az ég mi?", False), "nt-1": (text.AMBIGUOUS, False), "nt-2": (None, True), "nt-3": (text.TOO_LONG, True),
    }
    stored = {r["id"]: r["valid"] for r in questions.rework_qa(qa, candidates, store_valid=True).collect()}
    assert stored == {"nt-0": True, "nt-1": True, "nt-2": False, "nt-3": False}


def test_outranked_candidates_leave_before_the_shuffle(spark):
    """At most two rows of a statement per batch go on, and the picked words stay those of all rows."""
    import pyarrow as pa

    from cellquery.operators.questions import _outranked_left_out, pick_question_word

    rows = [("a", 3, "x", None), ("a", 1, "Y", None), ("a", 2, "hol", 2), ("a", 5, "mi", 5), ("b", None, "ki", None), (None, 4, "q", None), (None, 0, "r", None)]
    names = ["statement_id", "rank", "token", "_listed_rank"]
    batch = pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in zip(names, zip(*rows))})
    kept = [tuple(r.values()) for out in _outranked_left_out([batch]) for r in out.to_pylist()]
    assert kept == [("a", 1, "Y", None), ("a", 2, "hol", 2), ("b", None, "ki", None), (None, 0, "r", None)]
    df = spark.createDataFrame([r[:3] for r in rows], "statement_id string, rank int, token string")
    picked = {r.statement_id: (r.token, r.valid) for r in pick_question_word(df.repartition(3)).collect()}
    assert picked == {"a": ("hol", True), "b": (None, False), None: ("r", False)}
