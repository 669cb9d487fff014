"""Files in and out, each in a fresh folder."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cellquery.operators.sections import canonical_url, next_titles, title_batches
from cellquery.sources import files, store
from cellquery.sources.log import Conflict, Log


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(content)


def test_table_tree(spark, folder):
    put(f"{folder}/csv/204-csv/1.tsv", 'Name\tN\n"Ada ""x"""\t1\nBob\t\n')
    put(f"{folder}/csv/204-csv/2.tsv", "a\tb\n1\t2\t3\t4\n1\n9\t9\t9\t9\t9\n")
    put(f"{folder}/csv/204-csv/2.csv", 'a,b\n"x, y",TRUE\n')
    put(f"{folder}/csv/deep/er/3.tsv", "Ö Ü\n1.5\n")
    put(f"{folder}/data/training.tsv", 'id\tutterance\tcontext\ttargetValue\nnt-0\twhat "is" it?\tcsv/204-csv/1.csv\tAda|x\n')
    cells, qa = files.read_table_tree(spark, folder)
    got = {(r["table_id"], r["row_idx"], r["col_name"]): (r["cell"], r["cell_str"], r["col_type"]) for r in cells.collect()}
    assert got == {
        ("csv/204-csv/1.csv", 0, "Name"): ('Ada "x"', 'ada "x"', "text"),
        ("csv/204-csv/1.csv", 0, "N"): ("1", "1.0", "float"),
        ("csv/204-csv/1.csv", 1, "Name"): ("Bob", "bob", "text"),
        ("csv/204-csv/1.csv", 1, "N"): (None, None, "float"),
        ("csv/204-csv/2.csv", 0, "a"): ("x, y", "x, y", "text"),
        ("csv/204-csv/2.csv", 0, "b"): ("TRUE", "true", "bool"),
        ("csv/er/3.csv", 0, "Ö Ü"): ("1.5", "1.5", "float"),
    }
    assert [tuple(r) for r in qa.collect()] == [("nt-0", 'what "is" it?', "csv/204-csv/1.csv", "Ada|x")]


def test_store_versions(spark, folder):
    schema = "table_id string, row_idx int, col_idx int, col_name string, cell string"
    first = spark.createDataFrame([("a", 0, 0, "%", "1"), ("b", 0, 0, "", "1")], schema)
    store.save_cells(first, f"{folder}/cells")
    store.save_cells(spark.createDataFrame([("a", 1, 0, "%", "2")], schema), f"{folder}/cells", "append")
    store.save_cells(spark.createDataFrame([("b", 0, 0, "y", "3")], schema), f"{folder}/cells")
    got = sorted(tuple(r) for r in store.read_cells(spark, f"{folder}/cells").select("table_id", "row_idx", "col_name", "cell").collect())
    assert got == [("a", 0, "Percentage", "1"), ("a", 1, "Percentage", "2"), ("b", 0, "y", "3")]
    with pytest.raises(ValueError):
        store.save_cells(first, f"{folder}/cells", "upsert")


def test_qa_store_ignores_unfinished_versions(spark, folder):
    path = f"{folder}/qa"
    rows = spark.createDataFrame([("nt-0", "asd", "table", "0")], "id string, utterance string, context string, targetValue string")
    with pytest.raises(FileNotFoundError):
        store.read_qa(spark, path)
    store.write_qa(rows, path)
    os.makedirs(f"{path}/version=2")
    assert [tuple(r) for r in store.read_qa(spark, path).collect()] == [("nt-0", "asd", "table", "0")]
    assert store.append_qa(rows.withColumn("id", F.lit("nt-1")), path) == 3
    store.write_qa(store.read_qa(spark, path).withColumn("utterance", F.lit("new")), path)
    assert sorted(tuple(r)[:2] for r in store.read_qa(spark, path).collect()) == [("nt-0", "new"), ("nt-1", "new")]


def test_appended_questions_go_on(spark, folder):
    path, kind = f"{folder}/qa", "id string, utterance string"
    make = lambda *ids: spark.createDataFrame([(f"nt-{i}", f"q{i}") for i in ids], kind)
    store.append_numbered_qa(make(0, 1), path, batch=0)
    store.append_numbered_qa(make(0, 1), path, batch=0)  # run again
    store.append_qa(make(2), path)
    store.append_numbered_qa(make(1, 0), path, batch=1)
    assert sorted(r["id"] for r in store.read_qa(spark, path).collect()) == [f"nt-{i}" for i in range(5)]
    version = store.compact_qa(spark, path)
    assert store.append_numbered_qa(make(0), path) == version + 1
    assert sorted(r["id"] for r in store.read_qa(spark, path).collect()) == [f"nt-{i}" for i in range(6)]
    store.write_qa(make(3, 7), path)
    store.append_numbered_qa(make(0), path, batch=2)
    assert sorted(r["id"] for r in store.read_qa(spark, path).collect()) == ["nt-3", "nt-7", "nt-8"]


def test_writers_side_by_side(spark, folder):
    path = f"{folder}/qa"
    rows = spark.createDataFrame([("nt-0", "x"), ("nt-1", "y")], "id string, utterance string")
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda _: store.append_numbered_qa(rows, path), range(12)))
    assert sorted(versions) == list(range(1, 13))
    assert sorted(int(r["id"][3:]) for r in store.read_qa(spark, path).collect()) == list(range(24))


def test_only_one_claim_of_a_number_counts(spark, folder):
    one = Log(spark, f"{folder}/log")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: one._claim(1, {"name": str(k)}), range(8)))
    assert won.count(True) == 1 and one.last()[1]["name"] == str(won.index(True))


def test_compaction_yields_to_other_writers(spark, folder):
    path = f"{folder}/qa"
    rows = spark.createDataFrame([("nt-0", "x")], "id string, utterance string")
    store.append_qa(rows, path)
    log = Log(spark, path)
    with pytest.raises(Conflict):
        store.append_qa(rows, path)
        log.commit(lambda last: {"name": "late", "base": True}, expected=1)


def test_table_lists(spark, folder):
    path, kind = f"{folder}/cells", "table_id string, row_idx int, col_idx int, col_name string, cell string"
    listed = spark.createDataFrame([("a", ["%"], 1, 1), ("empty", ["x", ""], 0, 2)], "table_id string, header array<string>, n_rows long, n_cols long")
    store.save_cells(spark.createDataFrame([("a", 0, 0, "%", "1")], kind), path, tables=listed)
    store.save_cells(spark.createDataFrame([("b", 0, 1, "v", "1"), ("b", 0, 0, "u", "2"), ("a", 1, 0, "%", "2")], kind), path, "append")
    expected = [("a", ["Percentage"], 2, 1), ("b", ["u", "v"], 1, 2), ("empty", ["x", "Empty"], 0, 2)]
    read = lambda: sorted(tuple(r) for r in store.read_tables(spark, path).collect())
    assert read() == expected
    plan = store.read_cells(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    store.compact_cells(spark, path)
    assert read() == expected and store.read_cells(spark, path).count() == 4
    store.save_cells(spark.createDataFrame([("a", 0, 0, "z", "9")], kind), path)
    assert read()[0] == ("a", ["z"], 1, 1) and store.read_cells(spark, path).filter("table_id = 'a'").count() == 1


def test_results_file(spark, folder):
    row = [("2024-10-20 12:00:00", "Research", 10, "English", "m", "1.25", "[0.500, 0.250]")]
    for _ in range(2):
        files.append_results(spark.createDataFrame(row, files.RESULTS), f"{folder}/results")
    got = files.read_results(spark, f"{folder}/results").collect()
    assert len(got) == 2 and got[0]["Date"].year == 2024 and got[0]["Score"] == "[0.500, 0.250]"


def test_model_list(spark, folder):
    put(f"{folder}/models.csv", "Name,URL,Model type,Layer offset count,Prompt format\nModell,org/Modell,transformers,0,1\n")
    assert tuple(files.read_models(spark, f"{folder}/models.csv").first()) == ("Modell", "org/Modell", "transformers", 0, 1)


def test_dump(spark, folder):
    put(
        f"{folder}/dump.xml",
        "<mediawiki><page><title>Szeged</title><id>1</id><revision><id>5</id><text>first\n </text></revision>"
        "<revision><id>6</id><text>second</text></revision></page><page><title>Other</title>"
        "<revision><id>7</id><text>o</text></revision></page></mediawiki>",
    )
    titles = spark.createDataFrame([("Szeged",), ("Szeged",), ("Missing",)], "title string")
    got = [tuple(r) for r in files.dump_page_text(spark, f"{folder}/dump.xml", titles).collect()]
    assert [(t, x.strip()) for t, x in got] == [("Szeged", "first")]


def test_lines(spark, folder):
    lines = spark.createDataFrame([(2, "c"), (0, "a"), (1, "")], "idx int, text string")
    files.write_lines(lines, f"{folder}/out")
    assert sorted(tuple(r) for r in files.read_lines(spark, f"{folder}/out").collect()) == [(0, "a"), (1, ""), (2, "c")]
    put(f"{folder}/in.txt", "first\n\nthird\n" + "\n".join(f"l{i}" for i in range(3000)))
    got = files.read_line_file(spark, f"{folder}/in.txt").orderBy("idx").collect()
    expected = ["first", "", "third", *[f"l{i}" for i in range(3000)]]
    assert [tuple(r) for r in got] == list(enumerate(expected))


def test_nested_qa(spark, folder):
    schema = "table struct<header:array<string>,rows:array<array<string>>>, question string, answers array<string>"
    rows = [((["h"], [[str(i)]]), f"q{i}", [str(i)]) for i in range(3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/nested")
    got = files.read_nested_qa(spark, f"{folder}/nested").collect()
    assert sorted(r["question_id"].rpartition("#")[2] for r in got) == ["0", "1", "2"]


def test_canonical_url(spark):
    pages = [
        ('<link href="https://x/a&amp;b" rel="canonical">', "https://x/a&b"),
        ("<link rel='canonical' href='https://x/q'/>", "https://x/q"),
        ('<link rel="stylesheet" href="s.css">', "default"),
        ('<link rel="canonical">', "default"),
    ]
    df = spark.createDataFrame(pages, "html string, expected string")
    assert df.filter(canonical_url(F.col("html"), F.lit("default")) != F.col("expected")).count() == 0


def test_title_paging(spark):
    names = [f"t{i:04d}" for i in range(1200)]
    titles = spark.createDataFrame([(n,) for n in names], "title string")
    start, batches = "t0000", []
    while True:
        rows = next_titles(titles, start).collect()
        batches.append(sorted(r["title"] for r in rows if not r["is_next_start"]))
        start = next(r["title"] for r in rows if r["is_next_start"])
        if len(rows) < 500:
            batches[-1].append(start)
            break
    assert sum(batches, []) == names
    at_once = {r["title"]: r["batch"] for r in title_batches(titles).collect()}
    assert at_once == {t: k for k, batch in enumerate(batches) for t in batch}
