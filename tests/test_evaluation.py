"""Prompts, predictors, run plans, scores, results and reports."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellquery.operators import evaluation, prediction, prompts, report
from cellquery.plans.evaluation import answers, evaluate, prompt_table, result_file_rows
from cellquery.plans.generation import generate_qa
from test_tables import frame_cells

LINES = pd.DataFrame(
    {"line": ["12", "M4", "31B", "N2"], "stops": ["18", "9", "23", "14"], "ends at": ["Harbour", "Airport", "Old Town", "Harbour"]}
)
QA_SCHEMA = "id string, utterance string, context string, targetValue string, valid boolean, original string"
STOPS, LONGEST, SHARED, BOTH = "How often does M4 stop?", "Where does the longest line end?", "Which place do two lines share?", "Name the lines to it."


@pytest.fixture
def lines(spark):
    return frame_cells(spark, "city-lines", LINES)


@pytest.fixture
def lines_qa(spark):
    rows = [(STOPS, "9"), (LONGEST, "Old Town"), (SHARED, "Harbour"), (BOTH, "12|N2")]
    return spark.createDataFrame([(f"nt-{i}", q, "city-lines", a, True, None) for i, (q, a) in enumerate(rows)], QA_SCHEMA)


@pytest.fixture
def models(spark):
    rows = [("Modell", "org/Modell", "transformers", 0, 1), ("Second", "org/Second", "gguf", 0, 2)]
    return spark.createDataFrame(rows, "name string, url string, model_type string, layer_offset int, prompt_format int")


def one(df, column="prompt"):
    return df.first()[column]


def test_answer_prompt_formats(spark):
    df = spark.createDataFrame([("a,b\n1,{question}\n", "Which {table}?")], "table string, question string")
    instruction, opener = prompts.ANSWER_TEXTS["en"]
    body = "a,b\n1,{question}\n\n\nWhich {table}?"
    assert one(prompts.answer_prompt(df)) == f"{instruction}\n\n{body}\n\n{opener}"
    assert one(prompts.answer_prompt(df, 99)) == one(prompts.answer_prompt(df, -1)) == one(prompts.answer_prompt(df))
    assert one(prompts.answer_prompt(df, 0)) == f"<|system|>\n{instruction}<|end|>\n<|user|>\n{body}<end>\n<|assistant|>\n{opener}"
    assert one(prompts.answer_prompt(df, 1)) == f"<|system|>\n{instruction}</s><|end|>\n<|user|>\n{body}</s><end>\n<|assistant|>\n{opener}"
    assert one(prompts.answer_prompt(df, 2)) == f"[INST] <<SYS>>\n{instruction}\n<</SYS>>\n{body}[/INST]\n{opener}"
    instruction, opener = prompts.ANSWER_TEXTS["hu"]
    assert one(prompts.answer_prompt(df, 3, "hu")) == (
        f"<|im_start|>system\n{instruction}<|im_end|>\n<|im_start|>user\n{body}<|im_end|>\n<|im_start|>assistant\n{opener}"
    )
    assert all(o.endswith('"') for _, o in prompts.ANSWER_TEXTS.values())


def test_question_prompt(spark):
    df = spark.createDataFrame([("a\n1\n", "1")], "table string, answer string")
    made = one(prompts.question_prompt(df, 2, "en"))
    instruction, opener = (t.replace("{answer}", "1") for t in prompts.QUESTION_TEXTS["en"])
    assert made == f"[INST] <<SYS>>\n{instruction}\n<</SYS>>\na\n1\n[/INST]\n{opener}" and made.endswith('"1"/"')


def test_predict_keeps_errors_in_their_rows(spark):
    df = spark.range(0, 50).select("id", F.col("id").cast("string").alias("prompt"))

    def make():
        def run(batch):
            if (batch["id"] % 10 == 3).any():
                raise ValueError("too long")
            return [f"<{p}>" for p in batch["prompt"]]

        return run

    got = prediction.predict(df, make, batch_size=4).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(50))
    for r in got:
        failed = r["id"] % 10 == 3
        assert (r["completion"], r["error"]) == ((None, "ValueError: too long") if failed else (f"<{r['id']}>", None))
    lines = df.select(F.col("id").alias("idx"), F.col("prompt").alias("text"))

    def shout():
        return lambda texts: [t + "!" if t != "7" else 1 / 0 for t in texts]

    kept = {r["idx"]: r["text"] for r in prediction.translate(lines, "text", shout, batch_size=8).collect()}
    assert kept == {i: f"{i}!" for i in range(50) if i != 7}


def test_base_model_and_backends(spark):
    rows = [("gguf", "t", "q1"), ("openai", "t", "q2"), ("other", "t", "q3")]
    df = spark.createDataFrame(rows, "model_type string, table string, question string")
    backends = {"gguf": lambda: lambda b: ["G" + q for q in b["question"]], "base": prediction.base_model}
    got = {r["question"]: r["completion"] for r in prediction.predict_by_type(df, backends, "base").collect()}
    assert got == {"q1": "Gq1", "q2": "t\nq2\nBase model answer.", "q3": "t\nq3\nBase model answer."}


def test_run_plan(spark, models, lines_qa):
    named = models.select(F.col("name").alias("model"))
    for limit, n in ((None, 4), (2, 2), (10, 4)):
        plan = evaluation.run_plan(named, 2, lines_qa, limit)
        expected = {(f"nt-{q}", m, s) for q in range(n) for m in ("Modell", "Second") for s in range(2)}
        got = [tuple(r) for r in plan.select("question_id", "model", "seed").collect()]
        assert set(got) == expected and len(got) == len(expected)


def test_evaluation_end_to_end(spark, models, lines, lines_qa):
    told = {STOPS: "9.", LONGEST: "Airport", SHARED: " harbour", BOTH: "n2, 31B"}

    def transformers():
        return lambda batch: [f'{p}{told[q]}" and more' for p, q in zip(batch["prompt"], batch["question"])]

    def failing():
        def run(batch):
            if SHARED in set(batch["question"]):
                raise ValueError("context")
            return [told[q] for q in batch["question"]]

        return run

    asked = prompt_table(models, lines_qa, lines, seeds=2)
    assert asked.count() == 16
    assert asked.first()["table"] == LINES.to_csv(index=False)
    done = prediction.predict_by_type(asked, {"transformers": transformers, "gguf": failing}, "gguf")
    rows = evaluation.evaluate_rows(answers(done), lines_qa)
    scores = {(r["model"], r["seed"], r["question_id"]): r["score"] for r in rows.collect()}
    right = {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.5}
    assert scores == {
        **{("Modell", s, f"nt-{q}"): v for s in (0, 1) for q, v in right.items()},
        **{("Second", s, f"nt-{q}"): v for s in (0, 1) for q, v in right.items() if q != 2},
    }
    table = evaluate(models, lines_qa, lines, {"gguf": failing}, "gguf", seeds=2, tasks=3)
    assert {(r["model"], r["seed"]): r["accuracy"] for r in table.collect()} == {
        (m, s): 1.5 / 4 for m in ("Modell", "Second") for s in (0, 1)
    }


def test_backends_end_where_their_texts_end(spark, models, lines, lines_qa):
    """A stop token, a repeated prompt, and a text as it is, in one evaluation down to the result file."""
    kinds = models.unionByName(
        spark.createDataFrame([("Third", "u", "openai", 0, 9)], "name string, url string, model_type string, layer_offset int, prompt_format int")
    )
    backends = {
        "gguf": lambda: lambda b: ["Harbour</s>, 9" for _ in b["prompt"]],
        "transformers": lambda: lambda b: [f'{p}9, Old Town" Harbour' for p in b["prompt"]],
        "openai": lambda: lambda b: ['"12", Harbour' for _ in b["prompt"]],
    }
    elapsed = spark.createDataFrame([("Modell", 8.0), ("Second", 2.0), ("Third", 3.0)], "model string, seconds double")
    rows = result_file_rows(kinds, lines_qa, lines, backends, "gguf", elapsed, F.lit("2025-01-02 03:04:05").cast("timestamp"), "Lines")
    got = {r["Model name"]: (r["Score"], r["Iteration speed"], r["Dataset size"]) for r in rows.collect()}
    assert got == {"Modell": ("[0.500]", "0.50", 4), "Second": ("[0.250]", "2.00", 4), "Third": ("[0.375]", "1.33", 4)}


def test_translated_prompts(spark, models, lines, lines_qa):
    spoken = spark.createDataFrame([(0, "Hány megállója van?"), (2, "Hol van kettőnek vége?")], "idx int, text string")
    asked = prompt_table(models, lines_qa, lines, lang="hu", translations=spoken)
    got = {r["question_id"]: r["question"] for r in asked.collect()}
    assert got == {"nt-0": "Hány megállója van?", "nt-1": LONGEST, "nt-2": "Hol van kettőnek vége?", "nt-3": BOTH}


def test_results_and_leaderboard(spark):
    accuracies = spark.createDataFrame(
        [("a", 1, 0.0625), ("a", 0, 1.0005), ("b", 0, 2.675)], "model string, seed int, accuracy double"
    )
    elapsed = spark.createDataFrame([("a", 8.0), ("b", 3.0)], "model string, seconds double")
    made = evaluation.result_rows(accuracies, elapsed, F.lit("2024-10-20 12:00:00").cast("timestamp"), "Research", 10, True)
    got = {r["Model name"]: r for r in made.collect()}
    assert got["a"]["Score"] == "[" + ", ".join(format(v, ".3f") for v in (1.0005, 0.0625)) + "]"
    assert got["b"]["Score"] == f"[{2.675:.3f}]" and got["b"]["Iteration speed"] == "3.33"
    assert got["a"]["Iteration speed"] == f"{10 / 8:.2f}" and got["a"]["Dataset language"] == "English"
    board = [(r["model"], round(r["accuracy"], 5), r["speed"]) for r in report.leaderboard(made).collect()]
    assert [b[0] for b in board] == ["b", "a"] and board[0][1:] == (float(f"{2.675:.3f}"), 3.33)


def test_sql_answer_verdict(spark, lines_qa):
    results = spark.createDataFrame(
        [("nt-0", 1, "14"), ("nt-0", 0, "9"), ("nt-1", 0, "Airport")], "question_id string, row_no int, value string"
    )
    got = {r["question_id"]: r["verdict"] for r in evaluation.sql_answer_verdict(results, lines_qa).collect()}
    assert got == {"nt-0": True, "nt-1": False, "nt-2": False, "nt-3": False}


def test_table_index(spark, lines, lines_qa):
    other = frame_cells(spark, "other", LINES[["line"]])
    got = {r["table_id"]: tuple(r)[1:] for r in report.table_index(lines.union(other), lines_qa).collect()}
    assert got == {"city-lines": (4, 3, 4), "other": (4, 1, 0)}


def test_question_count(spark, lines_qa):
    assert evaluation.qa_count(lines_qa).first()[0] == 4
    assert evaluation.stored_qa_count(spark, "no_such_table").first()[0] == 0
    lines_qa.createOrReplaceTempView("qa_table")
    assert evaluation.stored_qa_count(spark, "qa_table").first()[0] == 4


def test_generate_qa(spark, lines):
    def quoting():
        return lambda batch: [f'"no" "Who or what is {a}?" "x' for a in batch["answer"]]

    for n, expected in ((4, 4), (30, 12)):
        made = generate_qa(lines, n, quoting, fmt=3).collect()
        assert sorted(r["id"] for r in made) == sorted(f"nt-{i}" for i in range(expected))
        cells = set(LINES.to_numpy().ravel())
        assert all(r["utterance"] == f"Who or what is {r['targetValue']}?" and r["targetValue"] in cells for r in made)
        assert len({r["targetValue"] for r in made}) >= expected - 1  # one place is there twice


def test_batches_hold_rows_of_one_backend(spark):
    """A full batch per backend, where the types alternate, and each row's own answer."""
    from cellquery.operators.prediction import predict_by_type

    def backend(name):
        return lambda: lambda batch: [f"{name}{len(batch)}:{q}" for q in batch["question"]]

    asked = spark.range(0, 80, 1, 1).selectExpr("if(id % 2 = 0, 'a', 'b') AS model_type", "cast(id AS string) AS question")
    told = predict_by_type(asked, {"a": backend("a"), "b": backend("b")}, "a", batch_size=5).collect()
    assert sorted((r.completion, r.error) for r in told) == sorted((f"{'ab'[n % 2]}5:{n}", None) for n in range(80))


def test_questions_are_dealt_before_they_are_multiplied(spark):
    from cellquery.plans.evaluation import prompt_table

    models = spark.createDataFrame([("m", "base", 0), ("k", "base", None)], "name string, model_type string, prompt_format int")
    qa = spark.createDataFrame([("nt-0", "q?", "t"), ("nt-0", "r?", "t"), ("nt-1", "s?", None)], "id string, utterance string, context string")
    cells = spark.createDataFrame([("t", 0, 0, "c", "v")], "table_id string, row_idx int, col_idx int, col_name string, cell string")
    asked = prompt_table(models, qa, cells, seeds=2, tasks=3)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Repartition 3")
    rows = sorted((r.model, r.seed, r.question, r.table) for r in asked.collect())
    assert rows == sorted((m, s, q, "c\nv\n") for m in "mk" for s in (0, 1) for q in ("q?", "r?"))
