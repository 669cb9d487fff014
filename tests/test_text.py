"""Golden vectors of the column functions, and the same rules in plain Python over real text."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellquery.functions import text
from conftest import SMALL

NBSP = "\xa0"


def apply(spark, function, *rows):
    """Values of ``function`` over rows of string columns, in order."""
    width = len(rows[0])
    names = [f"c{k}" for k in range(width)]
    schema = "i int, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    done = df.select("i", function(*[F.col(n) for n in names]).alias("out")).orderBy("i")
    return [r["out"] for r in done.collect()]


def test_page_text(spark):
    assert apply(spark, text.normalize_dash, ("1990–91",)) == ["1990-91"]
    assert apply(spark, text.decimal_comma_to_point, ("1,234,567 -5,5 ja,nem",)) == ["1.234,567 -5.5 ja,nem"]
    assert apply(spark, text.strip_tags, ("a<b>c</b>\n<i\n>d <u >e",)) == ["ac\n<i\n>d e"]
    spans = "x<p>A <b>1,5</b></p>y<p class='q'>B</p>z<p>C"
    assert apply(spark, text.paragraph, (spans,)) == ["A 1.5 B C"]
    by_id = apply(spark, lambda c: text.paragraph_spans(c, keep_tail=False), (spans,))
    assert by_id == ["A <b>1,5</b> <p class='q'>B"]


def test_sentences_and_words(spark):
    assert apply(spark, text.sentences, ("A b.  C d! E",), ("",), ("A. ",)) == [
        ["A b.", "C d!", "E"], [""], ["A.", ""],
    ]
    loose = apply(spark, lambda c: text.sentences(c, strict=False), ("a, b. c",))
    assert loose == [["a,", "b.", "c", "a, b."]]
    assert set(apply(spark, text.words, ("11.2 °C, a.b.c -5",))[0]) == {"11.2", "c", "a.b", "5"}


def test_numbers(spark):
    kept = ["1e5", "1_000", "nan", "-3.2", " 7 ", "inf", "-Infinity", ".5", "5."]
    dropped = ["5d", "1__0", "1e", "", "_1", "1_", "0x10", "e5", "."]
    for value in kept:
        float(value)
    for value in dropped:
        with pytest.raises(ValueError):
            float(value)
    got = apply(spark, text.is_number, *[(v,) for v in kept + dropped])
    assert got == [True] * len(kept) + [False] * len(dropped)


def test_mask_and_fill(spark):
    masked = apply(spark, text.mask_statement, ("az ég kék.", "kék"), ("15 és 5.", "5"), ("x y", "y"))
    assert masked == ["az ég <mask>?", "1<mask> és <mask>?", "x <mask?"]
    assert apply(spark, text.fill_mask, ("az ég <mask>?", "mi")) == ["az ég mi?"]
    assert apply(spark, text.mask_prompt, ("az ég <mask>?", "kék")) == ["Question: az ég <mask>?\nAnswer: kék"]
    guard = lambda variant: lambda s, a: text.question_guard(s, a, variant)
    match = apply(spark, guard("match"), ("15 és 5.", "5"), ("az ég kék.", "kék"), ("x y", "y"), ("a.", ""))
    assert [tuple(r) for r in match] == [
        (True, None, False), (False, None, None), (True, None, False), (True, None, False),
    ]
    rework = apply(spark, guard("rework"), ("15 és 5.", "5"), ("é" * 513, "5"), ("é" * 511 + "5", "5"))
    assert [tuple(r) for r in rework] == [
        (True, text.AMBIGUOUS, True), (True, text.TOO_LONG, False), (False, None, None),
    ]


@pytest.mark.parametrize(
    "statement,answer",
    [("Ára 4.25 euró, kilónként.", "4.25"), ("Holnaptól három busz késik", "busz")],
)
def test_question_properties(spark, statement, answer):
    question = apply(
        spark, lambda s, a: text.fill_mask(text.mask_statement(s, a), F.lit("mi")), (statement, answer)
    )[0]
    assert question.endswith("?") and text.MASK not in question and answer not in question


def test_completions(spark):
    assert apply(spark, text.extract_question, ('x "A?" y "no" z "B?"',), ("none",), ('"no"',)) == [
        "B?", "none", '"no"',
    ]
    cut = apply(spark, text.cut_at_stop, (" a b. c",), ("a</s>b",), ('x"',), ("plain",), ("\nq",))
    assert cut == ["a b", "a", "x", "plain", ""]
    assert apply(spark, text.completion_answer, ('ask: "yes" no', "ask: "), ("pq", "p")) == ["", "q"]
    assert apply(spark, text.is_question, ("a?",), ("a",)) == [True, False]


def test_answers(spark):
    assert apply(spark, text.truth_list, ("x|y,z",), ("",)) == [["x", "y", "z"], [""]]
    assert apply(spark, text.answer_list, ("a, b|c",)) == [["a", " b|c"]]
    tokens = apply(
        spark,
        text.clean_tokens,
        (f"x{NBSP}y  Z",), (None,), ("²",), ("p\x1cq",), ("  -- ",), ("v1.2, V3",), ("Ő/Ű;\tö",),
    )
    assert tokens == [["xy", "z"], [], ["²"], ["p", "q"], [], ["v12", "v3"], ["őű", "ö"]]


@pytest.mark.parametrize(
    "truths,answers,expected",
    [
        (["a b", "c"], ["c", " A b!"], 1.0),
        (["c"], ["c", "C", "c."], 3.0),
        (["c", "d"], ["c"], 0.5),
        ([""], ["", "!"], 2.0),
    ],
)
def test_score(spark, truths, answers, expected):
    df = spark.createDataFrame([(truths, answers)], "t array<string>, a array<string>")
    assert df.select(text.score(F.col("t"), F.col("a"))).first()[0] == expected
    upper = df.select(text.score(F.col("t"), F.transform("a", F.upper))).first()[0]
    assert upper == expected


def test_same_as_python_over_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = docs.select(
        "text",
        text.sentences(F.col("text")).alias("strict"),
        text.sentences(F.col("text"), strict=False).alias("loose"),
        text.words(F.col("text")).alias("words"),
        text.clean_tokens(F.col("text")).alias("tokens"),
    ).collect()
    for row in got:
        strict = re.split(r"(?<=[.!?])\s+", row["text"])
        loose = re.split(r"(?<=[.!?;,])\s+", row["text"])
        assert row["strict"] == strict
        assert set(row["loose"]) == set(strict + loose)
        assert set(row["words"]) == set(re.findall(r"\b\w+(?:\.\w+)?\b", row["text"].lower()))
        cleaned = re.sub(r"[^\w\s]", "", row["text"]).replace(NBSP, "").strip().lower().split()
        assert row["tokens"] == cleaned


def test_answer_keys(spark):
    values = ("Ez.egy  FURA, b!|c,,", "", None, " a | b,c\xa0d ")
    got = apply(spark, text.answer_keys, *[(v,) for v in values])
    assert got == [["ezegy fura", "bc", "", ""], [""], None, ["a b", "cd"]]
    got = apply(spark, text.truth_keys, *[(v,) for v in values])
    assert got == [["ezegy fura", "b", "c", "", ""], [""], None, ["a", "b", "cd"]]


def test_keys_score_as_token_lists(spark):
    docs = spark.read.parquet(f"{SMALL}/conversations.parquet").select(
        "text", F.lag("text").over(Window.orderBy("conv_id", "turn")).alias("other")
    ).na.fill("")
    both = docs.select(
        text.key_score(text.truth_keys(F.col("text")), text.answer_keys(F.concat_ws(",", "other", F.upper("text")))).alias("keys"),
        text.score(text.truth_list(F.col("text")), text.answer_list(F.concat_ws(",", "other", F.upper("text")))).alias("lists"),
    ).collect()
    assert any(r["keys"] for r in both) and all(r["keys"] == r["lists"] for r in both)
