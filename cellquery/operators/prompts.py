"""Prompt texts: chat formats, answer prompts, question-generation prompts, rewriting prompts."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellquery.operators.questions import question_number

# Chat formats by number. I is the instruction, B the body, O the opener.
FORMATS = {"DEFAULT": -1, "MICROSOFT": 0, "LLAMA2HUN": 1, "LLAMA2": 2, "LLAMA3": 3}
WRAPPERS = {
    -1: "{I}\n\n{B}\n\n{O}",
    0: "<|system|>\n{I}<|end|>\n<|user|>\n{B}<end>\n<|assistant|>\n{O}",
    1: "<|system|>\n{I}</s><|end|>\n<|user|>\n{B}</s><end>\n<|assistant|>\n{O}",
    2: "[INST] <<SYS>>\n{I}\n<</SYS>>\n{B}[/INST]\n{O}",
    3: "<|im_start|>system\n{I}<|im_end|>\n<|im_start|>user\n{B}<|im_end|>\n<|im_start|>assistant\n{O}",
}

ANSWER_TEXTS = {
    "en": (
        "Below come a table as CSV lines and then a question. Reply with the cell values that settle it, "
        "nothing else; several values are separated by commas.",
        'The values are: "',
    ),
    "hu": (
        "Lent adatok állnak, utánuk egy kérdés. Amit kérdez, azt az adatok közül írd ki, mást ne tegyél "
        "hozzá; ha több érték kell, vessző válassza el őket.",
        'Kiírt érték: "',
    ),
}
QUESTION_TEXTS = {
    "en": (
        "Below come CSV lines. Think of something they tell, and ask for it so that only '{answer}' is right.",
        'Right reply / what is asked: "{answer}"/"',
    ),
    "hu": (
        "Adatok következnek. Mit kérdeznél róluk, ha ez a megoldás: '{answer}'? Egyetlen kérdést írj.",
        'Megoldás, majd kérdés: "{answer}"/"',
    ),
}
REWRITE_TEXT = (
    "Állítás; benne egy szó; és a kérdés, amelyből csak ez a szó hiányzik:\n"
    "A csomagot kedden adták fel; kedden; Melyik napon adták fel a csomagot?\n"
    "Folytasd a sort a hiányzó kérdéssel, a szó nem fordulhat elő benne:\n"
    "%s; %s; "
)


def _templates(body: str, texts: dict[str, tuple[str, str]]) -> list[tuple[int, str, str]]:
    rows = []
    for (number, wrapper), (lang, (instruction, opener)) in product(WRAPPERS.items(), texts.items()):
        parts = {"{I}": instruction, "{B}": body, "{O}": opener}
        for mark, part in parts.items():
            wrapper = wrapper.replace(mark, part)
        rows.append((number, lang, wrapper))
    return rows


def answer_templates() -> list[tuple[int, str, str]]:
    """Ten ``(format, language, template)`` with ``{table}`` and ``{question}`` places."""
    return _templates("{table}\n\n{question}", ANSWER_TEXTS)


def question_templates() -> list[tuple[int, str, str]]:
    """Ten ``(format, language, template)`` with ``{table}`` and ``{answer}`` places."""
    return _templates("{table}", QUESTION_TEXTS)


def _pieces(template: str, places: dict[str, Column]) -> list[str]:
    """A template cut at its places."""
    marks = "|".join(rf"\{{{name}\}}" for name in places)
    return [piece for piece in re.split(f"({marks})", template) if piece]


def _place(pieces: Column, places: dict[str, Column]) -> Column:
    """Fill the places of a template cut at them; a place name inside a filled-in text stays as it is."""

    def filled(piece: Column) -> Column:
        chosen = None
        for name, value in places.items():
            text = F.coalesce(value, F.lit(""))
            hit = piece == f"{{{name}}}"
            chosen = F.when(hit, text) if chosen is None else chosen.when(hit, text)
        return chosen.otherwise(piece)

    return F.array_join(F.transform(pieces, filled), "")


def _with_prompt(
    df: DataFrame, rows: list[tuple[int, str, str]], fmt: Column | int | None, lang: Column | str, places: dict[str, Column]
) -> DataFrame:
    """``df`` with ``prompt``: the template of each row's format and language, filled in.

    One format and language for all rows is a literal; otherwise the ten templates are broadcast.
    """
    if not isinstance(fmt, Column) and not isinstance(lang, Column):
        number = fmt if fmt in WRAPPERS else FORMATS["DEFAULT"]
        template = next(t for n, spoken, t in rows if (n, spoken) == (number, lang))
        return df.withColumn("prompt", _place(F.array(*map(F.lit, _pieces(template, places))), places))
    fmt = fmt if isinstance(fmt, Column) else F.lit(fmt).cast("int")
    lang = lang if isinstance(lang, Column) else F.lit(lang)
    known = F.when(fmt.isin(list(WRAPPERS)), fmt).otherwise(F.lit(FORMATS["DEFAULT"]))
    cut = [(number, spoken, _pieces(template, places)) for number, spoken, template in rows]
    templates = df.sparkSession.createDataFrame(cut, "_format int, _lang string, _template array<string>")
    keyed = df.withColumns({"_format": known, "_lang": lang})
    filled = keyed.join(F.broadcast(templates), ["_format", "_lang"])
    return filled.withColumn("prompt", _place(F.col("_template"), places)).drop("_format", "_lang", "_template")


def answer_prompt(df: DataFrame, fmt: Column | int | None = None, lang: Column | str = "en") -> DataFrame:
    """``df`` (``table, question``) with ``prompt``. Unknown and null formats are the default one."""
    places = {"table": F.col("table"), "question": F.col("question")}
    return _with_prompt(df, answer_templates(), fmt, lang, places)


def question_prompt(df: DataFrame, fmt: Column | int | None = None, lang: Column | str = "en") -> DataFrame:
    """``df`` (``table, answer``) with the ``prompt`` that asks for a question with that answer."""
    places = {"table": F.col("table"), "answer": F.col("answer")}
    return _with_prompt(df, question_templates(), fmt, lang, places)


def rewrite_prompt(sentence: Column, answer: Column) -> Column:
    """Few-shot prompt that asks for the sentence as a question."""
    return F.format_string(REWRITE_TEXT, sentence, answer)


def with_translation(qa: DataFrame, lines: DataFrame) -> DataFrame:
    """``qa`` with ``translation``: question ``nt-N`` takes line ``N`` of ``lines`` (``idx, text``)."""
    numbered = qa.withColumn("_idx", question_number(F.col("id")))
    translated = lines.select(F.col("idx").cast("bigint").alias("_idx"), F.col("text").alias("translation"))
    return numbered.join(translated, "_idx", "left").drop("_idx")
