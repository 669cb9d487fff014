"""Queries of single text rules: M1 to M3, Q1 to Q3, Q5, Q6, Q9, P5, P6, E1 to E3."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellquery.catalog import inputs
from cellquery.catalog.inputs import sql_count, sql_sentences, sql_strip, sql_words
from cellquery.catalog.registry import Registry, table
from cellquery.functions import text
from cellquery.operators import prompts
from cellquery.operators.matching import sentence_rows

QUERIES = Registry()
query = QUERIES.query


@query("m1_strict_sentences", f"WITH {inputs.SENTENCES} SELECT * FROM sentences")
def m1_strict_sentences(spark, folder):
    return sentence_rows(table(spark, folder, "documents"), "text", ["doc_id"])


_LOOSE = f"{sql_sentences('text', '[.!?;,]')}"


@query(
    "m2_loose_sentences",
    f"""SELECT DISTINCT doc_id, unnest(list_concat({_LOOSE}, {sql_sentences('text')})) AS sentence FROM documents""",
)
def m2_loose_sentences(spark, folder):
    return sentence_rows(table(spark, folder, "documents"), "text", ["doc_id"], strict=False).drop("sentence_idx")


@query("m3_words", f"SELECT doc_id, unnest({sql_words('text')}) AS word FROM documents")
def m3_words(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("word"))


def _statements(spark, folder):
    """Every sentence in lowercase, with its last word as the answer."""
    rows = sentence_rows(table(spark, folder, "documents"), "text", ["doc_id"])
    last = F.regexp_extract(F.lower("sentence"), rf"({inputs.WORD})[^\p{{L}}\p{{N}}_]*$", 1)
    return rows.select("doc_id", "sentence_idx", text.strip(F.lower("sentence")).alias("s"), last.alias("a"))


_STATEMENTS = rf"""{inputs.SENTENCES}, st AS (SELECT doc_id, sentence_idx, {sql_strip('lower(sentence)')} AS s,
  regexp_extract(lower(sentence), '({inputs.WORD})[^\p{{L}}\p{{N}}_]*$', 1) AS a FROM sentences),
masked AS (SELECT *, CASE WHEN a = '' THEN s ELSE replace(s, a, '<mask>') END AS r FROM st),
cut AS (SELECT *, left(r, greatest(length(r) - 1, 0)) || '?' AS m FROM masked)"""


@query(
    "q1_mask",
    f"WITH {_STATEMENTS} SELECT doc_id, sentence_idx, m AS masked, 'Sentence: ' || m || chr(10) || 'Word: ' || a AS prompt FROM cut",
)
def q1_mask(spark, folder):
    masked = text.mask_statement(F.col("s"), F.col("a"))
    return _statements(spark, folder).select(
        "doc_id", "sentence_idx", masked.alias("masked"), text.mask_prompt(masked, F.col("a"), ("Sentence", "Word")).alias("prompt")
    )


@query(
    "q2_guard_match",
    f"""WITH {_STATEMENTS} SELECT doc_id, sentence_idx, {sql_count('m', "'<mask>'")} <> 1 AS refused,
    CASE WHEN {sql_count('m', "'<mask>'")} <> 1 THEN false END AS valid FROM cut""",
)
def q2_guard_match(spark, folder):
    guard = text.question_guard(F.col("s"), F.col("a"), "match")
    return _statements(spark, folder).select("doc_id", "sentence_idx", guard.alias("_g")).select(
        "doc_id", "sentence_idx", "_g.refused", "_g.valid"
    )


@query(
    "q3_guard_rework",
    f"""WITH {_STATEMENTS}, g AS (SELECT doc_id, sentence_idx,
      CASE WHEN length(s) > 512 THEN 1 WHEN a = '' OR {sql_count('s', "nullif(a, '')")} <> 1 THEN 2 ELSE 0 END AS k FROM st)
    SELECT doc_id, sentence_idx, k > 0 AS refused,
      CASE k WHEN 1 THEN 'Statement is too long.' WHEN 2 THEN 'Multiple answer word found in the sentence.' END AS question,
      CASE k WHEN 1 THEN false WHEN 2 THEN true END AS valid FROM g""",
)
def q3_guard_rework(spark, folder):
    guard = text.question_guard(F.col("s"), F.col("a"), "rework")
    return _statements(spark, folder).select("doc_id", "sentence_idx", guard.alias("_g")).select(
        "doc_id", "sentence_idx", "_g.*"
    )


@query(
    "q5_fill_mask",
    f"""WITH {_STATEMENTS} SELECT doc_id, sentence_idx,
    left(replace(m, '<mask>', 'mi'), length(replace(m, '<mask>', 'mi')) - 1) || '?' AS question FROM cut""",
)
def q5_fill_mask(spark, folder):
    masked = text.mask_statement(F.col("s"), F.col("a"))
    return _statements(spark, folder).select(
        "doc_id", "sentence_idx", text.fill_mask(masked, F.lit("mi")).alias("question")
    )


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_REWRITE = prompts.REWRITE_TEXT.split("%s")


@query(
    "q6_rewrite_prompt",
    f"""SELECT doc_id, md5({_quote(_REWRITE[0])} || text || {_quote(_REWRITE[1])} || lang || {_quote(_REWRITE[2])}) AS prompt_md5,
    ends_with(replace(text, '.', '?'), '?') AS is_question FROM documents""",
)
def q6_rewrite_prompt(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.md5(prompts.rewrite_prompt(F.col("text"), F.col("lang"))).alias("prompt_md5"),
        text.is_question(F.replace("text", F.lit("."), F.lit("?"))).alias("is_question"),
    )


_COMPLETION = """('"' || replace(replace(text, ', ', '?", "'), '. ', '" and "') || '"')"""


@query(
    "q9_extract_question",
    f"""SELECT doc_id, coalesce(list_filter(regexp_extract_all({_COMPLETION}, '"(.*?)"', 1), lambda q: contains(q, '?'))[-1],
    {_COMPLETION}) AS question FROM documents""",
)
def q9_extract_question(spark, folder):
    asked = F.replace(F.replace("text", F.lit(", "), F.lit('?", "')), F.lit(". "), F.lit('" and "'))
    completion = F.concat(F.lit('"'), asked, F.lit('"'))
    return table(spark, folder, "documents").select("doc_id", text.extract_question(completion).alias("question"))


_STOPS = "|".join(
    t.replace("\n", r"\n").replace("|", r"\|").replace("[", r"\[").replace("]", r"\]").replace(".", r"\.")
    for t in text.STOP_TOKENS
)


@query(
    "p5_cut_at_stop",
    f"SELECT conv_id, turn, {sql_strip(f'regexp_split_to_array(text, {_quote(_STOPS)})[1]')} AS cut FROM conversations",
)
def p5_cut_at_stop(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", text.cut_at_stop(F.col("text")).alias("cut"))


@query(
    "p6_completion_answer",
    """SELECT conv_id, turn, split_part(replace(text, ',', '"'), '"', 1) AS answer FROM conversations""",
)
def p6_completion_answer(spark, folder):
    prompt = F.concat("role", F.lit(': "'))
    completion = F.concat(prompt, F.replace("text", F.lit(","), F.lit('"')))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", text.completion_answer(completion, prompt).alias("answer")
    )


_TARGET = "replace(replace(text, '.', '|'), ';', ',')"


@query(
    "e1_truth_list",
    f"SELECT conv_id, turn, unnest(range(len(t)))::INT AS i, unnest(t) AS truth FROM (SELECT conv_id, turn, regexp_split_to_array({_TARGET}, '[,|]') AS t FROM conversations)",
)
def e1_truth_list(spark, folder):
    target = F.replace(F.replace("text", F.lit("."), F.lit("|")), F.lit(";"), F.lit(","))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.posexplode(text.truth_list(target)).alias("i", "truth")
    )


@query(
    "e2_answer_list",
    "SELECT conv_id, turn, unnest(range(len(t)))::INT AS i, unnest(t) AS answer FROM (SELECT conv_id, turn, string_split(text, ',') AS t FROM conversations)",
)
def e2_answer_list(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.posexplode(text.answer_list(F.col("text"))).alias("i", "answer")
    )


@query(
    "e3_clean_tokens",
    rf"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(lower(replace(regexp_replace(text,
      '[^\p{{L}}\p{{N}}_\s]', '', 'g'), chr(160), '')), '\s+'), lambda t: t <> ''), ' ')) AS tokens_md5 FROM documents""",
)
def e3_clean_tokens(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(F.array_join(text.clean_tokens(F.col("text")), " ")).alias("tokens_md5")
    )
