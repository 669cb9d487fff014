"""Text rules: cleaning, sentences, words, masks, completions and answers.

The regular expressions spell their character classes out. ``\\w`` and ``\\b`` are avoided because
Java's Unicode version of them takes combining marks and leaves out number signs, and whitespace
includes the four ASCII separators U+001C to U+001F, which Java's does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NBSP = "\xa0"
MASK = "<mask>"
TOO_LONG = "Statement is too long."
AMBIGUOUS = "Multiple answer word found in the sentence."
MAX_STATEMENT = 512
STOP_TOKENS = [
    "<|", "<</", "[/INST]", "[INST]", "</s>", "\n", ". ", "</", "<|im_end|>", "|<", '"', '" ', '"\n',
]
NUMBER = (
    r"^\s*[-+]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][-+]?\d+(_\d+)*)?\s*$"
)
NUMBER_WORD = r"^\s*[-+]?(?i:inf|infinity|nan)\s*$"

_SPACE = r"[\s\x1C-\x1F]"
_WORD_CHAR = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    """Drop whitespace of any kind from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def occurrences(c: Column, part: Column) -> Column:
    """How often ``part`` is in ``c`` without overlap; 0 for an empty part."""
    removed = F.length(c) - F.length(F.replace(c, part, F.lit("")))
    return F.when(F.length(part) > 0, (removed / F.length(part)).cast("int")).otherwise(0)


# -- page text ---------------------------------------------------------------------------------


def normalize_dash(c: Column) -> Column:
    """En dash to hyphen."""
    return F.replace(c, F.lit("–"), F.lit("-"))


def strip_tags(c: Column) -> Column:
    """Delete ``<...>`` spans; a span never crosses a line feed (and only a line feed stops it)."""
    return F.regexp_replace(c, r"(?d)<.*?>", "")


def decimal_comma_to_point(c: Column) -> Column:
    """``3,5`` to ``3.5``; of ``1,234,567`` only the first comma of each pair changes."""
    return F.regexp_replace(c, r"(?U)(-?\d+),(\d+)", "$1.$2")


def paragraph_spans(c: Column, keep_tail: bool) -> Column:
    """All ``<p`` to ``</p>`` spans joined by a space, bare tags dropped, stripped.

    ``keep_tail`` reads an unclosed last ``<p`` to the end of the text, else it is dropped.
    """
    end = r"(?:</p>|\z)" if keep_tail else "</p>"
    spans = F.regexp_extract_all(c, F.lit(rf"(?s)<p.*?{end}"), F.lit(0))
    joined = F.array_join(spans, " ")
    bare = F.replace(F.replace(joined, F.lit("<p>"), F.lit("")), F.lit("</p>"), F.lit(""))
    return strip(bare)


def paragraph(c: Column) -> Column:
    """Paragraph text of a section: its spans without tags, decimal commas as points."""
    return decimal_comma_to_point(strip_tags(paragraph_spans(c, keep_tail=True)))


# -- sentences and words -----------------------------------------------------------------------


def sentences(c: Column, strict: bool = True) -> Column:
    """Array of sentences. The loose form also cuts after ``;`` and ``,``, clauses first, no repeats."""
    whole = F.split(c, rf"(?U)(?<=[.!?]){_SPACE}+")
    if strict:
        return whole
    return F.array_union(F.split(c, rf"(?U)(?<=[.!?;,]){_SPACE}+"), whole)


def words(c: Column) -> Column:
    """Distinct lowercase words; a word may hold one inner point, as in ``11.2``."""
    pattern = rf"{_WORD_CHAR}+(?:\.{_WORD_CHAR}+)?"
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)))


def is_number(c: Column) -> Column:
    """True where the text reads as a floating point number."""
    return c.rlike(NUMBER) | c.rlike(NUMBER_WORD)


# -- questions ---------------------------------------------------------------------------------


def _last_char_to_question_mark(c: Column) -> Column:
    return F.concat(F.substring(c, F.lit(1), F.greatest(F.length(c) - 1, F.lit(0))), F.lit("?"))


def mask_statement(statement: Column, answer: Column) -> Column:
    """Every occurrence of the answer masked, the last character replaced by ``?``."""
    return _last_char_to_question_mark(F.replace(statement, answer, F.lit(MASK)))


def mask_prompt(masked: Column, answer: Column, labels: tuple[str, str] = ("Question", "Answer")) -> Column:
    """Two-line input of a mask-fill model: the labelled question, then the labelled answer.

    Labels should be in the language of the model.
    """
    asked, told = labels
    return F.concat(F.lit(f"{asked}: "), masked, F.lit(f"\n{told}: "), answer)


def fill_mask(masked: Column, token: Column) -> Column:
    """The token in place of the mask; the last character is again replaced by ``?``."""
    return _last_char_to_question_mark(F.replace(masked, F.lit(MASK), token))


def one_mask(masked: Column) -> Column:
    """True where the masked text holds exactly one mask."""
    return occurrences(masked, F.lit(MASK)) == 1


def question_guard(statement: Column, answer: Column, variant: str = "match") -> Column:
    """``struct(refused, question, valid)`` for statements that must not become a question.

    ``match``: anything but one mask is refused as (null, false). ``rework``: too long is refused
    as not valid, an ambiguous answer as *valid*. Where nothing is refused, the rest is null.
    """
    def verdict(refused: bool, question: str | None, valid: bool | None) -> Column:
        return F.struct(
            F.lit(refused).alias("refused"),
            F.lit(question).cast("string").alias("question"),
            F.lit(valid).cast("boolean").alias("valid"),
        )

    passed = verdict(False, None, None)
    if variant == "match":
        return F.when(one_mask(mask_statement(statement, answer)), passed).otherwise(
            verdict(True, None, False)
        )
    if variant == "rework":
        return (
            F.when(F.length(statement) > MAX_STATEMENT, verdict(True, TOO_LONG, False))
            .when(occurrences(statement, answer) != 1, verdict(True, AMBIGUOUS, True))
            .otherwise(passed)
        )
    raise ValueError(f"unknown guard variant: {variant}")


def is_question(c: Column) -> Column:
    """True where a completion ends in a question mark."""
    return F.endswith(c, F.lit("?"))


def extract_question(completion: Column) -> Column:
    """The last quoted span holding ``?``, else the whole completion."""
    quoted = F.regexp_extract_all(completion, F.lit(r'(?d)"(.*?)"'), F.lit(1))
    asked = F.filter(quoted, lambda q: F.contains(q, F.lit("?")))
    return F.coalesce(F.try_element_at(asked, F.lit(-1)), completion)


# -- completions -------------------------------------------------------------------------------


def cut_at_stop(c: Column, tokens: list[str] = STOP_TOKENS) -> Column:
    """Text before the first stop token, stripped."""
    pattern = "|".join(rf"\Q{t}\E" for t in tokens)
    return strip(F.split(c, pattern, 2).getItem(0))


def completion_answer(completion: Column, prompt: Column) -> Column:
    """The completion without the prompt it repeats, up to the first double quote."""
    rest = F.substring(completion, F.length(prompt) + 1, F.length(completion))
    return F.split_part(rest, F.lit('"'), F.lit(1))


# -- answers -----------------------------------------------------------------------------------


def truth_list(c: Column) -> Column:
    """Accepted answers: parts between ``,`` or ``|``."""
    return F.split(c, r"[,|]")


def answer_list(c: Column) -> Column:
    """Answers of a model: parts between ``,``."""
    return F.split(c, ",")


def _letters_and_spaces(c: Column, keep: str = "") -> Column:
    kept = F.regexp_replace(c, rf"(?U)[^\p{{L}}\p{{N}}_\s\x1C-\x1F{keep}]", "")
    return F.lower(F.replace(kept, F.lit(NBSP), F.lit("")))


def clean_tokens(c: Column) -> Column:
    """Lowercase tokens without punctuation; null and empty give an empty array."""
    tokens = F.split(_letters_and_spaces(c), rf"(?U){_SPACE}+")
    return F.coalesce(F.filter(tokens, lambda t: t != ""), F.array().cast("array<string>"))


def answer_keys(c: Column, separators: str = ",") -> Column:
    """The parts of ``c``, each as one string that two parts share exactly if their tokens are equal.

    The whole text is cleaned at once, only its separators are kept, and it is cut afterwards.
    """
    spaced = F.regexp_replace(_letters_and_spaces(c, separators), rf"(?U){_SPACE}+", " ")
    return F.transform(F.split(spaced, f"[{separators}]"), lambda part: F.btrim(part))


def truth_keys(c: Column) -> Column:
    """``answer_keys`` of accepted answers."""
    return answer_keys(c, ",|")


def key_score(truths: Column, answers: Column) -> Column:
    """Answers found among the accepted ones, over the number of accepted ones; both as keys.

    Repeated right answers all count, so a score can pass 1.
    """
    hits = F.filter(answers, lambda a: F.array_contains(truths, a))
    return F.size(hits) / F.size(truths)


def score(truths: Column, answers: Column) -> Column:
    """``key_score`` of two arrays of texts: an answer counts if its tokens equal those of a truth."""
    def key(c: Column) -> Column:
        return F.array_join(clean_tokens(c), " ")

    return F.element_at(
        F.transform(
            F.array(F.struct(F.transform(truths, key).alias("t"), F.transform(answers, key).alias("a"))),
            lambda both: key_score(both["t"], both["a"]),
        ),
        1,
    )
