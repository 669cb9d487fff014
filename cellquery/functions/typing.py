"""Cell types of a table held as ``array<array<string>>``, and the text a typed cell reads as.

A column's type needs all its cells. They sit in one row of the nested form, so array functions
find it without a shuffle; the long form is made afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellquery.functions.text import WHITESPACE, strip

# Texts that read as null or as a truth value.
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOL_TEXTS = ["True", "TRUE", "true", "False", "FALSE", "false"]

_NULL, _INT, _FLOAT, _BOOL, _TEXT = range(5)
_SPACES = f"[{WHITESPACE}]*"
_INT_SHAPE = rf"^{_SPACES}[-+]?[0-9]+{_SPACES}$"
_FLOAT_SHAPE = rf"^{_SPACES}[-+]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|(?i:inf|infinity)){_SPACES}$"


def plain_number(c: Column, decimal: str, thousands: str | None) -> Column:
    """Numbers in the table's format rewritten with a point and no separators; other text as it is.

    Text without a mark stays as it is whatever its shape, which is not looked at then.
    """
    exponent = r"([0-9]?[Ee]-?[0-9]+)?$"
    point = rf"(\Q{decimal}\E[0-9]*)?"
    if thousands is not None:
        mark = rf"\Q{thousands}\E"
        grouped = rf"^[-+]?(?:[0-9]+{mark})*+[0-9]*{point}{exponent}"
        c = F.when(c.contains(thousands) & c.rlike(grouped), F.replace(c, F.lit(thousands), F.lit(""))).otherwise(c)
    if decimal != ".":
        shape = rf"^[-+]?[0-9]*{point}{exponent}"
        c = F.when(c.contains(decimal) & c.rlike(shape), F.replace(c, F.lit(decimal), F.lit("."))).otherwise(c)
    return c


def _cell_code(c: Column) -> Column:
    return (
        F.when(c.isNull() | c.isin(NULL_TEXTS), _NULL)
        .when(c.rlike(_INT_SHAPE), _INT)
        .when(c.rlike(_FLOAT_SHAPE), _FLOAT)
        .when(c.isin(BOOL_TEXTS), _BOOL)
        .otherwise(_TEXT)
    )


def coded_rows(rows: Column, decimal: str, thousands: str | None) -> Column:
    """Every cell as ``struct(text, code)``."""
    return F.transform(
        rows,
        lambda row: F.transform(
            F.transform(row, lambda c: plain_number(c, decimal, thousands)),
            lambda c: F.struct(c.alias("text"), _cell_code(c).alias("code")),
        ),
    )


def column_types(coded: Column, n_cols: Column) -> Column:
    """``array<string>`` of int, float, bool or text for the columns of ``coded_rows``."""
    def of_column(j: Column) -> Column:
        return F.array_distinct(F.transform(coded, lambda r: F.get(r, j)["code"]))

    def name(codes: Column) -> Column:
        has = lambda code: F.array_contains(codes, code)
        return (
            F.when(has(_TEXT) | (F.size(codes) == 0), "text")
            .when(has(_BOOL), F.when(F.size(codes) == 1, "bool").otherwise("text"))
            .when(has(_INT) & (F.size(codes) == 1), "int")
            .otherwise("float")
        )

    positions = F.when(n_cols > 0, F.sequence(F.lit(0), n_cols - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(F.transform(positions, of_column), name)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def int_text(c: Column) -> Column:
    """Canonical text of a whole number: no plus sign, no leading zeros."""
    bare = F.regexp_replace(strip(c), r"^([-]?)\+?0*([0-9])", "$1$2")
    return let(bare, lambda b: F.when(b == "-0", F.lit("0")).otherwise(b))


def _rounded(x: Column, digits: int) -> Column:
    """A whole number of up to 19 digits, rounded to so many, as ``d.ddde+XX``."""
    size = F.length(x.cast("string"))
    unit = F.when(size > digits, F.pow(F.lit(10.0), size - digits)).otherwise(F.lit(1.0)).cast("bigint")
    nearest = let(unit, lambda u: let(x + F.shiftright(u, 1), lambda y: (y - F.pmod(y, u)).cast("string")))
    power = lambda t: F.lpad((F.length(t) - 1).cast("string"), 2, "0")
    return let(nearest, lambda t: F.concat(F.substring(t, 1, 1), F.lit("."), F.substring(t, 2, 19), F.lit("e+"), power(t)))


def _shortest(d: Column) -> Column:
    """A positive double as ``d.ddde+XX`` with the fewest of 15, 16 or 17 digits that read back as it.

    Java writes a few large whole numbers with other last digits than the nearest ones, so those that
    fit in a long are rounded as longs. Numbers under 1e-307 keep Java's digits.
    """

    def first(forms: list[Column]) -> Column:
        right = [let(form, lambda f: F.when(f.try_cast("double") == d, f)) for form in forms[:-1]]
        return F.coalesce(*right, forms[-1])

    whole = let(d.cast("bigint"), lambda x: first([_rounded(x, n) for n in (15, 16, 17)]))
    return F.when((d >= float(1 << 53)) & (d < 9e18), whole).otherwise(first([F.format_string(f"%.{n}e", d) for n in (14, 15, 16)]))


def _spelled(form: Column) -> Column:
    """``d.ddde+XX`` in the usual way: as it is from 1e-4 to 1e16, else with an exponent."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(form, r"([0-9.]+)e", 1), r"\.", ""), r"(?<=.)0+$", "")
    parts = F.struct(digits.alias("digits"), F.regexp_extract(form, r"e([-+][0-9]+)$", 1).cast("int").alias("power"))

    def text(p: Column) -> Column:
        digits, power, n = p["digits"], p["power"], F.length(p["digits"])
        rest = lambda at: F.when(n > at, F.substring(digits, at + 1, n)).otherwise("0")
        above = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, "0"), F.lit("."), rest(power + 1))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        mantissa = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""))
        size = F.abs(power).cast("string")
        exponent = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.length(size), F.lit(2)), "0"))
        return F.when((power >= 16) | (power < -4), exponent).when(power >= 0, above).otherwise(below)

    return let(parts, text)


def _rounded_text(bare: Column) -> Column:
    """The text of a number that only a double tells."""
    sign = F.when(F.startswith(bare, F.lit("-")), "-").otherwise("")
    digits = lambda d: F.when(F.abs(d) < float("inf"), _shortest(F.abs(d)))
    return F.concat(sign, F.coalesce(let(let(bare.try_cast("double"), digits), _spelled), F.lit("inf")))


def _float_text(bare: Column) -> Column:
    parts = F.struct(
        F.regexp_extract(bare, r"^[-+]?0*([0-9]*)", 1).alias("whole"),
        F.regexp_extract(bare, r"\.([0-9]*?)0*$", 1).alias("part"),
    )

    def text(p: Column) -> Column:
        whole, part = p["whole"], p["part"]
        plain = F.concat(
            F.when(F.startswith(bare, F.lit("-")), "-").otherwise(""),
            F.when(whole == "", "0").otherwise(whole),
            F.lit("."),
            F.when(part == "", "0").otherwise(part),
        )
        short = (F.length(whole) + F.length(part) <= 15) & ~((whole == "") & part.startswith("0000"))
        return F.when(short & bare.rlike(r"^[-+]?[0-9]*\.?[0-9]*$"), plain).otherwise(_rounded_text(bare))

    return let(parts, text)


def float_text(c: Column) -> Column:
    """Text of a floating point number: shortest digits, always a point or an exponent.

    Up to 15 digits the cleaned decimal text already is that; longer ones and exponents go through
    a double.
    """
    return let(F.lower(strip(c)), _float_text)


def typed_text(cell: Column, col_type: Column) -> Column:
    """The cell as its column's type prints it; null stays null."""
    return (
        F.when(cell.isNull(), F.lit(None).cast("string"))
        .when(col_type == "int", int_text(cell))
        .when(col_type == "float", float_text(cell))
        .otherwise(cell)
    )
