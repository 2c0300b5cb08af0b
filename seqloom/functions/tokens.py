"""Observations on single tokens. Letters and digits are those of ASCII; anything else is a symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# fixed values: characters and the class that a shape shows for them
SHAPES = [(UPPER, "U"), (LOWER, "L"), (DIGIT, "D"), (".,", "."), (";:?!", ";"), ("+-*/=|_", "-"), ("({[<", "("), (")}]>", ")")]
SHAPE_FROM = "".join(chars for chars, _ in SHAPES)
SHAPE_TO = "".join(to * len(chars) for chars, to in SHAPES)

# fixed values: types in order of precedence, with the characters that a token of the type consists of
TYPES = [
    ("AllUpper", "^[A-Z]+$"),
    ("AllDigit", "^[0-9.,]+$"),
    ("AllSymbol", "^[^A-Za-z0-9.,]+$"),
    ("AllUpperDigit", "^[A-Z0-9.,]+$"),
    ("AllUpperSymbol", "^[^a-z0-9.,]+$"),
    ("AllDigitSymbol", "^[^A-Za-z]+$"),
    ("AllUpperDigitSymbol", "^[^a-z]+$"),
    ("InitUpper", "^[A-Z]"),
    ("AllLetter", "^[A-Za-z]+$"),
    ("AllAlnum", "^[A-Za-z0-9.,]+$"),
]

# fixed values: yes-or-no observations by pattern
FLAGS = {
    "two_digits": "^[0-9]{2}$",
    "four_digits": "^[0-9]{4}$",
    "digits_letters": "^(?:[0-9]+[A-Za-z]|[A-Za-z]+[0-9])[A-Za-z0-9]*$",
    "digits_dash": "^(?:[0-9]+-|-+[0-9])[0-9-]*$",
    "digits_slash": "^(?:[0-9]+/|/+[0-9])[0-9/]*$",
    "digits_comma": "^(?:[0-9]+,|,+[0-9])[0-9,]*$",
    "digits_dot": "^(?:[0-9]+[.]|[.]+[0-9])[0-9.]*$",
    "all_other": "^[^A-Za-z0-9]*$",
    "cap_period": "^[A-Z][.]$",
    "init_upper": "^[A-Z]",
    "all_upper": "^[A-Z]+$",
    "all_lower": "^[a-z]+$",
    "has_upper": "[A-Z]",
    "has_lower": "[a-z]",
    "has_letter": "[A-Za-z]",
    "has_digit": "[0-9]",
    "has_symbol_strict": "[^A-Za-z0-9]",
    # holds for every token that is not empty; the strict form is above
    "has_symbol": "^.",
}


def shape(token: Column) -> Column:
    """One class letter per character; characters of no class stay."""
    return F.translate(token, SHAPE_FROM, SHAPE_TO)


def degenerate(text: Column) -> Column:
    """Each run of one character as a single one."""
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")


def token_type(token: Column) -> Column:
    """The first type whose pattern fits; EMPTY, or NO if none does."""
    out = F.when(token == "", "EMPTY")
    for name, pattern in TYPES:
        out = out.when(token.rlike(pattern), name)
    return out.otherwise("NO")


def yes_no(condition: Column) -> Column:
    return F.when(condition, "yes").otherwise("no")


def flag(token: Column, name: str) -> Column:
    return yes_no(token.rlike(f"(?s){FLAGS[name]}"))


def prefix(token: Column, n: int, default: str = "") -> Column:
    return F.when(F.length(token) >= n, F.left(token, F.lit(n))).otherwise(default)


def suffix(token: Column, n: int, default: str = "") -> Column:
    return F.when(F.length(token) >= n, F.right(token, F.lit(n))).otherwise(default)


def escape_attribute(text: Column) -> Column:
    """Colons as text that the column format does not read as a value's mark."""
    return F.replace(text, F.lit(":"), F.lit("__COLON__"))
