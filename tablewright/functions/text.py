"""Small text expressions shared by the row operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the texts that count as a number in an untyped comparison.
NUMBER_PATTERN = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"

# Strftime letters and the date pattern letters they stand for.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "f": "SSSSSS", "z": "xx",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "%": "%",
}
# What the text of each strftime letter looks like, where it is not two digits.
STRFTIME_TEXT = {
    "Y": r"\d{4}", "p": "[AaPp][Mm]", "j": r"\d{3}", "b": r"\p{L}+", "B": r"\p{L}+", "a": r"\p{L}+",
    "A": r"\p{L}+", "f": r"\d{6}", "z": r"[+-]\d{4}", "F": r"\d{4}-\d{2}-\d{2}", "T": r"\d{2}:\d{2}:\d{2}",
    "D": r"\d{2}/\d{2}/\d{2}", "R": r"\d{2}:\d{2}", "%": "%",
}


def strip(c: Column) -> Column:
    """Text of ``c`` without white space at either end; null stays null."""
    return F.btrim(c.cast("string"), F.lit(WHITE_SPACE))


def looks_numeric(c: Column) -> Column:
    return c.rlike(NUMBER_PATTERN)


def is_number_text(value: str) -> bool:
    return re.match(NUMBER_PATTERN, value) is not None


def java_pattern(fmt: str) -> str:
    """The date pattern of Spark for a strftime format such as ``%d/%m/%Y``."""
    out, literal, i = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'" if re.search("[A-Za-z'\\[\\]{}#]", literal) else literal)
            literal = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            letter = fmt[i + 1]
            if letter not in STRFTIME:
                raise ValueError(f"date format %{letter} is not supported")
            if letter == "%":
                literal += "%"
            else:
                flush()
                out.append(STRFTIME[letter])
            i += 2
        else:
            literal += fmt[i]
            i += 1
    flush()
    return "".join(out)


def date_text(c: Column, fmt: str) -> Column:
    """The part of a text that looks like a date in ``fmt``; null where there is none."""
    pattern = re.sub(r"%(.)|([^%]+)", lambda m: STRFTIME_TEXT.get(m[1], r"\d{2}") if m[1] else
                     "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in m[2]), fmt)
    return F.nullif(F.regexp_extract(c.cast("string"), pattern, 0), F.lit(""))


# What an XML name may begin with, and what else it may hold; colons, which mark
# name spaces, and full stops are left out.
XML_BEGIN = ("A-Z_a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f"
             "\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff")
XML_MORE = "0-9\u00b7\u0300-\u036f\u203f-\u2040-"


def tag_name(name: str) -> str:
    """An XML element name for a column: what a name may not hold becomes ``_``, and ``col_``
    goes before what a name may not begin with."""
    legal = re.sub(f"[^{XML_BEGIN}{XML_MORE}]", "_", name)
    return legal if re.match(f"[{XML_BEGIN}]", legal) else "col_" + legal


def quoted(name: str) -> str:
    """A column name quoted so that dots and spaces in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))
