"""Column functions for text that must agree with Unicode-aware line and blank rules.

Java's ``\\s`` and Spark's ``trim`` know ASCII blanks only; here a blank is any Unicode white space
or one of the four information separators, and a line ends at any of ``LINE_ENDS``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A blank inside a Java pattern, within brackets; patterns that use it need the flag U.
BLANK = r"\s\x1c-\x1f"
LINE_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


#: The same blanks, one by one.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without blanks around. Trimming looks at a text's ends only; a pattern would be tried at every character."""
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def lines(c: Column) -> Column:
    """The lines of a text, without a last empty one; an empty text has none."""
    parts = F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), f"[{LINE_ENDS}]", -1)
    # Bound: beside array lambdas expressions are interpreted, and each mention of the parts would split the text again.
    return F.get(F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)), F.lit(0))


def literal(c: Column) -> Column:
    """A text made safe as the replacement of ``regexp_replace``."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def starts_with_any(c: Column, *marks: str) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | c.startswith(mark)
    return out


def ends_with_any(c: Column, *marks: str) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | c.endswith(mark)
    return out
