"""Text as columns: trimming, blank to null, escaping, characters that XML forbids.

All are built-in expressions, so they stay inside Spark's generated code, and a filter on
their source columns still reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import errors

#: White space as Unicode defines it; what Spark's and Python's own trimming call so differs.
SPACES = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EDGES = f"^[{SPACES}]+|[{SPACES}]+$"
#: Its characters.  Trimmed by them, only a text's edges are looked at, not each character of it.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: One character outside XML 1.0's range, or a non-character.
FORBIDDEN = r"[^\x{09}\x{0A}\x{0D}\x{20}-\x{D7FF}\x{E000}-\x{FDCF}\x{FDF0}-\x{FFFD}" + "".join(rf"\x{{{p:X}0000}}-\x{{{p:X}FFFD}}" for p in range(1, 17)) + "]"
#: The same for Spark's regular expressions: most characters pass by one range, not by each in turn.
FORBIDDEN_FAST = rf"[[^\x{{20}}-\x{{D7FF}}]&&{FORBIDDEN}]"

ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}
#: White space that XML's readers would change if it stood there as it is.
REFERENCES = {"\r": "&#13;", "\n": "&#10;", "\t": "&#9;"}
#: What the document writer escapes, in text and in attributes.
IN_TEXT, IN_ATTRIBUTE = "&<>\r", '&<>"\r\n\t'


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def optional(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trim(text), F.lit(""))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(f"[^{SPACES}]"), F.lit(False))


def has_space(text: Column) -> Column:
    return text.rlike(f"[{SPACES}]")


def checked(value: Column, error: Column) -> Column:
    """A value and what is wrong with it; a rejected value is null."""
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def required(text: Column, message: str) -> Column:
    value = optional(text)
    return checked(value, F.when(value.isNull(), F.lit(message)))


def field(text: Column, name: str) -> Column:
    return required(text, errors.FIELD.format(name))


def escape(text: Column, which: str = "".join(ENTITIES)) -> Column:
    """Entities for the characters in ``which``; what is escaped already is escaped again."""
    for c, entity in (ENTITIES | REFERENCES).items():  # the ampersand comes first
        if c in which:
            text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def first_forbidden(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, FORBIDDEN_FAST, 0), F.lit(""))


def has_forbidden(text: Column) -> Column:
    return text.rlike(FORBIDDEN_FAST)


def code_point(character: Column) -> Column:
    """U+ and at least four hexadecimal digits."""
    return F.format_string("U+%04X", F.ascii(character))


def forbidden_error(text: Column) -> Column:
    return F.when(has_forbidden(text), F.concat(F.lit(errors.FORBIDDEN), code_point(first_forbidden(text))))
