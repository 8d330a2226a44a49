"""Text expressions shared by every operator.

Spark's ``trim`` strips U+0020 only and a Java ``\\s`` is ASCII only, so all
white-space handling goes through one explicit character class.
"""

from pyspark.sql import Column, functions as F

_SPACES = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{_SPACES}]"
NOT_LINE_END = r"[^\n\r\u2028\u2029]"


_SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_all(text: Column) -> Column:
    """Strip every kind of Unicode white space from both ends."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(_SPACE_CHARS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACE_CHARS))


def is_blank(text: Column) -> Column:
    """True for null and for text made of white space only."""
    return text.isNull() | (trim_all(text) == "")


def collapse(text: Column) -> Column:
    """Lower-case, runs of white space to one blank, trimmed: the form texts are compared in."""
    return F.trim(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only, the order used for name lists (other letters keep their case)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quote(text: Column) -> Column:
    """Turn a value into a regex that matches it literally."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


_NOT_HEX = b"\0" * 33


def packed(digest: Column) -> Column:
    """A lower-case hex SHA-256 as its 32 bytes, so that half as much is shuffled; any other text as more than 32 bytes."""
    plain = F.concat(F.lit(bytearray(_NOT_HEX)), digest.cast("binary"))
    return F.when(F.rlike(digest, F.lit(r"^[0-9a-f]{64}\z")), F.unhex(digest)).otherwise(plain)


def unpacked(code: Column) -> Column:
    """The text that ``packed`` was given."""
    plain = F.substring(code, len(_NOT_HEX) + 1, 2**31 - 1).cast("string")
    return F.when(F.length(code) == 32, F.lower(F.hex(code))).otherwise(plain)
