"""Text cleaning expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a cell.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)

UNSPECIFIED = "Unspecified"


# Text whose first and last characters are visible ASCII needs no stripping.
_MAY_NEED_STRIPPING = r"^[^!-~]|[^!-~]\z"
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"


# What stands at the ends of most cells. Trimming costs as much as the set has characters, so this one goes first.
_USUAL_SPACE = " \t\n\r"


def stripped(c: Column) -> Column:
    near = F.btrim(c, F.lit(_USUAL_SPACE))
    return F.when(near.rlike(_MAY_NEED_STRIPPING), F.btrim(near, F.lit(WHITE_SPACE))).otherwise(near)


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(_VISIBLE)


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def plain_words(c: Column) -> Column:
    """Lower-case words of a free text, one space apart; NULL when no letter is left.

    Every run of other characters, white space included, becomes a single space.
    """
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " ")), F.lit(""))


def or_unspecified(c: Column) -> Column:
    """The untouched value, or a fixed word where it is missing or blank."""
    return F.when(is_blank(c), F.lit(UNSPECIFIED)).otherwise(c)
