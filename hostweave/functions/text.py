"""Words of a line."""

from pyspark.sql import Column, functions as F

# The characters of Unicode white space beyond ASCII.
WIDE_SPACES = (
    "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def plain_spaces(text: Column) -> Column:
    """Text with every wide space as a blank; ASCII text passes untouched."""
    return F.when(
        text.rlike(r"[^\x00-\x7F]"), F.translate(text, WIDE_SPACES, " " * len(WIDE_SPACES))
    ).otherwise(text)


def trimmed(text: Column) -> Column:
    """Text without Unicode white space around it; inner wide spaces are kept."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r" + WIDE_SPACES))


def words(line: Column) -> Column:
    """Runs of non-white-space; an empty list for a blank line."""
    return F.array_remove(F.split(plain_spaces(line), r"\s+"), "")
