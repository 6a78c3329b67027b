"""Byte-exact text handling through a Latin-1 view.

Every byte of the content becomes one character, so expressions written for
strings (regexes, positions, substrings) count bytes.  ``back`` returns such a
view to text without ever raising on a split code point.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def view(content: Column | str) -> Column:
    """The bytes of a string or binary column as one character each."""
    col = F.col(content) if isinstance(content, str) else content
    return F.decode(col.cast("binary"), "ISO-8859-1")


def back(col: Column) -> Column:
    """Text whose UTF-8 bytes are the characters of a Latin-1 view."""
    return F.encode(col, "ISO-8859-1").cast("string")


def literal(text: str) -> str:
    """A pattern or literal put through the same view (driver side)."""
    return text.encode("utf-8", "surrogateescape").decode("latin-1")
