"""What several operators share: word splitting, checked broadcasts, and tables in the shared folder (from ethoframe.shared)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoframe.shared import materialize, shared_dir

__all__ = ["BROADCAST_ROWS", "SPACE_SEPARATORS", "TEXT_SEPARATORS", "UPPER", "ascii_lower", "bound", "broadcast_up_to", "materialize", "shared_dir", "words_of"]

#: Separators of words made of ASCII letters, digits and anything beyond ASCII; upper case is kept apart by ascii_lower().
TEXT_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Separators of words between ASCII white space.
SPACE_SEPARATORS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A relation of at most this many short rows may be broadcast.
BROADCAST_ROWS = 500_000


def broadcast_up_to(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if its counted rows are within the limit; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged (lower() would change letters beyond ASCII too)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column, separators: str) -> Column:
    """The words between separators; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators, -1), "")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use() names it."""
    return F.transform(F.array(value), use)[0]
