"""Ways to join that leave many wide rows where they are, chosen by counted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Up to so many rows of a roster (some 150 bytes each) and so many repeated ids (some 60) are broadcast.
ROSTER_ROWS, REPEATED_IDS = 500_000, 2_000_000


def beside(roster: DataFrame) -> DataFrame:
    """A roster of one row an id, to be joined to many orders: broadcast, or, where it has too many rows, hashed, for which orders are shuffled but not sorted."""
    return roster.hint("broadcast" if roster.count() <= ROSTER_ROWS else "shuffle_hash")
