"""Small helpers on tables: measured broadcasts and prepared inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024


def measured(small: DataFrame, row_bytes: int, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` marked for broadcast if its counted rows stay below the limit, else as it is for an ordinary join.

    ``small`` must be cheap to read twice (a written table). The join gives the same rows either way.
    """
    return F.broadcast(small) if small.count() * row_bytes <= limit_bytes else small


def measured_bytes(small: DataFrame, column: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Like ``measured`` for a table with one long binary column."""
    total = small.agg(F.sum(F.octet_length(column) + 48)).first()[0] or 0
    return F.broadcast(small) if total <= limit_bytes else small
