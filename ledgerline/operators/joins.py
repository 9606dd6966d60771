"""Join helpers: broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few machine words that may be sent to every executor (about 10 MB).
BROADCAST_ROWS = 300_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcasting if it has at most so many rows, else df as it is, for a shuffled join.

    It is counted first, so pass a written table or another cheap plan of narrow rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
