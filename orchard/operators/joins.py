"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound on rows of a side we broadcast after counting it.
BROADCAST_MAX_ROWS = 1_000_000


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``small`` only when it really is small.  The count runs on
    the (already reduced) side; beyond ``max_rows`` the side is returned as
    is and the join shuffles, with AQE splitting skewed partitions."""
    small = small.cache()          # the count materialises it; the join reuses it
    n = small.count()
    return F.broadcast(small) if n <= max_rows else small
