"""Small tables that are fetched once, so that their plans don't run again and joins with them shuffle nothing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.paths import shared_folder

#: Rows that the driver takes at most.
FEW = 200_000


def fetched(df: DataFrame, most: int = FEW) -> pa.Table | None:
    """The rows, or None if there are more."""
    rows = df.limit(most + 1).toArrow()
    return rows if rows.num_rows <= most else None


def settled(df: DataFrame, most: int = FEW) -> DataFrame:
    """The same rows, computed once: broadcast if they are few, else from a checkpoint."""
    shared_folder(df.sparkSession)
    rows = fetched(kept := df.checkpoint(), most)
    return kept if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
