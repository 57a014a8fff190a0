"""Record writes as single values: explode the parallel arrays and keep the holding value of each cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merge_latest

NO_KEY = -1


def record_cells(records: DataFrame, extra: Sequence[tuple[str, object]] = ()) -> DataFrame:
    """(record_id, rec_key, series, data_type, val, *extra), one row for each position of the arrays.

    Rows with key -1 or a null key do not count.  Null arrays give no rows, arrays of unequal length are padded with nulls.
    """
    return (
        records.where(F.col("rec_key") != NO_KEY)
        .select("record_id", "rec_key", *[c.alias(n) for n, c in extra], F.inline(F.arrays_zip("measurements", "data_types", "vals")))
        .withColumnsRenamed({"measurements": "series", "data_types": "data_type", "vals": "val"})
    )


def holding_values(cells: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Per (series, rec_key) the non-null value of the greatest record_id."""
    return merge_latest(cells, ["series", "rec_key"], "record_id", "val", carry)
