"""Order-preserving numbering of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut


def number_names(names: DataFrame, cols: list[str], label: str = "ids") -> DataFrame:
    """Give every distinct row of ``cols`` a long ``id`` that ascends in the order of ``cols``.

    The rows are range-partitioned and sorted; the id is the partition's number and the row's place
    in it, so there is no central counter. The table is written before it is used, which fixes the
    ids. Strings sort by code point. Rows with a null in ``cols`` get no id. An empty input gives an
    empty table.
    """
    d = names.select(*cols).dropna(subset=cols).distinct()
    return cut(d.sort(*cols).select(*cols, F.monotonically_increasing_id().alias("id")), label)
