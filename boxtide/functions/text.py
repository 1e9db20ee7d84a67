"""Text of label files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def six_decimals(*numbers: pd.Series) -> pd.Series:
    """The numbers with six decimals each, as their exact binary values round, parted by blanks; null if one is null.

    The JVM's formatting rounds the shortest decimal instead, which differs on ties such as 5/640.
    """
    rows = zip(*(n.tolist() for n in numbers), strict=True)
    return pd.Series([None if any(x is None or x != x for x in r) else " ".join(f"{x:.6f}" for x in r) for r in rows], dtype=object)


def label_line(cls: Column, shape: Column) -> Column:
    """`<class> <cx> <cy> <w> <h>` of struct(cx, cy, w, h); null without a shape."""
    numbers = six_decimals(*[shape.getField(n) for n in ("cx", "cy", "w", "h")])
    return F.when(shape.isNotNull(), F.concat_ws(" ", cls.cast("string"), numbers))
