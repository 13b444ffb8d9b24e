"""Values worked out once a row."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once a row however often it is used, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
