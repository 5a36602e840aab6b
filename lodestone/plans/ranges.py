"""Running values over a whole table in order, without bringing it into one partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.storage import stored

_MERGE = {"max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b), "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
_OPS: dict[str, Callable[[Column], Column]] = {"max": F.max, "min": F.min, "sum": F.sum}


def running(df: DataFrame, by: list[Column], values: dict[str, tuple[str, Column]], inclusive: bool = True, within: Column | None = None) -> DataFrame:
    """df with a column for each of values, name: (max, min or sum, column), over the rows up to its own in the order of ``by``.

    Rows are put into ranges of the order; each range is run through by itself, and what the ranges
    before it come to, a row for each, is carried in. ``by`` should leave no ties. Not inclusive, a row's
    own value doesn't count, and the first row has null (a sum: 0). ``within`` starts anew with each of its
    values; one that has many rows is several ranges, and only such ones carry.
    """
    key = [] if within is None else ["_within"]
    held = df.withColumns({f"_v_{n}": c for n, (_, c) in values.items()} | ({} if within is None else {"_within": within}))
    rows = stored(held.repartitionByRange(*key, *by).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *key).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = rows.groupBy("_range", *key).agg(*[_OPS[op](f"_v_{n}").alias(f"_t_{n}") for n, (op, _) in values.items()])
    past = (Window.partitionBy(*key) if key else Window).orderBy("_range")  # one row for each range, and value of within
    before = past.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_range", *key, F.row_number().over(past).alias("_no"), *[_OPS[op](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (op, _) in values.items()])
    carried = carried.filter("_no > 1").select(F.col("_range").alias("_r"), *[F.col(k).alias("_w") for k in key], *[f"_c_{n}" for n in values])
    local = rows.withColumns({n: _OPS[op](f"_v_{n}").over(inside) for n, (op, _) in values.items()})
    same = F.col("_range") == F.col("_r")
    local = local.join(F.broadcast(carried), same & F.col("_within").eqNullSafe(F.col("_w")) if key else same, "left")
    return local.withColumns({n: _MERGE[op](F.col(n), F.col(f"_c_{n}")) for n, (op, _) in values.items()}).select(*df.columns, *values)


def numbered(df: DataFrame, name: str, *by: Column, within: Column | None = None) -> DataFrame:
    """df with the place of each row, from 0, in the order of ``by``, or in that order among the rows of its value of ``within``."""
    return running(df, list(by), {name: ("sum", F.lit(1).cast("long"))}, within=within).withColumn(name, F.col(name) - 1)
