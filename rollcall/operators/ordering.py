"""Numbers, running sums and preceding values within groups that may hold any share of all rows.

A window by group gathers a group in one task. Here rows are dealt by ranges of (group, order) and written, so that a large group
lies in many ranges; windows stay within a range, and what earlier ranges of the group add is carried over from one row for each group of a range.
Of these only the group that a range begins with can have something to carry: at most one row a range is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle

RANGE = "_range"


def _columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def dealt(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows in ranges of group and order, written, with the number of the range. A null group is a group; rows of equal order share a range."""
    by_range = rows.repartitionByRange(*_columns(group), *_columns(order))
    return settle(by_range.withColumn(RANGE, F.spark_partition_id()))


def _carried(rows: DataFrame, each: DataFrame, group: Sequence[str], names: Sequence[str], carry: dict[str, Column]) -> DataFrame:
    """Rows with, of each name, what the earlier ranges of their group come to (null: nothing), as ``_<name>``."""
    some = F.lit(False)
    for n in names:
        some = some | F.col(f"_{n}").isNotNull()
    keys = [RANGE, *group]
    few = each.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c.alias(f"_{n}") for n, c in carry.items()]).filter(some)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(F.broadcast(few), same, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def sums(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], **values: Column) -> DataFrame:
    """Rows of :func:`dealt` with, under each name, the sum of a value over the group's rows up to this one. Nulls add nothing, order should be total."""
    local = Window.partitionBy(RANGE, *group).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    each = rows.groupBy(RANGE, *group).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    within = rows.withColumns({n: F.coalesce(F.sum(v).over(local), F.lit(0)) for n, v in values.items()})
    out = _carried(within, each, group, list(values), {n: F.sum(n).over(earlier) for n in values})
    return out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in values}).drop(*[f"_{n}" for n in values])


def before(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, value: Column) -> DataFrame:
    """Rows of :func:`dealt` with, as ``name``, the last value that isn't null of the group's rows before this one; ``order`` are columns, ascending."""
    local = Window.partitionBy(RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(RANGE, *group).agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(name))
    out = _carried(rows.withColumn(name, F.last(value, ignorenulls=True).over(local)), each, group, [name], {name: F.last(name, ignorenulls=True).over(earlier)})
    return out.withColumn(name, F.coalesce(name, f"_{name}")).drop(f"_{name}")


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """With the row's number within its group, from 1."""
    return sums(dealt(rows, group, order), group, order, **{name: F.lit(1)}).drop(RANGE)
