"""Running totals inside groups of any size.

A window over a whole group puts the group in one task. Here each group is cut into
buckets along its order: bucket totals are pre-aggregated, the running total of those
few rows gives every bucket its offset, and the window runs inside one bucket only.

``running_totals`` cuts by spans of consecutive numbers, for an order that is nearly dense.
``ordered_totals`` takes any order: rows are dealt by ranges of it, and a range is the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import stage

BUCKET_SPAN = 4096


def running_totals(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column],
                   span: int = BUCKET_SPAN) -> DataFrame:
    """Add a column per entry of ``values``: its sum over the rows of the group before this one.

    ``order`` sorts the group without ties; its first column is an integer, cut into
    buckets of ``span`` consecutive values.
    """
    before = (Window.unboundedPreceding, -1)
    keys = [*group, "_bucket"]
    inputs = {out: f"_in_{out}" for out in values}
    rows = df.withColumns({
        "_bucket": F.floor(F.col(order[0]) / span),
        **{inputs[out]: value.cast("bigint") for out, value in values.items()},
    })
    along = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(*before)
    offsets = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in inputs.values()]).select(
        *keys, *[F.sum(c).over(along).alias(f"_off_{out}") for out, c in inputs.items()]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
    numbered = rows.join(offsets, keys)
    return numbered.select(
        *df.columns,
        *[
            (
                F.coalesce(F.col(f"_off_{out}"), F.lit(0))
                + F.coalesce(F.sum(c).over(inside), F.lit(0))
            ).alias(out)
            for out, c in inputs.items()
        ],
    )


def ordered_totals(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column],
                   totals: dict[str, str] | None = None) -> DataFrame:
    """``running_totals`` for columns of any type and density, null first.

    ``df`` should be narrow: its rows are dealt by ranges of ``group`` and ``order``, staged once so that no
    later step can see another dealing, and summed up range by range. A group of any size spreads over ranges,
    as long as ``order`` tells its rows apart. ``totals`` maps names of ``values`` to columns that get the sum
    over the whole group.
    """
    before = (Window.unboundedPreceding, -1)
    inputs = {out: f"_in_{out}" for out in values}
    rows = stage(
        df.withColumns({inputs[out]: value.cast("bigint") for out, value in values.items()})
        .repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*group, *order)])
        .withColumn("_range", F.spark_partition_id()), "ordered")
    keys = {c: f"_key{i}" for i, c in enumerate([*group, "_range"])}
    own = [keys[c] for c in group]
    sums = rows.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(
        *[F.sum(c).alias(c) for c in inputs.values()])
    along, whole = Window.partitionBy(*own).orderBy(keys["_range"]), Window.partitionBy(*own)
    offsets = sums.select(
        *keys.values(),
        *[F.coalesce(F.sum(c).over(along.rowsBetween(*before)), F.lit(0)).alias(f"_off_{out}")
          for out, c in inputs.items()],
        *[F.sum(inputs[out]).over(whole).alias(name) for out, name in (totals or {}).items()])
    inside = Window.partitionBy(*group, "_range").orderBy(
        *[F.col(c).asc_nulls_first() for c in order]).rowsBetween(*before)
    summed = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_here_{out}")
                                for out, c in inputs.items()])
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return summed.join(offsets, same).select(
        *df.columns, *[(F.col(f"_off_{out}") + F.col(f"_here_{out}")).alias(out) for out in values],
        *(totals or {}).values())
