"""Global order without a single task: ranks by sampled ranges, and running sums in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

BLOCK = 1 << 16


def in_ranges(rows: DataFrame, *keys: Column) -> DataFrame:
    """rows with __b, __r: their range of the keys' order and their place in it, from 0.

    The engine samples the keys and splits ranges where the sample says, so that they hold like numbers of rows wherever the
    keys lie close; a range is one sorted task. Ranges are kept as they fell: what follows may read them many times.
    """
    named = rows.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    names = [f"__k{i}" for i in range(len(keys))]
    at = F.monotonically_increasing_id()  # the task's number in the bits from 33 on, below them the row's
    placed = named.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("__at", at).drop(*names)
    placed = placed.withColumns({"__b": F.shiftright("__at", 33), "__r": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    return checkpointed(placed.drop("__at"))


def ranked(rows: DataFrame, *keys: Column, name: str = "pos") -> DataFrame:
    """rows with their place, from 0, in the order of keys; equal keys may come in any order.

    The only ordered window without partitions is over one row a range.
    """
    placed = in_ranges(rows, *keys)
    sizes = placed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    starts = sizes.select("__b", before.alias("__s"))
    return placed.join(starts, "__b").withColumn(name, (F.col("__s") + F.col("__r")).cast("bigint")).drop("__b", "__r", "__s")


def running(rows: DataFrame, sums: dict[str, Column], pos: str = "pos", block: int = BLOCK, within: tuple[str, ...] = (), then: tuple[str, ...] = ()) -> DataFrame:
    """rows with exclusive running sums in the order of pos, and of the columns `then` where pos is equal, of each value of `within`.

    Totals by block of places come first, then windows inside blocks.
    """
    names, keys = list(sums), [*within, "__b"]
    rows = rows.withColumn("__b", F.expr(f"{pos} div {block}")).withColumns({f"__{n}": c.cast("bigint") for n, c in sums.items()})
    totals = rows.groupBy(*keys).agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in names])
    over = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    base = totals.select(*keys, *[(F.sum(f"__t_{n}").over(over) - F.col(f"__t_{n}")).alias(f"__s_{n}") for n in names])
    inside = Window.partitionBy(*keys).orderBy(pos, *then).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__w_{n}": F.sum(f"__{n}").over(inside) - F.col(f"__{n}") for n in names}).join(base, keys)
    out = rows.withColumns({n: F.col(f"__s_{n}") + F.col(f"__w_{n}") for n in names})
    return out.drop("__b", *[f"__{p}{n}" for n in names for p in ("", "s_", "w_")])
