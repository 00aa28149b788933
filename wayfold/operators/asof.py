"""As-of joins over long histories: each asked row with the nearest fact of its key before or after its time.

Keys are cut into slots of time, so that a key with a large share of all rows goes over many tasks: within a slot facts and
asked rows are sorted once and the last fact is carried along; what earlier slots leave over comes as one more row of a
slot, found over the slots' last facts alone. Neither side is broadcast, and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def asof(asked: DataFrame, facts: DataFrame, keys: list[str], time: str, values: list[str], after: bool = False, tolerance: int | None = None, slot: int = 3_600_000_000) -> DataFrame:
    """asked, every row once and with all its columns, and the values of the last fact at or before its time; after: the first at or after it.

    Facts further away than the tolerance, or with a null key or time, are none; the values are then null, as for asked rows
    with a null key or time. Of facts at one time the greatest counts, by the values in their order. time and tolerance are
    whole numbers of one unit, as slot is. A value that has the name of an asked column is refused.
    """
    if clash := set(values) & set(asked.columns):
        raise ValueError(f"asked rows have columns named {sorted(clash)}")
    pos = F.col(time).cast("bigint") * (-1 if after else 1)
    at = lambda df: df.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], pos.alias("_pos"), F.struct(*df.columns).alias("_row"))
    names = [f"_k{n}" for n in range(len(keys))]
    slotted = lambda df: df.withColumn("_slot", F.expr(f"_pos div {int(slot)}"))
    fact = F.struct(F.col("_pos").alias("pos"), *[F.col("_row")[v].alias(f"v{n}") for n, v in enumerate(values)])
    known = slotted(at(facts.dropna(subset=[*keys, time])).select(*names, "_pos", fact.alias("_fact"))).withColumn("_kind", F.lit(1))
    wanted = slotted(at(asked)).withColumn("_kind", F.lit(2))
    lasts = known.groupBy(*names, "_slot").agg(F.max("_fact").alias("_fact")).unionByName(wanted.select(*names, "_slot").distinct(), allowMissingColumns=True)
    slots = lasts.groupBy(*names, "_slot").agg(F.max("_fact").alias("_last"))
    earlier = W.partitionBy(*names).orderBy(F.col("_slot").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    carried = slots.withColumn("_fact", F.max("_last").over(earlier)).where("_fact is not null").drop("_last").withColumn("_kind", F.lit(0))
    rows = wanted.unionByName(known, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    w = W.partitionBy(*names, "_slot").orderBy(F.expr("_kind > 0"), F.col("_pos").asc_nulls_first(), "_kind").rowsBetween(W.unboundedPreceding, 0)
    met = rows.withColumn("_best", F.max("_fact").over(w)).where("_kind = 2")
    near = F.col("_pos").isNotNull() & F.col("_best").isNotNull() & (F.col("_pos") - F.col("_best.pos") <= tolerance if tolerance is not None else F.lit(True))
    return met.select("_row.*", *[F.when(near, F.col(f"_best.v{n}")).alias(v) for n, v in enumerate(values)])
