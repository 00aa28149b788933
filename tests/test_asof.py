"""As-of joins against a search over all facts."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators.asof import asof
from wayfold.operators.joins import latest_before

FACT, ASK = "k bigint, t bigint, value bigint, name string", "k bigint, t bigint, id bigint"


def made(seed):
    """Keys of very different sizes, ties in time, negative times, repeated rows."""
    rng = random.Random(seed)
    key = lambda: rng.choice([0, 0, 0, 1, 2, 3])
    facts = [(key(), rng.randrange(-500, 500), rng.randrange(5), rng.choice("ab")) for _ in range(150)]
    asked = [(rng.choice([key(), 9]), rng.randrange(-600, 600), n // 2) for n in range(200)]
    return facts, asked + asked[:10]


def search(facts, asked, after, tolerance):
    out = []
    for k, t, i in asked:
        found = [f for f in facts if f[0] == k and f[0] is not None and t is not None and f[1] is not None and (f[1] >= t if after else f[1] <= t) and (tolerance is None or abs(f[1] - t) <= tolerance)]
        best = max(found, key=lambda f: (-f[1] if after else f[1], f[2], f[3]), default=None)
        out.append((k, t, i, *(best[2:] if best else (None, None))))
    return sorted(map(repr, out))


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize(("tolerance", "slot"), [(None, 7), (None, 10_000), (20, 50), (0, 1)])
def test_asof_equals_a_search(spark, after, tolerance, slot):
    facts, asked = made(slot)
    got = asof(spark.createDataFrame(asked, ASK).repartition(3), spark.createDataFrame(facts, FACT).repartition(4), ["k"], "t", ["value", "name"], after, tolerance, slot)
    assert got.columns == ["k", "t", "id", "value", "name"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == search(facts, asked, after, tolerance)


def test_odd_rows(spark):
    """Null keys and times meet nothing, empty sides, a clash of names, names like those used inside."""
    facts = [(None, 1, 5, "a"), (1, None, 6, "a"), (1, 3, 7, None)]
    asked = [(None, 2, 1), (1, None, 2), (1, 9, 3), (1, 2, 4)]
    f, a = spark.createDataFrame(facts, FACT), spark.createDataFrame(asked, ASK)
    got = {r["id"]: (r["value"], r["name"]) for r in asof(a, f, ["k"], "t", ["value", "name"]).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (7, None), 4: (None, None)}
    assert asof(a.limit(0), f, ["k"], "t", ["value"]).isEmpty()
    assert [r["value"] for r in asof(a, f.limit(0), ["k"], "t", ["value"]).collect()] == [None] * 4
    with pytest.raises(ValueError, match="value"):
        asof(a.withColumn("value", F.lit(1)), f, ["k"], "t", ["value"])
    odd = a.withColumn("_pos", F.lit(1)).withColumn("_slot", F.lit("x")).withColumn("_k0", F.lit(2))
    assert asof(odd, f, ["k"], "t", ["value"]).columns == [*odd.columns, "value"]
    assert {r["id"]: r["value"] for r in latest_before(f, a, "k", "t", "value").collect()}[3] == 7
