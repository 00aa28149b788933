"""Counts of shingles come as tables, a row for each task, and add up to the plain counts."""

import numpy as np

from wayfold.llm import near_sets


def test_counts_come_as_tables(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 3000, np.uint64) // np.uint64(1 << (k % 40))) for k in range(40)]
    held = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets], "shingles binary").repartition(13)
    want = np.bincount(np.concatenate([near_sets._bucket(s) for s in sets]), minlength=1 << near_sets.COUNT_BITS)
    assert (near_sets.usual_counts(held) == want).all()
    assert not near_sets.usual_counts(held.where("false")).any()
    assert near_sets.SUM_TASKS < 64
