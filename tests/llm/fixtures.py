"""Small tables for the tests of this package."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """documents from (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows], DOCS)


def prose(rng: random.Random, words: int, stock: int = 400) -> str:
    return " ".join(f"w{rng.randrange(stock)}" + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(words))


def awkward(rng: random.Random | None = None) -> list[tuple]:
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = rng or random.Random(3)
    long = prose(rng, 9000)
    rows = [(1, None, "a"), (2, "", "a"), (3, "one", None), (4, "Two words", "b"), (5, long, "b"), (6, long, None), (7, "é ñ ü — ß\u0301 İstanbul Σας 数据 \x00\x01", "c"), (None, "no id", "c"), (None, None, None)]
    rows += [(8, "same row again and again", "a")] * 3 + [(9, "same id, one text", "a"), (9, "same id, another text", "a")]
    return rows + [(10 + k, prose(rng, 40), rng.choice(["a", "b", "c"])) for k in range(60)]
