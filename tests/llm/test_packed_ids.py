import random
import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from fixtures import docs_table, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm import queries


def test_last_stage_gives_the_packed_ids(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.choice([0, 3, 200, 4000]))) for k in range(30)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {}
    for r in cp.STAGES[-1][1](spark, docs_table(spark, rows), "").orderBy("doc_id", "piece").collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        found.setdefault(r["doc_id"], []).extend(ids)
    assert found == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in rows}


def test_op8_takes_its_digest_from_placed_ids(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, queries.op8_packing(spark, sf).collect()))
    pack = queries.packing.pack
    monkeypatch.setattr(queries.packing, "pack", lambda *a, **b: pack(*a, **b).withColumn("ids_crc32", F.lit(-1).cast("bigint")))
    assert sorted(map(tuple, queries.op8_packing(spark, sf).collect())) == want
