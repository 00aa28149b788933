import pytest
import random

from fixtures import awkward, docs_table, prose

from pyspark.sql import functions as F

from wayfold.llm import license_scan as lic


def rows():
    rng, made = random.Random(9), []
    names = sorted(lic.TEMPLATES)
    for k in range(120):
        words = prose(rng, rng.randrange(0, 400), 200).split(" ")
        for _ in range(k % 4):
            template = lic.TEMPLATES[rng.choice(names)].split(" ")
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(template))
                template[at : at + 1] = rng.choice([[], ["edited"], [template[at], "more"], [template[at], *prose(rng, rng.randrange(30)).split(" ")]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = template
        made.append((100 + k, " ".join(words), "a"))
    return awkward() + made


def words_in(text):
    """Words without the module's help: letters and digits in a row."""
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def five(words):
    return [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def best(shingles, wanted, size):
    """The best share of the template's shingles in a stretch of `size` shingles from any word on."""
    return max((len(wanted & set(shingles[i : i + size])) / len(wanted) for i in range(len(shingles))), default=0)


def test_recall_and_precision_against_every_window(spark):
    """All that lies in 1.5 L shingles, from any word on, is found; all that is found lies in 2 L."""
    got = {(r["doc_id"], r["template"]) for r in lic.scan(spark, docs_table(spark, rows())).collect()}
    near, far = set(), set()
    for i, text, *_ in rows():
        shingles = five(words_in(text))
        for k, t in lic.TEMPLATES.items():
            wanted = set(five(words_in(t)))
            if not wanted & set(shingles):
                continue
            size = 1 << (len(wanted) - 1).bit_length()
            if best(shingles, wanted, size + size // 2) >= 0.8:
                near.add((i, k))
            if best(shingles, wanted, 2 * size) >= 0.8:
                far.add((i, k))
    assert near <= got <= far and len(near) > 100


def test_every_occurrence_has_its_place(spark):
    mit = lic.TEMPLATES["mit-text"]
    n = len(words_in(mit))
    text = f"{'one ' * 40}{mit} {'two ' * 900}{mit} {'three ' * 10}"
    got = sorted((r["first_word"], r["last_word"], r["containment"]) for r in lic.scan(spark, docs_table(spark, [(1, text)])).collect() if r["template"] == "mit-text")
    assert got == [(40, 39 + n, 1.0), (940 + n, 939 + 2 * n, 1.0)]


def test_templates_that_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = docs_table(spark, rows()[-60:])
    want = sorted(map(repr, lic.scan(spark, docs).collect()))
    monkeypatch.setattr(lic, "BROADCAST_TEMPLATES", 0)
    assert sorted(map(repr, lic.scan(spark, docs).collect())) == want and want
    assert lic.scan(spark, docs, templates={}).count() == 0
    one = lic.scan(spark, docs, templates={"mine": "w1 w2"})
    assert set(r["template"] for r in one.collect()) <= {"mine"}


def test_anchors_cover_more_than_a_fifth():
    for t in lic.TEMPLATES.values():
        words = lic.words_of(t)
        shingles = lic.shingles_of(words)
        without = [s for s in shingles if not set(s.split(" ")) & lic.anchors_of(words)]
        assert len(without) < 0.8 * len(shingles)


def test_empty(spark):
    assert lic.scan(spark, docs_table(spark, awkward()).limit(0)).count() == 0


def test_each_row_is_a_document(spark):
    mit = lic.TEMPLATES["mit"]
    docs = docs_table(spark, [(None, mit), (None, mit), (None, "x " * 50 + mit), (1, mit), (1, "y " * 9 + mit)]).withColumn("row", F.lit(1)).withColumn("least", F.lit(0.1))
    got = [r for r in lic.scan(spark, docs).collect() if r["template"] == "mit"]
    assert sorted((r["doc_id"] or 0, r["first_word"]) for r in got) == [(0, 0), (0, 0), (0, 50), (1, 0), (1, 9)]


def test_bands_come_from_the_least_share(spark):
    assert lic.bands_for(0.8) == 48 and lic.bands_for(0.3) > 150
    for share in (0.0, -1.0, 1.1):
        with pytest.raises(ValueError, match="least"):
            lic.bands_for(share)
    rng = random.Random(8)
    wanted = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12 m13 n14 o15 p16 q17 r18 s19 t20"
    words = wanted.split()
    docs = docs_table(spark, [(k, " ".join([f"x{rng.randrange(99)}" for _ in range(30)] + words[:9] + ["z"] * 20)) for k in range(100)])
    got = lic.scan(spark, docs, templates={"t": wanted}, least=0.3).collect()
    assert len({r["doc_id"] for r in got}) == 100 and {r["shared"] for r in got} == {5}
