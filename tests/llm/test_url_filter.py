import re

from wayfold.llm import url_filter as u

RULES = [u.Rule("org/", "allow", True), u.Rule("example.org/es/", "block", True), u.Rule("/login^", "block"), u.Rule("||ads.example.com^", "block"), u.Rule("*tracker*", "block"), u.Rule("*ogin*", "block"), u.Rule("/ok/track^", "allow")]
URLS = [
    None, "", "no scheme", "http://", "http://ORG/", "https://a.Example.org/es/x?y#z", "https://example.org/ES/x", "https://notexample.org/es/1", "http://x.com/login", "http://x.com/login/now", "http://x.com/logins",
    "http://ads.example.com", "http://b.ads.example.com/x", "http://xads.example.com/x", "http://q.net/my-trackers", "http://q.net/ok/track", "http://org?x", "http://org:80/", "a://b://c/login", "http://x.com/\nlogin",
    "http://a.example.org/en/" + "very/long/" * 30_000 + "login",
]


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)(.*)", url or "", re.S)
    host, path, tail = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2], m[3]) if m else ("", "", "")
    fits = [r for r in RULES if re.search(u.to_regex(r), host + path + tail, re.S)]
    best = max(fits, key=lambda r: r.order, default=None)
    return host, path, best.text if best and best.site else None, best.action if best else "allow"


def test_both_ways_equal_brute_force(spark, monkeypatch):
    pages = spark.createDataFrame([(i, x, "kept", "old") for i, x in enumerate(URLS * 2)], "page_id int, url string, _target string, judged string")
    want = {i: brute(x) for i, x in enumerate(URLS * 2)}
    for most in (u.BROADCAST_RULES, 0):
        monkeypatch.setattr(u, "BROADCAST_RULES", most)
        got = u.judge(spark, pages, RULES)
        assert got.columns == ["page_id", "url", "_target", "judged"]
        assert {r["page_id"]: tuple(r["judged"])[:3] + (r["judged"]["verdict"],) for r in got.collect()} == want


def test_rules_are_indexed_by_their_rarest_token(spark):
    pages = spark.createDataFrame([("http://a.org/rare/common",), ("http://a.org/common",)], "url string")
    rule = u.Rule("/rare/common^", "block")
    counts = u.token_counts(pages, "url", u.literal_tokens(rule))
    assert counts == {"rare": 1, "common": 2}
    assert u.index_rules([rule], counts) == ({"rare": [rule]}, [])
    got = {r["url"]: r["judged"]["candidates"] for r in u.judge(spark, pages, [rule]).collect()}
    assert got == {"http://a.org/rare/common": 1, "http://a.org/common": 0}
    assert u.judge(spark, pages.limit(0), [rule]).count() == 0
