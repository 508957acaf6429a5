import numpy as np
import pytest

from quietlog.llm import url_rules


def slow(url, rules):
    host, path = url_rules.split_url(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("a.b.c.example.net", "/x", "block"), ("whole.net", "", "block")]
URLS = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.org", "http://example.org/", "https://x.Example.ORG/es/1?a=/b", "http://example.org/es",
        "http://example.org/en/123#x", "http://notexample.org/es/1", "http://com/de/", "ftp://a.com/de/x", "http://a.com/fr/", "http://b.com/DE/", "x://whole.net",
        "x://sub.whole.net?q=://y/z", "http://z.a.b.c.example.net/x/y", "http://b.c.example.net/x", "http://" + "a." * 5000 + "org/q", "http://org/" + "p" * 100_000,
        "http://.org/x", "http://a..com/de/", "http://x/é://y"]


@pytest.mark.parametrize("shards", [None, 3])
def test_against_brute_force(spark, shards):
    index = url_rules.build(url_rules.rule_frame(spark, RULES), shards)
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, path string").repartition(2)
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in url_rules.judge(pages, index).collect()}
    assert got == {i: slow(u, RULES) for i, u in enumerate(URLS + URLS[:3])}


def test_rules_that_cannot_fit_and_empty_tables(spark):
    index = url_rules.build(url_rules.rule_frame(spark, [(None, "/", "block"), ("a/b", "/", "block"), ("a.com", None, "block"), ("a.com", "x", "block"), ("a.com", "/", "?")]))
    pages = spark.createDataFrame([(None, "http://a.com/x"), (1, None)], "page_id long, url string")
    assert {r["verdict"] for r in url_rules.judge(pages, index).collect()} == {"allow"}
    assert {r["verdict"] for r in url_rules.judge(pages, index, "block").collect()} == {"block"}
    assert url_rules.judge(pages.where("false"), index).count() == 0
    both = url_rules.build(url_rules.rule_frame(spark, [("a.com", "/", "allow"), ("a.com", "/", "block"), ("A.COM", "/", "block")]))
    assert [r["verdict"] for r in url_rules.judge(pages.where("page_id is null"), both).collect()] == ["block"]


def test_equal_digests_are_told_apart_by_their_strings():
    shard = url_rules.Shard.__new__(url_rules.Shard)
    shard.digests, shard.ends = np.array([5, 5, 9], np.uint64), np.array([0, 2, 4, 6])
    shard.text, shard.blocks = np.frombuffer(b"aabbcc", np.uint8), np.array([1, 0, 1], np.uint8)
    assert shard.probe(np.array([5, 5, 5, 9, 9, 1], np.uint64), [b"aa", b"bb", b"cc", b"cc", b"xx", b"aa"]) == [(0, True), (1, False), (3, True)]
