import random

from quern.llm.queries import OP2_SQL, URL_RULES, op2_url_filter
from quern.llm.url_filter import Trie, filter_urls
from tests.oracle import check, connect


def test_query(spark, sf):
    check(op2_url_filter(spark, sf), connect(sf), OP2_SQL)


def test_trie_against_all_rules():
    rng = random.Random(1)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net"], ["/", "/en/", "/en", "/en/x", "/de/", ""]
    for _ in range(60):
        rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(6))}.values())
        trie = Trie(rules)
        for h in [*hosts, "c.b.a.com", "acom", ""]:
            for p in [*paths, "/english", "/en/x/y", "//en/"]:
                fit = [(len(rh + rp), len(rh), v, rh + rp) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
                want = max(fit)[2:] if fit else None
                assert trie.match(h, p) == want


def test_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://WWW.Example.COM/en/1?x#y"), (5, "http://example.com"), (6, "x://é.net/es/"), (7, "http://a.net/fr/" + "x" * 100_000), (7, "http://a.net?q=/fr/")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, verdict string")
    got = sorted([(r.page_id, r.host, r.path[:6], r.rule, r.verdict) for r in filter_urls(spark, df, URL_RULES).collect()], key=str)
    want = [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (5, "example.com", "", None, "allow"), (6, "é.net", "/es/", "net/es/", "block"), (7, "a.net", "/fr/xx", "net/fr/", "block"), (7, "a.net", "", None, "allow"),
    ]
    assert got == sorted(want, key=str)
    assert filter_urls(spark, df.limit(0), URL_RULES).count() == 0


def test_many_partial_segments(spark):
    """The longest of many rules that end within a segment, by plain comparison of all."""
    import random

    rng = random.Random(3)
    rules = [(rng.choice(["allow", "block"]), rng.choice(["a.com", "com"]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 5)))) for _ in range(200)]
    trie = Trie(rules)
    for _ in range(500):
        path = "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 7)))
        fit = [(len(h) + len(p), len(h), v == "allow", v, h + p) for v, h, p in rules if path.startswith(p)]
        assert trie.match("a.com", path) == (max(fit)[3:] if fit else None)
    assert filter_urls(spark, spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
