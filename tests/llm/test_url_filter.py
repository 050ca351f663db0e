"""URL rules against a plain reading of the contract."""
import random

from varilens.llm import url_filter as U
from varilens.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"


def expected(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits) if fits else None
    return host, path, best and best[2], best[3] if best else "allow"


def judged(spark, rows, rules, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, block int")
    found = U.judge_urls(pages, spark.createDataFrame(rules, RULES), **options).collect()
    return sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in found)


def held(rows, rules):
    return sorted((i is None, i or 0, *expected(u, rules)) for i, u, *_ in rows)


ODD = [None, "", "no scheme", "http://", "http://NET/a", "http://xnet/a", "http://x.net", "http://x.net?q=/", "ftp://a.Example.NET/en/",
       "http://example.net/EN/", "https://example.net/en/x://y.org/fr/", "http://a..net/", "http://.net/", "http://www.example.com/de/1#x",
       "http://example.com/de", "http://é.org/fr/ü", "http://ÉXAMPLE.ORG/fr/", "x\ny://org/fr/\nz", "http://org/fr/?a#b", "http://" + "a." * 3000 + "net/" + "p" * 5000]


def test_contract_rules_on_odd_urls(spark):
    rows = [(k, u, "clash", 1) for k, u in enumerate(ODD)] + [(None, "http://a.net/", None, None), (1, ODD[10], None, 2), (1, ODD[10], None, 2)]
    assert judged(spark, rows, URL_RULES) == held(rows, URL_RULES)


def test_random_rules_and_a_crowded_filter(spark):
    rnd = random.Random(1)
    parts = ["a", "b", "net", "org", "x-y"]
    rules = {(".".join(rnd.choices(parts, k=rnd.randint(1, 3))), rnd.choice(["", "/", "/p", "/p/", "/p/q"])): rnd.choice(["block", "allow"])
             for _ in range(25)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    rows = [(k, "http://" + ".".join(rnd.choices(parts, k=rnd.randint(1, 4))) + rnd.choice(["", "/", "/p", "/p/q/r", "/pq"]), "", 0)
            for k in range(150)]
    assert judged(spark, rows, rules) == held(rows, rules)
    assert judged(spark, rows, rules, n_blocks=1) == held(rows, rules)  # every bit taken: the join alone decides


def test_empty_tables_and_default(spark):
    assert judged(spark, [], URL_RULES) == []
    rows = [(1, "http://a.net/x", "", 0)]
    assert judged(spark, rows, []) == [(False, 1, "a.net", "/x", None, "allow")]
    assert judged(spark, rows, [], default="block")[0][-1] == "block"
