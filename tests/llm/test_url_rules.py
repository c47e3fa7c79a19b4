import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cadenza.llm import url_rules as ur
from cadenza.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, rule string, tokens string, anchor string, hit string, n string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, "r", "t", "a", "h", "n") for i, u in urls], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "page_id long, bad boolean, url string")


def test_hosts_paths_and_fixed_rules(spark):
    cases = {
        "https://WWW.Example.COM/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://example.com/en/": ("example.com", "/en/", "example.com/en/", "block"),
        "http://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://myexample.com/en/1": ("myexample.com", "/en/1", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://example.com?x=/en/": ("example.com", "", None, "allow"),
        "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "http://a.net/ES/1": ("a.net", "/ES/1", None, "allow"),
        "http://a.net:80/es/1": ("a.net:80", "/es/1", None, "allow"),
        "x://b.org#f://c.com/": ("b.org", "", None, "allow"),
        "ÄB://ÄB.COM/": ("Äb.com", "/", "com/", "allow"),
        "no scheme.com/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    urls = list(enumerate(cases)) + [(None, "http://a.net/fr/"), (3, "http://a.net/fr/")]
    found = ur.judge(pages(spark, urls), labels(spark, []), URL_RULES).collect()
    expected = [(i, *cases[u]) for i, u in enumerate(cases)] + [(i, "a.net", "/fr/", "net/fr/", "block") for i in (None, 3)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert ur.judge(pages(spark, []), labels(spark, []), URL_RULES).count() == 0


def made_up(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        host, path = rng.choice(["a.x.net", "b.y.org", "spam.z.net", "c.x.org"]), rng.choice(["en", "fr", "win"])
        query = rng.choice(["", "?utm=1", "?ref=2&z=3"])
        odds = 0.9 if host == "spam.z.net" else 0.95 if path == "win" and "ref" in query else 0.1
        rows.append((i, f"https://{host}/{path}/{i}{query}", rng.random() < odds))
    return rows


def plain_rules(rows, support, confidence, lower):
    """Rules by counting every combination of tokens that occurs."""
    n, hits = Counter(), Counter()
    for tokens, bad in rows:
        for size in range(1, len(tokens) + 1):
            for chosen in combinations(sorted(tokens), size):
                n[chosen] += 1
                hits[chosen] += bad
    least = math.ceil(support * len(rows))
    found = {}
    for chosen, total in n.items():
        share, z = hits[chosen] / total, ur.Z
        centre = share + z * z / (2 * total)
        low = (centre - z * math.sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total)
        if hits[chosen] >= least and share >= confidence and low >= lower:
            found[chosen] = (share, total)
    return {c: v for c, v in found.items() if not any(set(d) < set(c) for d in found)}


@pytest.mark.parametrize("seed,n,support", [(1, 600, 0.01), (2, 60, 0.05)])
def test_rules_and_verdicts_by_brute_force(spark, seed, n, support):
    rows = made_up(seed, n)
    df = pages(spark, [r[:2] for r in rows])
    tokens = {r.page_id: r.t for r in df.select("page_id", ur.tokens_of(F.col("url")).alias("t")).collect()}
    known = [(i, bad, "u") for i, _, bad in rows[: n * 2 // 3]]
    expected = plain_rules([(tokens[i], bad) for i, bad, _ in known], support, 0.6, 0.5)
    labelled = labels(spark, known).join(df.select("page_id", ur.tokens_of(F.col("url")).alias("tokens")), "page_id")
    found = ur.mine_rules(labelled.select("tokens", "bad"), min_support=support).collect()
    assert {tuple(r.tokens): (round(r.confidence, 9), r.n) for r in found} == {c: (round(s, 9), t) for c, (s, t) in expected.items()}
    assert expected and all(r.anchor in r.tokens for r in found)
    verdicts = {r.page_id: r.verdict for r in ur.judge(df, labels(spark, known), [], min_support=support).collect()}
    assert verdicts == {i: "block" if any(set(c) <= set(tokens[i]) for c in expected) else "allow" for i, *_ in rows}
