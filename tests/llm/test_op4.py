import random
import re
from itertools import combinations

from pagemill.llm.url_filter import RULES, Mined, host_path, judge, mine, op4_url_filter, tokens

SF = "/root/testdata/sf0.01"


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_whole_table(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op4_url_filter(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.confidence else "allow"))


def apriori(rows, support, least, confidence, longest):
    n = len(rows)
    share = max(support, least / n)
    common = [t for t in {t for s, _ in rows for t in s} if sum(t in s for s, _ in rows) < 0.95 * n]
    found = {}
    base = sum(b for _, b in rows) / n
    for k in range(1, longest + 1):
        for c in combinations(sorted(common), k):
            has = [b for s, b in rows if set(c) <= set(s)]
            if len(has) >= share * n and sum(has) >= confidence * len(has) and sum(has) / len(has) > base and sum(has) >= share * confidence * n:
                if not any(set(x) <= set(c) and found[x] >= sum(has) / len(has) for x in found):
                    found[c] = sum(has) / len(has)
    return found


def test_mined_rules_against_apriori(spark):
    r = random.Random(4)
    rows = []
    for _ in range(600):
        s = [t for t in "abcdefg" if r.random() < 0.5] + ["z"]
        rows.append((s, int(r.random() < (0.95 if "a" in s and "b" in s else 0.9 if "c" in s and "d" in s and "e" in s else 0.1))))
    df = spark.createDataFrame(rows, "tokens array<string>, bad int")
    got = {m.items: m.confidence for m in mine(df)}
    want = apriori(rows, 0.01, 20, 0.8, 3)
    assert ("a", "b") in got and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert mine(df.limit(0)) == [] and mine(df.limit(5)) == []


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.Com/en/1?x=1#y", "http://WWW.example.com/en/", "http://x.com", "http://x.com/", "a://b.net/es/x://c", "http://x.org/ads/7.html?k=v&k2", "ftp://xnet/fr/", "http://é.net/fr/ü\nz"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[4], "x"), (4, urls[4], "x")], "page_id long, url string, host string")
    mined = [Mined(("domain=x.org", "part=ads"), 0.9, 30), Mined(("key=k2",), 0.95, 30), Mined(("part=ads", "part=none"), 1.0, 30)]
    got = judge(df, RULES, mined).collect()
    for r in got:
        u = urls[4 if r.page_id is None else r.page_id]
        host, path, rule, verdict = plain(u)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.page_id == 9 else "allow")), u
    assert next(r.confidence for r in got if r.page_id == 9) == 0.95
    assert judge(df.limit(0), RULES, []).count() == 0


def test_whole_urls_become_tokens(spark):
    long = "p" * 70
    url = "http://x.org/" + "/".join("abcdefghi") + f"/{long}1x/{long}2y/?" + "&".join(f"k{c}=1" for c in "abcdefghij") + f"&{long}=2"
    df = spark.createDataFrame([(1, url), (2, f"http://x.org/{long}q")], "page_id long, url string")
    host, path = host_path("url")
    got = {r.page_id: set(r.t) for r in df.withColumn("host", host).withColumn("path", path).select("page_id", tokens("url", "host", "path").alias("t")).collect()}
    assert {"part=i", f"part={long}#x", f"part={long}#y", "key=kj", f"key={long}"} <= got[1]
    out = {r.page_id: r.verdict for r in judge(df, [], [Mined(("part=i",), 0.9, 30)]).collect()}
    assert out == {1: "block", 2: "allow"}
    assert {r.verdict for r in judge(df, [], [Mined((f"part={long}",), 0.9, 30)]).collect()} == {"allow"}


def test_every_mined_rule_is_kept(spark):
    rows = [([f"t{i}"], int(i < 1100)) for i in range(1400) for _ in range(20)]
    df = spark.createDataFrame(rows, "tokens array<string>, bad int")
    got = mine(df, support=0.0001)
    assert {m.items for m in got} == {(f"t{i}",) for i in range(1100)}
    assert len(got) == 1100


def test_rules_of_any_size(spark):
    sets = ["abcd", "abc", "abd", "acd", "bcd"]
    rows = [(list(s), int(s == "abcd")) for s in sets for _ in range(40)] + [(["z"], 0)] * 100
    df = spark.createDataFrame(rows, "tokens array<string>, bad int")
    assert {m.items for m in mine(df, longest=None)} == {tuple("abcd")} and mine(df) == []


def test_tokens_of_the_same_rows_are_one_item(spark):
    """Many tokens that stand together make neither 2 ** n sets nor fewer rules."""
    import time

    together = [f"t{i:02}" for i in range(30)]
    rows = [([*together, "x"], 1)] * 40 + [(["x", "y"], 0)] * 60 + [([*together[:2], "y", "z"], 1)] * 30
    df = spark.createDataFrame(rows, "tokens array<string>, bad int")
    begin = time.time()
    got = mine(df, support=0.01, least=20, confidence=0.8, longest=None)
    assert time.time() - begin < 60
    rules = {m.items: (m.confidence, m.support) for m in got}
    # the first two stand in 70 bad rows, the other 28 in 40, z in 30
    assert {(t,) for t in together} | {("z",)} == {i for i in rules if len(i) == 1}
    assert all(rules[t,] == (1.0, 70 if t in together[:2] else 40) for t in together)
    assert not [i for i in rules if len(i) > 1]
