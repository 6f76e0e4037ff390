import hashlib
import random
import re

from pagemill.llm.pii import KINDS, base_spans, bootstrap, candidates, edges, find, joined, luhn, mask, op6_pii, shape, left_context

SF = "/root/testdata/sf0.01"


def plain(text):
    """The patterns as they are written, each with finditer."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice(["a", "@", ".", "1", "25", "255.", "300.", "b@c.d", "+", " ", "-", "(", ")", "é", "4111111111111111", "@x", "%", "\n", "0001.", "127.0.0.1"]) for _ in range(r.randrange(30)))
        assert base_spans(t) == plain(t), t
    base_spans("1" * 3_000_00 + "@" + "." * 300_000 + "a@b" * 50_000)  # linear time


def test_whole_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_pii(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[2] for s in want) for k in KINDS]
        assert set(joined(want).split(",")) <= set(r.spans.split(","))


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"Reach us: call me on +1 (212) 555-0{i}00 today" for i in range(100, 120)]
    texts += [f"please call me on 0151 555 {i} soon" for i in range(1000, 1010)]
    texts += [f"item number is {i} now" for i in range(5000, 5020)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    patterns = bootstrap(edges(df, "text"), least=0.6)
    assert {(p[0], p[2]) for p in patterns} == {("me on", "phone")}
    got = {r.doc_id: r.spans for r in find(df, patterns).collect()}
    assert got[20] == "phone:18:31" and got[35] == "" and got[0].startswith("phone:")
    masked = [r.text for r in mask(df, patterns).orderBy("doc_id").collect()]
    assert masked[20] == "please call me on <phone> soon" and masked[35] == texts[35]


def test_odd_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "a@b.c", "s"), (4, "x 1.2.3.4 " * 20000, "s"), (4, "+1 (212) 555-0100", "s"), (4, "+1 (212) 555-0100", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.spans[:12]) for r in find(df, []).collect())
    assert got == [(0, "email:0:5"), (1, ""), (2, ""), (4, "ip:2:9,ip:12"), (4, "phone:0:17"), (4, "phone:0:17")]
    assert mask(df, []).where("text is null").count() == 1
    empty = df.limit(0)
    assert bootstrap(edges(empty, "text")) == [] and find(empty, []).count() == 0


def test_second_hop(spark):
    """'home at' introduces no seed, only numbers that 'me on' taught."""
    texts = [f"Reach us: call me on +1 (212) 555-0{i}00 today" for i in range(100, 130)]
    texts += [f"please call me on 0151 555 {i} soon" for i in range(1000, 1005)]
    texts += [f"or ring home at 0151 555 {i} soon" for i in range(1000, 1005)]
    texts += ["or ring home at 0151 555 2000 soon", "item number is 5000 now", "item number is 5001 now"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    patterns = bootstrap(edges(df, "text"), least=0.6)
    assert {(p[0], p[2]) for p in patterns} == {("me on", "phone"), ("home at", "phone")}
    got = {r.doc_id: r.spans for r in find(df, patterns).collect()}
    assert got[40] == "phone:16:29" and got[41] == ""


def test_every_trusted_pattern_is_kept(spark):
    seen = spark.range(2100).selectExpr("concat('context ', id) as left", "id", "explode(sequence(0, 5)) as j")
    graph = seen.selectExpr("left", "if(j < 5, '+9', '9') as shape", "if(j < 5, j, 1000 + id) as instance", "if(j < 5, 'phone', null) as kind", "1L as n")
    patterns = bootstrap(graph)
    assert len(patterns) == len({p[0] for p in patterns}) == 2100


def test_candidates_of_any_length():
    name = "user-" + "x" * 300 + "-12345"
    text = f"the account {name}, ok"
    assert [text[a:b] for a, b in candidates(text, [])] == [name]
    assert shape("a-" * 30 + "1") != shape("a-" * 30 + "1_") and shape("abc-12") == "a-9"
    many = "12 " * 200_000
    assert candidates(many, []) == [(0, len(many) - 1)]  # linear time


def test_a_long_identifier_is_learned_and_masked(spark):
    long = [f"acct-{'y' * 80}-{i}" for i in range(1000, 1004)]
    texts = [f"write login as m{i}@ex.org now" for i in range(30)] + [f"write login as {x} now" for x in long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masked = [r.text for r in mask(df, bootstrap(edges(df, "text"))).orderBy("doc_id").collect()]
    assert masked[30:] == ["write login as <email> now"] * 4


def test_contexts_of_any_length():
    long = "x" * 3000
    for lead in (f"{long} id ", f"a {long} ", f"first line {long}\nno {long[:200]} "):
        text = lead + "K1234567"
        want = " ".join(lead.rpartition("\n")[2].split()[-2:]).lower()
        assert left_context(text, len(lead)) == want
    assert left_context("only 12345", 5) is None and left_context("", 0) is None
