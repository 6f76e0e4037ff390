import random

from pagemill.llm.minhash_dedup import near_duplicates, op7_minhash_dedup

SF = "/root/testdata/sf0.001"
GAPS = " \t\n\r\x0b\x0c"


def words(text):
    out, cur = [], ""
    for ch in text or "":
        if ch in GAPS:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    return out + [cur] * bool(cur)


def brute(rows, width, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    top[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[root(x)] = min(i, least.get(root(x), i))
    return sorted((i, len(sets[x]), least[root(x)], i == least[root(x)]) for x, (i, _) in enumerate(rows))


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, op7_minhash_dedup(spark, SF).collect()))
    assert got == brute(rows, 3, 85)


def test_families_of_near_copies(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(4):
        base = [r.choice(vocab) for _ in range(120)]
        for _ in range(25):
            t = list(base)
            for _ in range(r.randrange(0, 9)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((i, " ".join(t)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, width=3, percent=85).collect())) == brute(rows, 3, 85)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c"), (7, "x " * 30000), (8, "x " * 29000), (8, "x " * 29000), (None, "a b c"), (9, "İ a b c d")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, width=3, percent=85).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[5] == (1, 4, False) and got[6][1] == 6 and got[8] == (1, 7, False) and got[None] == (1, 6, False)
    assert near_duplicates(df.limit(0)).count() == 0
