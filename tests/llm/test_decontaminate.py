import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placetime.llm import decontaminate as d


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, size=5, percent=80):
    """Best similarity of every pair at or above the limit, over all windows."""
    found = {}
    for i, item in items.items():
        k = min(size, len(item))
        if not k:
            continue
        want = Counter(tuple(item[a : a + k]) for a in range(len(item) - k + 1))
        m = len(item) - k + 1
        for key, doc in docs.items():
            runs = [tuple(doc[a : a + k]) for a in range(len(doc) - k + 1)]
            for s in range(len(runs) - m + 1):
                own = Counter(runs[s : s + m])
                both = sum(min(own[z], want[z]) for z in own)
                if 100 * both >= percent * (2 * m - both):
                    found[key, i] = max(found.get((key, i), 0), both / (2 * m - both))
    return found


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    items = {k: [rng.choice(vocabulary) for _ in range(n)] for k, n in enumerate([60, 60, 80, 15, 20, 3, 120, 80])}
    items[7] = items[7][:20] * 4  # repeated shingles
    docs = {}
    for k in range(120):
        doc = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        if k < 60:
            own = list(items[k % 8])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                spot = rng.randrange(len(own))
                if rng.random() < 0.5 and len(own) > 6:
                    del own[spot]
                else:
                    own[spot] = "changed"
            at = rng.randrange(len(doc))
            doc = doc[:at] + own + doc[at:]
        docs[k] = doc
    dress = lambda words: " ".join(w.capitalize() + rng.choice(["", ",", "."]) for w in words)
    df = spark.createDataFrame([(k, dress(w), "clash", "clash") for k, w in docs.items()], "doc_id long, text string, item_id string, row string")
    bench = spark.createDataFrame([(k, dress(w)) for k, w in items.items()] + [(50, None), (51, " ")], "item_id long, text string")
    return df, bench, docs, items


def found(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


def test_finds_what_all_windows_find(case):
    df, bench, docs, items = case
    want = brute(docs, items)
    got = found(d.matches(df, bench, ["doc_id"]))
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_slices_give_the_same(case):
    df, bench, _, _ = case
    assert found(d.matches(df, bench, ["doc_id"], broadcast_rows=100)) == found(d.matches(df, bench, ["doc_id"]))


def test_clean_drops_the_contaminated(case):
    df, bench, docs, items = case
    bad = {k for k, _ in brute(docs, items)}
    kept = d.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(docs) - bad


def test_simhash_and_blocks(spark):
    rng = random.Random(6)
    rows = [(k, [rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 90))]) for k in range(30)]
    df = spark.createDataFrame(rows, "k long, h array<bigint>").select("k", "h", d.simhash(F.col("h")).alias("f"))
    for r in df.collect():
        want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in r.h) > len(r.h))
        assert r.f & ((1 << 64) - 1) == want
    masks = [m & ((1 << 64) - 1) for m in d._masks(19)]
    assert sum(masks) == (1 << 64) - 1 and len(masks) == 20
    pairs = []
    for _ in range(200):  # any pair within the radius shares a block
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 19)):
            b ^= 1 << bit
        pairs.append((a - (1 << 63), b - (1 << 63)))
    blocks = spark.createDataFrame(pairs, "a bigint, b bigint").select(d.first_common_block(F.col("a"), F.col("b"), 19).alias("k")).collect()
    assert all(0 <= r.k < 20 for r in blocks)


def test_odd_rows(spark, docs_of, odd_rows):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "")], "item_id long, text string")
    df = docs_of(odd_rows)
    assert sorted(str(r.doc_id) for r in d.matches(df, bench, ["doc_id"]).collect()) == ["1", "1", "None"]
    assert d.clean(df, bench).count() == len(odd_rows) - 3
    assert d.matches(df.limit(0), bench, ["doc_id"]).count() == 0
    assert d.matches(df, bench.limit(0), ["doc_id"]).count() == 0
    assert d.clean(df, bench.limit(0)).count() == len(odd_rows)


def test_documents_shorter_than_the_item(spark):
    """The whole text is the window: found from the limit on, by the union of both; item sizes differ, and shingles repeat."""
    rng = random.Random(8)
    items = {n: [f"w{rng.randrange(5000)}" for _ in range(n)] for n in (15, 24, 40, 41, 59)}
    items[48] = items[24] * 2
    texts = {(n, cut): w[: n - cut] if cut % 2 else w[cut:] for n, w in items.items() for cut in range(14)}
    docs = dict(enumerate(texts.values()))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    want = brute(docs, items)
    for key, doc in docs.items():
        for i, item in items.items():
            own, whole = (Counter(tuple(t[a : a + 5]) for a in range(len(t) - 4)) for t in (doc, item))
            a, b, both = sum(own.values()), sum(whole.values()), sum((own & whole).values())
            if a < b and 100 * both >= 80 * (a + b - both):
                want[key, i] = both / (a + b - both)
    rows = d.matches(df, bench, ["doc_id"]).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    short = [r for r in rows if len(docs[r.doc_id]) < len(items[r.item_id])]
    assert len(short) > 20 and all((r.start, r.n_words, r.n_windows) == (0, len(docs[r.doc_id]), 1) for r in short)
    cut = next(k for k, x in enumerate(texts) if x == (40, 3))
    assert got[cut, 40] == pytest.approx(33 / 36) and cut not in {r.doc_id for r in d.clean(df, bench).collect()}


def test_items_that_share_an_id(spark):
    """Texts of one id, and of none, all count; the best match is reported once an id."""
    rng = random.Random(12)
    a, b, c, e = ([f"w{rng.randrange(5000)}" for _ in range(n)] for n in (30, 30, 40, 25))
    near = [*a[:29], "changed"]
    texts = [a, b, c, e, ["before", *near, "after"], c + b]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in [(1, a), (1, near), (1, b), (1, b), (None, c), (None, e), (2, c)]], "item_id long, text string")
    for settings in ({}, {"broadcast_rows": 30}):
        got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in d.matches(df, bench, ["doc_id"], **settings).collect()}
        assert got == {
            (0, 1): (0, 30, 1.0), (1, 1): (0, 30, 1.0), (2, None): (0, 40, 1.0), (2, 2): (0, 40, 1.0), (3, None): (0, 25, 1.0),
            (4, 1): (1, 30, 1.0), (5, None): (0, 40, 1.0), (5, 2): (0, 40, 1.0), (5, 1): (40, 30, 1.0),
        }
    assert d.clean(df, bench).count() == 0
