import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from placetime.llm import group_join as g
from placetime.llm.components import components


def brute(rows, size=4, percent=85):
    """(doc_id, set size, smallest doc_id in reach) of every row, from all pairs."""
    sets = []
    for key, text, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for z in s:
            holders[z].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for z in s for j in holders[z] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(top(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), sets, top


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    out, last = [], 1000
    for group in range(24):
        base = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.choice([1, 2, 3, 40 if group < 2 else 4])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                own = own + passage
            out.append((last, " ".join(w.upper() if rng.random() < 0.1 else w for w in own)))
            last += 1
    for k in range(30):  # a chain: each is like the next one only
        out.append((last + k, " ".join(f"c{j}" for j in range(5 * k, 5 * k + 80))))
    rng.shuffle(out)
    return out + [(r[0], r[1]) for r in odd_rows]


def test_components_of_brute_force(spark, docs_of, rows):
    want = brute(rows)[0]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in g.classes(docs_of(rows), most_frequent=40).collect())
    assert got == want


def test_one_of_each_group_stays(spark, docs_of, rows):
    _, sets, top = brute(rows)
    df = docs_of(rows)
    left = g.one_of_each(df)
    assert left.columns == df.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect())
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[top(i) if sets[i] else ("alone", i)].append((r[0] is None, r[0] or 0, r[1] or ""))
    assert len(got) == len(groups)
    assert Counter(x[:2] for x in got) == Counter(min(v)[:2] for v in groups.values())


def test_empty_table(spark, docs_of, odd_rows):
    df = docs_of(odd_rows).limit(0)
    assert g.classes(df).count() == 0 and g.one_of_each(df).count() == 0


def test_components(spark):
    rng = random.Random(12)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, 2000 + k) for k in range(1, 100)] + [(None, 3), (5, 5)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_map_has_all_keys(spark):
    rng = random.Random(13)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    bits, whole = g.bit_map(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert all(g.in_map(bits, whole, k) for k in keys)
    others = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    assert sum(g.in_map(bits, whole, k) for k in others) < 300


def crowd(copies, seed=14, words=147, variants=6, private=2):
    """Copies of a text with edits in common and edits of their own: most pairs are not linked, those with the same variant may be."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    edits = [rng.sample(range(words), 4) for _ in range(variants)]
    rows = []
    for key in range(copies):
        own, v = list(base), rng.randrange(variants + 1)
        for k in edits[v] if v < variants else []:
            own[k] = f"v{v}"
        for k in rng.sample(range(words), rng.randint(0, private)):
            own[k] = f"own{key}"
        rows.append((key, " ".join(own)))
    return rows


def test_crowds_keep_all_links(spark, docs_of, rows, monkeypatch):
    monkeypatch.setattr(g, "CROWD", 3, raising=False)
    rows = rows + [(r[0] + 5000, r[1]) for r in crowd(150) + crowd(60, 15, 30, 4, 1)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in g.classes(docs_of(rows), most_frequent=40).collect())
    assert got == brute(rows)[0]


def test_pairs_do_not_grow_with_the_square_of_a_crowd(spark, docs_of, monkeypatch):
    pairs, verified = [], g.verified

    def counted(found, *rest):
        pairs.append(found.distinct().count())
        return verified(found, *rest)

    monkeypatch.setattr(g, "verified", counted)
    rng = random.Random(16)
    rows = []
    for key in range(500):
        own = [f"b{k}" for k in range(147)]
        for k in rng.sample(range(147), 6):
            own[k] = f"own{key}x{k}"
        rows.append((key, " ".join(own)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in g.classes(docs_of(rows)).collect()) == brute(rows)[0]
    assert sum(pairs) < 20 * len(rows)


def test_prefixes_of_differences_find_every_link():
    rng = random.Random(17)
    for _ in range(4000):
        m = rng.randint(5, 60)
        p, percent = set(range(m)), rng.choice([50, 80, 85])
        x, y = (p ^ set(rng.sample(range(m + 20), rng.randint(0, 12))) for _ in "xy")
        x, y = sorted((x, y), key=lambda s: len(s ^ p))
        n, k = len(x), len(y)
        near = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
        if not near(x, y) or (near(x, p) and near(y, p)):
            continue
        few = g._prefixes(len(x ^ p), n, m, near(x, p), percent)[0]
        many = g._prefixes(len(y ^ p), k, m, near(y, p), percent)[1]
        assert set(sorted(x ^ p)[:few]) & set(sorted(y ^ p)[:many])


def test_steps_without_rows_are_left_out(spark, docs_of, monkeypatch):
    """Each step costs the driver threads and memory, whatever its rows; without crowds and open pairs there is nothing to do."""
    labels, kept = [], g.written
    monkeypatch.setattr(g, "written", lambda df, label: labels.append(label) or kept(df, label))
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(20)]
    rows += [(50 + k, rows[k][1] + " end") for k in range(5)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in g.classes(docs_of(rows)).collect())
    assert got == brute(rows)[0] and sum(c < d for d, _, c in got) == 5
    assert "differences" not in labels and labels.count("bodies") == 1


def test_repeated_shingles_are_counted_in_place():
    import tracemalloc

    rng = np.random.default_rng(5)
    for n, top, least in [(0, 5, 3), (1, 5, 1), (2, 1, 3), (3, 1, 3), (50, 20, 1), (500, 150, 3), (500, 3, 3), (500, 400, 2)]:
        values = rng.integers(0, top, n).astype(np.uint64)
        want, counts = np.unique(values, return_counts=True)
        got = g.repeated(values.copy(), least)
        assert [x.tolist() for x in got] == [want[counts >= least].tolist(), counts[counts >= least].tolist()]
    values = rng.integers(0, 1 << 40, 400_000).astype(np.uint64)
    values[:3000] = 7
    tracemalloc.start()
    try:
        got = g.repeated(values, g.LEAST_HERE)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[0][0] == 7 and got[1][0] == 3000
    assert peak < values.nbytes  # counting by np.unique takes four times their size
