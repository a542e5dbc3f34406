import random
from collections import Counter, defaultdict

from placetime.llm import boilerplate as b


def brute(rows, percent, least):
    pages, seen = Counter(), defaultdict(Counter)
    for r in rows:
        pages[r[3] or ""] += 1
        seen[r[3] or ""].update({x.strip(b.BLANKS) for x in (r[1] or "").split("\n") if x.strip(b.BLANKS)})
    out = []
    for key, text, _, host in rows:
        host = host or ""
        bad = {x for x, n in seen[host].items() if n >= least and 100 * n > percent * pages[host]}
        lines = (text or "").split("\n")
        held = [x for x in lines if x.strip(b.BLANKS) not in bad]
        out.append((key, sum(bool(x.strip(b.BLANKS)) for x in lines), len(lines) - len(held), None if text is None else "\n".join(held)))
    return Counter(out)


def test_same_as_brute_force(spark, docs_of, odd_rows):
    rng = random.Random(3)
    rows = [
        (k, "\n".join(rng.choice(["Home | About", " all rights reserved ", f"own line {k}", "", "menu"] + [f"line {rng.randint(0, 200)}"] * 3) for _ in range(rng.randint(1, 8))), "en", rng.choice(["a", "b", "b", "b", None, ""]))
        for k in range(300)
    ] + [(*r[:2], "en", "odd") for r in odd_rows]
    for percent, least in ((10, 5), (30, 2)):
        df = b.drop_lines(docs_of(rows), max_percent=percent, min_pages=least)
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect())
        assert got == brute(rows, percent, least)
        assert sum(k[2] for k in got) > 0


def test_empty_and_clashing(spark, docs_of):
    df = docs_of([(1, "a\nb")])
    assert b.drop_lines(df).first().host == "h"
    assert b.drop_lines(df.limit(0)).count() == 0
