import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from placetime.llm import collocations as co

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(rows, longest=5):
    """Occurrences by (lang, words), and words by lang, from (text, lang) rows."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return f, n


def plain(rows, support, covered=100, top=2000, longest=5):
    f, n = counts_of(rows, longest)
    frequent = {p: c for p, c in f.items() if c >= support}
    by_lang = defaultdict(list)
    for (lang, w), a in frequent.items():
        if len(w) < 2:
            continue
        inside = [c for (other, x), c in frequent.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if any(100 * c >= covered * a for c in inside):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, texts=160):
    rnd = random.Random(seed)
    words = ["a", "A", "b", "c", "da", "Éa", "\xa0x", "日"]
    fixed = ["in the end of it", "a a a a a a", "b c. da b c", "the\x0bend"]
    out = []
    for _ in range(texts):
        parts = [rnd.choice(words) if rnd.random() < 0.8 else rnd.choice(fixed) for _ in range(rnd.randrange(30))]
        out.append((rnd.choice([" ", "  ", "\t"]).join(parts) + rnd.choice(["", "!", "\n", ";;"]), rnd.choice(["en"] * 6 + ["fr", None, "und", ""])))
    return out + [(None, "en"), ("", None), (" \t. ", "fr"), ("only here", "xx")]


@pytest.mark.parametrize("seed, shard_bytes, block, covered", [(1, 1 << 20, 1000, 100), (2, 900, 40, 100), (3, 300, 1000, 70)])
def test_equals_counting_everything(spark, seed, shard_bytes, block, covered):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    frequent, words = co.frequent_phrases(docs, 12, 5, shard_bytes, block)
    f, n = counts_of(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in frequent.collect()} == {p: c for p, c in f.items() if c >= 12}
    assert {r.lang: r.n for r in words.collect() if r.n} == {lang: c for lang, c in n.items() if c}
    got = co.best_phrases(docs, 9, support=12, shard_bytes=shard_bytes, block=block) if covered == 100 else None
    if got is not None:
        assert sorted(map(tuple, got.collect())) == plain(rows, 12, top=9)
    else:
        kept = {(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.scored(frequent, words, covered).collect()}
        assert kept == {(r[0], *r[2:]) for r in plain(rows, 12, covered)}


def test_phrases_that_meet_the_bound_in_no_large_shard_are_found(spark):
    """Exactly the support in all, spread evenly: each shard has just its share."""
    rows = [(f"x{k} same two words y{k}", "en") for k in range(100)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    frequent, _ = co.frequent_phrases(docs, 100, 5, 300, 1000)
    assert {r.phrase: r.f for r in frequent.collect()} == {"same": 100, "two": 100, "words": 100, "same two": 100, "two words": 100, "same two words": 100}


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, co.best_phrases(docs, support=3).collect())) == plain(kept, 3)
    assert co.best_phrases(docs.limit(0)).collect() == []


def test_scores_pass_64_bits(spark):
    f = {"a": 4 * 10**11, "b": 3 * 10**11, "a b": 2 * 10**11}
    frequent = spark.createDataFrame([("en", p, c) for p, c in f.items()], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    (row,) = co.scored(frequent, words).collect()
    assert row.score == 1000 * f["a b"] * 10**13 // (f["a"] * f["b"]) and 1000 * f["a b"] * 10**13 > 2**64


def test_local_mining_is_complete():
    rnd = np.random.default_rng(4)
    ids = rnd.integers(-1, 4, 500).astype(np.int32)
    got = {tuple(ids[p : p + k].tolist()): int(c) for first, n, k in co.mine(ids, 5, 4) for p, c in zip(first, n)}
    every = Counter(tuple(ids[i : i + k].tolist()) for k in range(1, 5) for i in range(len(ids) - k + 1))
    assert got == {p: c for p, c in every.items() if c >= 5 and -1 not in p}


def test_local_phrases_grow_with_the_table_and_not_faster(spark, monkeypatch):
    """More text is more pieces, not a lower local support."""
    rows, kept = {}, co.written

    def noted(df, label):
        out = kept(df, label)
        if label == "phrases-local":
            rows[texts] = rows.get(texts, 0) + out.where("phrase is not null").count()
        return out

    monkeypatch.setattr(co, "written", noted)
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    draw = lambda: " ".join(rnd.choices(words, [1 / (k + 1) for k in range(200)], k=30))
    for texts in (100, 500):
        docs = [(draw(), "en") for _ in range(texts)]
        frequent, _ = co.frequent_phrases(spark.createDataFrame(docs, "text string, lang string"), 60, 5, 2000, 1000)
        assert {tuple(r.phrase.split(" ")): r.f for r in frequent.collect()} == {p: c for (_, p), c in counts_of(docs)[0].items() if c >= 60}
    assert rows[500] < 8 * rows[100]
