import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from placetime.llm import divergence as d

WORDS = "the of and to in is that for it as with was on be by this from or are an river market garden winter letter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS[:20]) if rng.random() < 0.6 else "".join(rng.choice(["ra", "ne", "ti", "mol", "se"]) for _ in range(6)) for _ in range(n)).capitalize() + "."


@given(st.lists(st.sampled_from("abc"), max_size=40), st.sampled_from([3, 5]))
@settings(max_examples=200, deadline=None)
def test_repeated_words(words, size):
    at = {}
    for i in range(len(words) - size + 1):
        at.setdefault(tuple(words[i : i + size]), []).append(i)
    inside = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + size)}
    assert d.repeated_words([w.encode() for w in words], size) == len(inside)


@given(st.text(alphabet="aB1 #*$\n\t.é日\x0b", max_size=60))
@settings(max_examples=200, deadline=None)
def test_base_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stats = d.base_stats(text)[0]
    assert stats[:4] == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))]


def test_distance():
    assert d.js_distance(np.array([1.0, 0]), np.array([0, 3.0])) == pytest.approx(1)
    assert d.js_distance(np.array([1.0, 2]), np.array([2.0, 4])) == pytest.approx(0, abs=1e-6)
    p, q = np.array([3.0, 1]), np.array([1.0, 1])
    a, b, m = p / 4, q / 2, (p / 4 + q / 2) / 2
    assert d.js_distance(p, q) == pytest.approx(float(np.sqrt((np.sum(a * np.log2(a / m)) + np.sum(b * np.log2(b / m))) / 2)))


def test_far_texts_go_and_fair_ones_stay(spark, docs_of):
    rng = random.Random(1)
    clean = [(k, prose(rng, rng.randint(60, 300))) for k in range(120)]
    shout = [(200 + k, " ".join(w.upper() + "!!" for w in prose(rng, 150).split())) for k in range(4)]
    table = [(300 + k, " | ".join("".join(rng.choice(["ra", "ne", "ti", "mol", "se"]) for _ in range(6)) for _ in range(200))) for k in range(4)]
    kept = {r.doc_id: r.kept for r in d.judge(docs_of(clean + shout + table)).collect()}
    assert sum(not kept[k] for k, _ in clean) <= 1
    assert not any(kept[k] for k, _ in shout + table)


def test_odd_rows(spark, docs_of, odd_rows):
    df = docs_of(odd_rows)
    rows = d.judge(df).collect()
    assert len(rows) == len(odd_rows)
    assert [r.base_failed for r in rows if r.text is None or not r.text.strip()] == [True] * 4
    assert {r.n_words for r in rows if r.doc_id == 1} == {7}
    assert d.keep_clean(df).columns == df.columns
    assert d.judge(df.limit(0)).count() == 0


def test_short_texts_are_not_judged(spark, docs_of):
    rng = random.Random(2)
    rows = [(k, prose(rng, 200)) for k in range(60)] + [(99, "A | B | C | D | E | F | G | H | I | J")]
    r = d.judge(docs_of(rows)).where("doc_id = 99").first()
    assert r.kept and r.char_distance is None and r.word_distance is None


def test_a_rare_language_is_judged_without_its_script(spark, docs_of):
    rng = random.Random(7)
    rows = [(k, prose(rng, 300)) for k in range(60)]
    made = lambda signs, end: " ".join("".join(rng.choice(signs) for _ in range(6)) + (end if k % 12 == 11 else "") for k in range(200))
    rows += [(900, made("日本語文章長書新聞天気", "。"), "ja", "s"), (901, made("абвгдежзиклмн", "."), "ru", "s")]
    rows += [(902, " ".join(f"#{k}|{k * 7919}$" for k in range(200)), "xx", "s"), (903, " ".join(f"%%{k}## **{k * 31}" for k in range(150)), "ja", "s")]
    got = {r.doc_id: (r.kept, r.word_distance) for r in d.judge(docs_of(rows)).where("doc_id >= 900").collect()}
    assert got[900][0] and got[901][0]
    chars = {r.doc_id: r.char_distance for r in d.judge(docs_of(rows)).collect()}
    assert max(chars[900], chars[901]) < min(chars[902], chars[903])
    assert not got[902][0] and not got[903][0] and all(w is None for _, w in got.values())


def test_the_verdict_equals_its_definition(spark, docs_of):
    """kept by brute force: histograms of all texts that pass the base rules, distances, limits."""
    from collections import Counter

    rng = random.Random(11)
    rows = [(k, prose(rng, rng.randint(20, 200)), rng.choice(["en", "fr-CA"]), "s") for k in range(150)]
    rows += [(500 + k, " ".join(rng.choice(["A|B", "#1", "zz"]) + str(rng.randrange(99)) for _ in range(90)), "en", "s") for k in range(5)]
    stats = {r[0]: d.base_stats(r[1]) for r in rows}
    passed = [r for r in rows if not d.base_failed(stats[r[0]][0])]
    total, words = {}, {}
    for k, text, lang, _ in passed:
        code = lang[:2]
        total[code] = total.get(code, 0) + stats[k][2]
        words.setdefault(code, Counter()).update(w.decode() for w in stats[k][1])
    pooled = d.scriptless(sum(total.values()))
    want = {}
    for k, text, lang, _ in rows:
        own, n = stats[k], stats[k][0][0]
        code = lang[:2]
        chars = common = None
        if sum(words[code].values()) >= d.MIN_REFERENCE:
            top = sorted(words[code].items(), key=lambda x: (-x[1], x[0]))[: d.TOP_WORDS]
            bins = np.array([c for _, c in top] + [sum(words[code].values()) - sum(c for _, c in top)], float)
            place = {w: i for i, (w, _) in enumerate(top)}
            if len(text) >= d.MIN_CHARS:
                chars = d.js_distance(own[2], total[code])
            if n >= d.MIN_WORDS:
                common = d.js_distance(np.bincount([place.get(w.decode(), len(top)) for w in own[1]], minlength=len(bins)), bins)
        elif len(text) >= d.MIN_CHARS:
            chars = d.js_distance(d.scriptless(own[2]), pooled)
        far = lambda x, size, limit: x is not None and x > limit[0] + limit[1] / size**0.5
        want[k] = not d.base_failed(own[0]) and not far(chars, len(text), d.CHAR_LIMIT) and not far(common, n, d.WORD_LIMIT)
    got = {r.doc_id: r.kept for r in d.judge(docs_of(rows)).collect()}
    assert got == want and set(want.values()) == {True, False}
