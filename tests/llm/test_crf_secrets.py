import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from placetime.llm import crf_secrets as c


def plain(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return c.ordered(out)


def corpus(rng, n):
    words = "the service was deployed and then restarted on a new host by team".split()
    texts = []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(0, 2)):
            value = "".join(rng.choice("abcdef0123456789ABCXYZ") for _ in range(rng.randint(16, 40)))
            hexed = "".join(rng.choice("abcdef0123456789") for _ in range(rng.randint(32, 40)))
            t.insert(rng.randrange(len(t)), rng.choice([f"password={value}", f'token: "{value}"', f"API_KEY = {value}", hexed, "AKIA" + value.upper()]))
        if rng.random() < 0.3:
            t.insert(rng.randrange(len(t)), rng.choice([str(rng.randrange(10**15, 10**16)), "2024-01-05", "10.2.3.4", "v1.22.3"]))
        texts.append(" ".join(t))
    return texts


@pytest.fixture(scope="module")
def field():
    rng = random.Random(8)
    rows = [w for t in corpus(rng, 400) for w in c.labelled(t)]
    learn = [([c.shape(t) for t in r[1]], r[2], np.array(r[3], np.float32)) for r in rows]
    return c.train(learn, 80)


def test_base_spans():
    rng = random.Random(1)
    parts = ["password", "=", ":", " ", '"', "'", "AKIA", "secret", "Api_Key", "deadbeef", "0123456789abcdef", "ABCDEF123456", "token", ".", "ſ", "K", "é", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert c.base_spans(text) == plain(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(30):
        score, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        value = lambda p: sum(score[i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=5), key=value)
        assert value(c.viterbi(score, moves)) == pytest.approx(value(best))


def test_stretches_give_the_path_of_the_whole_text(field):
    rng = random.Random(3)
    tagger = c.Tagger(*field)
    loose = c.Tagger(field[0] * 0.05, field[1])  # many open tokens
    for t in corpus(rng, 60):
        tokens = c.TOKEN.findall(t)
        for x in (tagger, loose):
            whole = {k: tag for k, tag in enumerate(c.viterbi(x.scores(tokens), x.moves)) if tag != c.O}
            assert x.tags(tokens) == whole


def test_held_out_accuracy(field):
    rng = random.Random(99)
    tagger, hit, miss, false = c.Tagger(*field), 0, 0, 0
    for t in corpus(rng, 150):
        for _, tokens, tags, _ in c.labelled(t):
            found = c.viterbi(tagger.scores(tokens), tagger.moves)
            hit += sum(a != c.O and b != c.O for a, b in zip(found, tags))
            miss += sum(a == c.O and b != c.O for a, b in zip(found, tags))
            false += sum(a != c.O and b == c.O for a, b in zip(found, tags))
    assert hit / (hit + miss) > 0.95 and hit / (hit + false) > 0.95


def test_finds_what_no_pattern_has(field):
    text = "the service was deployed with pwd : Zx81Qm42Lk97Tr60Wd35 and then restarted by team"
    assert c.base_spans(text) == []
    assert ("crf", text.index("Zx81"), text.index(" and then")) in c.Tagger(*field).spans(text)


def test_scan(spark, docs_of, odd_rows):
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(corpus(random.Random(5), 80))]
    got = c.scan(docs_of(rows)).collect()
    want = sorted((str(r[0]), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(r[1] or "")).encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    texts = {r[0]: r[1] or "" for r in rows if (r[0] or 0) >= 100}
    for r in got:
        if r.doc_id in texts:
            spans = r.spans.split(",") if r.spans else []
            base = [f"{k}:{a}:{b}" for k, a, b in plain(texts[r.doc_id])]
            assert set(base) <= set(spans) and len(spans) == len(base) + r.n_crf == r.n_assign + r.n_access + r.n_hex + r.n_crf


def test_nothing_to_learn_from(spark, docs_of, odd_rows):
    assert {r.spans for r in c.scan(docs_of(odd_rows)).collect()} == {""}
    assert c.scan(docs_of(odd_rows).limit(0)).count() == 0


def test_every_text_may_train(spark, docs_of):
    """The bounded sample is the windows with the smallest hashes of all texts, however they are dealt out."""
    import zlib

    texts = corpus(random.Random(8), 120) + ["one plain text without any secret " * k for k in range(1, 40)]
    rows = [(k, t) for k, t in enumerate(texts)] * 2
    secret, quiet = {}, {}
    for t in texts:
        for w in c.windows(t, True):
            secret[zlib.crc32("\0".join(w[0]).encode()), tuple(w[0])] = w
        quiet[zlib.crc32(t.encode())] = c.windows(t, False)
    quiet = [(k, tuple(w[0])) for k, found in sorted(quiet.items())[:25] for w in found]
    secret = sorted(secret)[:25]
    for parts in (1, 5):
        got = c.training_rows(docs_of(rows).repartition(parts), 25)
        for kind, every in ((True, secret), (False, quiet)):
            assert sorted((r.key, tuple(r.tokens)) for r in got if r.secret == kind) == every


def test_all_secrets_of_a_text_are_offered():
    text = " filler ".join(f"password = Abc{k}def{k}ghi{k}" + " word" * 30 for k in range(9))
    assert len(c.windows(text, True)) == 9
