import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from placetime.llm import packing as p

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_least_squares_against_projected_gradient():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 3, (12, 20)).astype(float)
    a[0] += 1
    h = rng.integers(0, 50, 12).astype(float)
    x = p.least_squares([{i: v for i, v in enumerate(c) if v} for c in a.T], h, 3000)
    y = np.zeros(20)
    step = 1 / np.linalg.norm(a.T @ a, 2)
    for _ in range(60_000):
        y = np.maximum(0, y - step * (a.T @ (a @ y - h)))
    assert (x >= 0).all()
    assert np.sum((a @ x - h) ** 2) == pytest.approx(np.sum((a @ y - h) ** 2), rel=1e-2, abs=1e-2)


def test_repeats_fit_the_histogram():
    rng = np.random.default_rng(3)
    h = np.zeros(64, np.int64)
    h[1:] = rng.integers(0, 40, 63)
    used = Counter()
    for combo, times in p.solve(h, 64):
        assert sum(combo) == 64 and times > 0
        for a in combo:
            used[a] += times
    assert all(n <= h[a] for a, n in used.items())
    assert sum(used.values()) > 0.7 * h.sum()


def test_layout_places_every_id_once():
    rng = random.Random(4)
    for window in (8, 64):
        lengths = [rng.randrange(1, window) for _ in range(500)]
        layout, rank, filled = p.Layout(np.bincount(lengths, minlength=window), window), Counter(), defaultdict(list)
        for a in lengths:
            pieces = layout.remainder(a, rank[a])
            rank[a] += 1
            assert sum(x[0] for x in pieces) == a
            for size, sequence, offset in pieces:
                filled[sequence].append((offset, size))
        assert sorted(filled) == list(range(layout.full_first))
        for parts in filled.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= window and at & (at - 1) == 0


def test_pack(spark, docs_of, odd_rows):
    rng = random.Random(5)
    rows = odd_rows + [(100 + k, " ".join(rng.choice(["river", "house", "stone", "123"]) for _ in range(rng.randint(0, 400)))) for k in range(150)]
    window = 128
    got = p.pack(docs_of(rows), PATH, window=window).collect()
    library = Tokenizer.from_file(PATH)
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    whole, sequences = defaultdict(list), defaultdict(list)
    for k, own in enumerate(ids):
        whole[rows[k][0], len(own)].append(own)
    for r in got:
        assert any(crc(own[r.start : r.start + r.length]) == r.ids_crc32 for own in whole[r.doc_id, r.doc_tokens])
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= window and at & (at - 1) == 0
    by_doc = defaultdict(list)
    for r in got:
        if r.doc_id and r.doc_id >= 100:
            by_doc[r.doc_id].append((r.start, r.length))
    for key, parts in by_doc.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size


def test_empty_table(spark, docs_of, odd_rows):
    assert p.pack(docs_of(odd_rows).limit(0), PATH).count() == 0


def test_encoding_starts_no_collection():
    import gc

    import public_tokenizers

    from placetime.llm.tokens import Encoder

    texts = [" ".join(f"w{k % 50}x{j}" for k in range(400)) + "\n" + "line  two\nend." for j in range(400)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        made = Encoder(public_tokenizers.path(name))
        runs = []
        gc.collect()
        watch = lambda phase, info: runs.append(phase)
        gc.callbacks.append(watch)
        try:
            got = made.encode(texts)
            during = len(runs)
        finally:
            gc.callbacks.remove(watch)
        assert gc.isenabled() and not during
        assert got == made._call(texts)


def test_words_after_line_feeds_and_odd_blanks_are_those_of_whole_texts():
    import public_tokenizers

    from placetime.llm.tokens import Encoder

    texts = [
        "a\nb c\nb", "\na b", "a b\n", "a\n\nb", " a", "a ", "a  b", "a\tb c", "a\r\nb", "\n", " ", "Élan.\nÉlan, straße\nQUEUE.", "one two x\nthree four",
        "İx İx\nİx", "x" * 90 + ".\n" + "x" * 90 + ". " + "x" * 90, "a\x1cb c", "1.5 -x. ..\n.. ,", None, "", "<|endoftext|> a\n<|endoftext|>", "日本 語\n日本",
    ]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        made = Encoder(public_tokenizers.path(name))
        for _ in range(2):  # the second time from the cache
            assert made.encode(texts) == made._call([t or "" for t in texts])


def test_words_that_came_again_stay_known(monkeypatch):
    from placetime.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_WORDS", 60)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        made = tokens.Encoder(public_tokenizers.path(name))
        learned, learn = [], made._learn
        monkeypatch.setattr(made, "_learn", lambda new, learned=learned, learn=learn: (learned.append(set(new)), learn(new)))
        rare = [" ".join(f"w{k}x{j}" for j in range(50)) for k in range(8)]
        for text in ["river house", "house river", *rare, "house river", *(" ".join(f"v{k} v{k}." for k in range(50)) for _ in range(3))]:
            assert made.encode([text]) == made._call([text])
            assert len(made.words) <= 60 + 2 * 101
        assert "house" not in set().union(*learned[2:])


def test_worker_keeps_no_rare_words_between_tasks(monkeypatch):
    from placetime.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_WORDS", 300)
    held = lambda e: sum(len(v) for v in vars(e).values() if isinstance(v, (dict, set)))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        made = tokens.Encoder(public_tokenizers.path(name))
        made.encode([""])
        empty = held(made)
        for k in range(12):  # twelve groups, as tasks have them, of 200 rare words each
            text = "river house " + " ".join(f"w{k}x{j}" for j in range(200))
            assert made.encode([text]) == made._call([text])
            assert held(made) - empty <= 300 + 2 * 202  # the words once, in a single dictionary
        made.forget_fresh()
        assert held(made) - empty <= 3
        assert made.encode(["river house, Élan!! (x) straße***\nhouse;"]) == made._call(["river house, Élan!! (x) straße***\nhouse;"])


def test_words_that_end_in_signs_are_merged_once():
    from placetime.llm import tokens

    words = ["house!!", "Élan***", "river&&&", "straße;", "QUEUE)", "a|", "b_", "x" * 70 + "%%%", "end" + "!" * 9, "it's!", "a'"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        made = tokens.Encoder(public_tokenizers.path(name))
        text = " ".join(words + words) + "\n" + "\n".join(words)
        assert made.encode([text]) == made._call([text])
        assert {"!!", "***", "&&&", ";", ")", "|", "_", "%%%"} <= set(made.ends)
