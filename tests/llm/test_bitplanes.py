import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from placetime.llm import bitplanes as b
from placetime.llm.tokens import Encoder, in_groups

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from([4, 32]), st.sampled_from([1, 8, 13, 64]), st.data())
@settings(max_examples=150, deadline=None)
def test_segment_round_trip(ids, planes, block, data):
    blob = b.pack(np.array(ids, "<u4"), planes, block)
    assert b.unpack(blob).tolist() == ids
    lo = data.draw(st.integers(0, len(ids)))
    hi = data.draw(st.integers(lo, len(ids)))
    assert b.unpack(blob, lo, hi).tolist() == ids[lo:hi]


def test_bad_segment():
    with pytest.raises(ValueError):
        b.unpack(b"x" * 40)


@pytest.mark.parametrize("name", FILES)
def test_cached_words_give_the_ids_of_whole_texts(name):
    rng, encode, whole = random.Random(7), Encoder(public_tokenizers.path(name)), library(name)
    alphabets = [" \n\t \x85\x1c abcAÉéÈ.,'s12ßΣσ!|<>ñ日本́ªḞ", "ab ,.\né", "aB's12 \n"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 40))) for a in alphabets for _ in range(3000)]
    texts += ["it's, he'll. <|endoftext|> foo", None, "", "x" * 5000, "One two.\nThree, four"]
    for a, z in in_groups(texts, 9_000):
        for text, ids in zip(texts[a:z], encode.encode(texts[a:z])):
            assert np.frombuffer(ids, "<u4").tolist() == whole(text), text


@pytest.mark.parametrize("planes", [4, 32])
def test_round_trip_of_a_table(spark, docs_of, odd_rows, planes):
    rows = odd_rows + [(100 + k, f"Text number {k}, with words.\nMore {k * k}") for k in range(60)]
    got = b.round_trip(docs_of(rows), public_tokenizers.path(FILES[0]), planes=planes, block=64, segment=300).collect()
    encode, want = library(FILES[0]), []
    for key, text, *_ in rows:
        ids = encode(text) + [1]
        want.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert named == sorted(named)


def test_empty_table(spark, docs_of, odd_rows):
    assert b.round_trip(docs_of(odd_rows).limit(0), public_tokenizers.path(FILES[0])).count() == 0
