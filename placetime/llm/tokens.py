"""Token ids by the tokenizers library, with a cache of words.

Long invented or rare vocabularies make byte-pair merges the dearest step of a job.  Words between single
blanks never share a token (both kinds of vocabulary split there), so each distinct word is merged once a
worker process and looked up afterwards; a text in which the blanks are not that plain is encoded whole.
The ids equal those of one call on the whole text.
"""

from __future__ import annotations

import codecs
import gc
import os
import unicodedata
from collections.abc import Sequence
from functools import cache
from itertools import chain

import numpy as np

#: Words that a worker process keeps of those that came again, and of those that came once; the longest of them.
CACHED_WORDS, CACHED_LENGTH = 250_000, 64
#: Signs that are a token search's own piece after letters; the most ends of words that are kept, and the longest.
_SIGNS, _ENDS, _END_LENGTH = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 10_000, 8
_ODD_BLANKS = "\x1c\x1d\x1e\x1f"
#: Letters below this, but for one whose lower case is two characters, are letters to every library.
_LATIN_END, _TWO_LOWER = "ɐ", "İ"
_LATIN = frozenset(map(chr, range(ord(_LATIN_END)))) - {_TWO_LOWER}


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies use for each byte: printable bytes stand for themselves,
    the others for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one process a core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lead = "" if not self._call([" "])[0] else " "  # is the blank before a word part of its token?
        self.feed = self._call(["\n"])[0]
        self.ends: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # words that came again
        self.fresh: dict[str, bytes] = {}  # words that came in one group so far
        self.latest: dict[str, bytes] = {}  # words of the current group that were not among the words that came again
        self.learned = 0  # words learned since room was made
        self.letters = "".join(_byte_letters()[b] for b in range(256))
        self.mark = self._spelled(self.lead)
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        # words of letters go straight to the merges if that gives the same ids
        probe = ["river", "Élan", "straße", "QUEUE", "a"]
        self.direct = [self._merge(self.lead + w) for w in probe] == self._call([self.lead + w for w in probe])

    def _call(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _spelled(self, word: str) -> str:
        """The visible letters of the bytes of a word."""
        return codecs.charmap_decode(word.encode("utf-8"), "strict", self.letters)[0]

    def _merge(self, word: str) -> bytes:
        """Ids of one word of letters, without the search for words in a text."""
        if not self.lead:
            word = unicodedata.normalize("NFC", word.lower())
        return b"".join([self.packed[t.id] for t in self.library.model.tokenize(self._spelled(word))])

    def _end(self, signs: str) -> bytes:
        """Ids of the signs that end a word."""
        if signs not in self.ends:
            if len(self.ends) >= _ENDS:
                self.ends = {}
            self.ends[signs] = self._call([signs])[0]
        return self.ends[signs]

    def _learn(self, new: set[str]) -> None:
        """Adds new words to the latest; one that only ends in signs is its core and the signs.

        Where blanks belong to tokens, a word after a line feed has none: its ids are those of the line feed and the bare word.
        What is no single word there is left out.
        """
        known, lead, packed, merge, rest, others = self.latest, self.lead, self.packed, self.library.model.tokenize, new, []
        self.learned += len(new)
        if self.direct:
            # plain letters stand for themselves in a byte-level vocabulary
            plain = [w for w in new if w.isascii() and w.isalpha()]
            for w in plain:
                known[w] = b"".join([packed[t.id] for t in merge(self.mark + w if lead else w.lower())])
            rest = new.difference(plain)
        for w in rest:
            bare, before, start = (w[1:], self.feed, "") if lead and w[:1] == "\n" else (w, b"", lead)
            core = bare.rstrip(_SIGNS)
            signs = bare[len(core) :]
            if self.direct and core.isalpha() and len(signs) <= _END_LENGTH and (core.isascii() or _LATIN.issuperset(core)):
                own = None if before else self.words.get(core) or self.fresh.get(core)
                known[w] = before + (own or self._merge(start + core)) + (self._end(signs) if signs else b"")
            elif not lead or bare.split() == [bare]:
                others.append((w, before, start + bare))
        for i in range(0, len(others), 10_000):
            part = others[i : i + 10_000]
            for (w, before, _), own in zip(part, self._call([x[2] for x in part]), strict=True):
                known[w] = before + own

    def _words(self, text: str) -> list[str] | None:
        """Words, with the line feed before them where blanks belong to tokens; or None where the text must be encoded whole."""
        if not self.lead:
            return None if any(c in text for c in _ODD_BLANKS) else text.split()
        return ("\n" + text.replace("\n", " \n")).split(" ")

    def _make_room(self) -> None:
        """Words that came once go first, as most rare words never come again; of too many others those that come once more stay."""
        if self.learned > CACHED_WORDS:
            self.forget_fresh()
        if len(self.words) > CACHED_WORDS:
            self.fresh, self.words, self.learned = self.words, {}, 0

    def forget_fresh(self) -> None:
        """A worker process that waits for its next task, maybe of another job, keeps only words that came again."""
        self.fresh, self.learned = {}, 0

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is the empty text."""
        collects = gc.isenabled()
        gc.disable()  # lists of words hold no cycles, and looking for some in them takes a tenth of the time
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _fill(self, flat: list[str], found: list[bytes | None], gaps: list[int]) -> None:
        """Ids of the words at the gaps, which have not come again before; None stays where a word is left out."""
        words, fresh = self.words, self.fresh
        got = self.latest = {}
        new = {flat[i] for i in gaps}
        again = [w for w in new if w in fresh]
        for w in again:
            got[w] = words[w] = fresh.pop(w)
        new.difference_update(again)
        if new:
            self._learn(new)
        for i in gaps:
            found[i] = got.get(flat[i])
        fresh.update((w, got[w]) for w in new if len(w) <= CACHED_LENGTH and w in got)
        self.latest = {}

    def _encode(self, texts: Sequence[str | None]) -> list[bytes]:
        split = [self._words(t) if t else [] for t in texts]
        self._make_room()
        flat = list(chain.from_iterable(words for words in split if words))
        ids = list(map(self.words.get, flat))
        if gaps := [i for i, own in enumerate(ids) if own is None]:
            self._fill(flat, ids, gaps)
        found, whole, at = [], [], 0
        skip = len(self.feed) if self.lead else 0  # the line feed before the first word
        for words in split:
            own = [None] if words is None else ids[at : at + len(words)]
            at += len(words or ())
            if None in own:  # a word that was left out
                whole.append(len(found))
                found.append(b"")
            else:
                found.append(b"".join(own)[skip if words else 0 :])
        for k, own in zip(whole, self._call([texts[k] for k in whole]), strict=True):
            found[k] = own
        return found


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)


def in_groups(texts: Sequence[str | None], most_chars: int = 500_000) -> list[tuple[int, int]]:
    """Ranges of texts of about `most_chars` characters, one text at least."""
    groups, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most_chars:
            groups.append((start, i + 1))
            start, held = i + 1, 0
    return groups + ([(start, len(texts))] if start < len(texts) else [])
