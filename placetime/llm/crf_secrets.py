"""Secret scan: fixed patterns, and a linear-chain conditional random field that finds more.

Patterns (BASE) give the base spans.  The field tags the tokens of a text as begin, inside or outside of a
secret.  Features: shape of the token (length, kinds of characters, digit share, entropy, known words),
shapes of its neighbours, and of the file (shares of tokens with digits, of signs, of assignments).

Training: every secret in a base span offers the window of tokens around it; they are ranked by a hash of the window.
Texts are ranked by a hash too, and offer one window without a secret, if they have one.  The first TRAIN_WINDOWS
windows and texts over the whole corpus fit the weights (numpy, forward-backward, Adam).  A task keeps only so
many itself.  That bound on labelled rows is the only sample.  Spans of the field are whole texts' spans by exact
Viterbi: a token whose score for outside leads by more than any transition can win back is outside on the
best path, so only the stretches between such tokens need the dynamic program.

Spans are code points, end exclusive.  Spans of the field with fewer than MIN_SECRET characters or touching a
base span are left out; base spans always stay.  Null texts are empty.  Repeated rows are judged alike.  A
corpus without base spans trains nothing and gets base results only.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import python_ready, written

#: Kinds, patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is the run that [0-9a-f]+ takes
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[\w+/-]+|[^\w\s]+")
KNOWN = {"password", "passwd", "secret", "token", "apikey", "api_key", "key", "pwd", "pass", "auth", "bearer", "credential", "credentials", "access_key", "private_key"}
LENGTHS = (1, 2, 4, 7, 11, 15, 19, 31)
B, I, O = 0, 1, 2
TRAIN_WINDOWS, HALF_WINDOW, MIN_SECRET = 600, 40, 8
EPOCHS, RATE, DECAY = 150, 0.1, 1e-3
CACHED_TOKENS = 400_000
OFFSETS = (-2, -1, 0, 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_parts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The secret itself in each base span: of an assignment, its value."""
    return [(ASSIGN.match(text, a).start(2), b) if kind == "assign" else (a, b) for kind, a, b in spans]


def shape(token: str) -> tuple:
    """What the field sees of a token; plain words have few shapes."""
    length = sum(len(token) > x for x in LENGTHS)
    low = token.lower()
    if low in KNOWN:
        return ("known", low)
    if token.isalpha() and (token[1:].islower() or token.isupper()):
        return ("word", length, token.isupper(), token[0].isupper())
    first = token[0]
    if not (first.isalnum() or first in "_+/-"):
        return ("sign", "=" in token, ":" in token, '"' in token or "'" in token, len(token) > 2)
    digits = sum(c.isdigit() for c in token)
    uppers = sum(c.isupper() for c in token)
    counts = Counter(token)
    entropy = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())
    return (
        "mixed", length, min(4, 5 * digits // len(token)), digits == len(token), uppers > 0, uppers + digits == len(token),
        all(c in "0123456789abcdef" for c in token), int(entropy), any(c in "+/-_" for c in token), not token.isascii(), token.startswith("AKIA"),
    )


def indicator(s: tuple) -> np.ndarray:
    """A shape as 0/1 features, by a fixed layout."""
    x = np.zeros(SELF, np.float32)
    kind, *v = s
    if kind == "known":
        x[0] = 1
        x[1 + sorted(KNOWN).index(v[0])] = 1
    elif kind == "word":
        x[[16, 17 + v[0]]] = 1
        x[26] += v[1]
        x[27] += v[2]
    elif kind == "sign":
        x[28] = 1
        x[29:33] += np.array(v, np.float32)
    else:
        length, share, all_digits, upper, no_lower, hexed, entropy, marks, foreign, access = v
        x[[33, 34 + length, 43 + share, 48 + min(entropy, 5)]] = 1
        x[54:61] += np.array([all_digits, upper, no_lower, hexed, marks, foreign, access], np.float32)
        x[61 + length] += share > 0 and not all_digits  # letters and digits, by length
    return x


SELF = 70
FILE = 7


def file_features(shapes: list[tuple]) -> np.ndarray:
    n = max(1, len(shapes))
    kinds = Counter(s[0] for s in shapes)
    assigns = sum(n_ for s, n_ in Counter(shapes).items() if s[0] == "sign" and (s[1] or s[2]))
    x = np.zeros(FILE, np.float32)
    x[0] = 1
    x[1 + min(2, int(20 * kinds["mixed"] / n))] = 1
    x[4] = kinds["sign"] / n
    x[5] = min(1.0, 10 * assigns / n)
    x[6] = kinds["known"] > 0
    return x


def _features(shapes: list[tuple], whole: np.ndarray, known: dict[tuple, np.ndarray]) -> np.ndarray:
    own = np.stack([known.setdefault(s, indicator(s)) for s in shapes])
    padded = np.concatenate([np.zeros((2, SELF), np.float32), own, np.zeros((1, SELF), np.float32)])
    n = len(shapes)
    return np.concatenate([*(padded[2 + k : 2 + k + n] for k in OFFSETS), np.tile(whole, (n, 1))], axis=1)


def train(windows: list[tuple[list[tuple], list[int], np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 3) and transitions (3, 3) of the field from (shapes, tags, file features)."""
    known: dict[tuple, np.ndarray] = {}
    length = max(len(w[0]) for w in windows)
    x = np.zeros((len(windows), length, SELF * len(OFFSETS) + FILE), np.float32)
    tags, mask = np.full((len(windows), length), O), np.zeros((len(windows), length), bool)
    for k, (shapes, own, whole) in enumerate(windows):
        x[k, : len(shapes)], tags[k, : len(shapes)], mask[k, : len(shapes)] = _features(shapes, whole, known), own, True
    flat, gold = x.reshape(-1, x.shape[2]), np.eye(3, dtype=np.float32)[tags] * mask[..., None]
    steps = (mask[:, :-1] & mask[:, 1:]).astype(np.float32)
    gold_moves = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], steps)
    weights, moves = np.zeros((x.shape[2], 3), np.float32), np.zeros((3, 3), np.float32)
    first, second = [0, 0], [0, 0]
    for epoch in range(1, epochs + 1):
        score = (flat @ weights).reshape(*mask.shape, 3).astype(np.float64)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, length):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves[None], axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        for t in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(moves[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(mask[:, t + 1, None], step, 0)
        chance = np.exp(np.minimum(ahead + back - total[:, None, None], 0)) * mask[..., None]
        pair = ahead[:, :-1, :, None] + moves[None, None] + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0)) * steps[..., None, None]
        n = mask.sum()
        grads = [flat.T @ (chance - gold).reshape(-1, 3).astype(np.float32) / n + DECAY * weights / 100, ((pair.sum((0, 1)) - gold_moves) / n).astype(np.float32) + DECAY * moves / 100]
        for k, (value, grad) in enumerate(zip((weights, moves), grads)):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            value -= RATE * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
    return weights, moves


def viterbi(score: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a sequence."""
    best, came = [score[0].tolist()], []
    m = moves.tolist()
    for row in score[1:].tolist():
        last = best[-1]
        from_ = [max(range(3), key=lambda a, b=b: last[a] + m[a][b]) for b in range(3)]
        best.append([last[from_[b]] + m[from_[b]][b] + row[b] for b in range(3)])
        came.append(from_)
    tags = [max(range(3), key=best[-1].__getitem__)]
    for from_ in reversed(came):
        tags.append(from_[tags[-1]])
    return tags[::-1]


class Tagger:
    """Tags of whole texts; shapes of tokens are kept between texts."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights.astype(np.float64), moves.astype(np.float64)
        self.number: dict[tuple, int] = {}
        self.shapes: list[tuple] = []
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, len(OFFSETS), 3))
        self.tokens: dict[str, int] = {}
        m = self.moves
        # the most that begin or inside can win back around one token against outside, at the ends of a text as well
        self.lead = max(max(0.0, *(m[p, y] - m[p, O] for p in range(3))) + max(0.0, *(m[y, q] - m[O, q] for q in range(3))) for y in (B, I))

    def _number(self, token: str) -> int:
        s = shape(token)
        if s not in self.number:
            self.number[s] = len(self.shapes)
            self.shapes.append(s)
            x = indicator(s)
            self.rows.append(np.stack([x @ self.weights[k * SELF : (k + 1) * SELF] for k in range(len(OFFSETS))]))
        k = self.number[s]
        if len(self.tokens) < CACHED_TOKENS:
            self.tokens[token] = k
        return k

    def scores(self, tokens: list[str]) -> np.ndarray:
        known = self.tokens
        for t in set(tokens).difference(known):
            self._number(t)
        try:
            ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:  # more tokens than the cache holds
            ids = np.array([known[t] if t in known else self._number(t) for t in tokens])
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows)
        table = self.table
        score = table[ids, 2]
        score[2:] += table[ids[:-2], 0]
        score[1:] += table[ids[:-1], 1]
        score[:-1] += table[ids[1:], 3]
        counts = np.bincount(ids, minlength=len(self.shapes))
        return score + _file_from_counts(self.shapes, counts) @ self.weights[len(OFFSETS) * SELF :]

    def tags(self, tokens: list[str]) -> dict[int, int]:
        """Tokens that are begin or inside."""
        score = self.scores(tokens)
        open_ = np.flatnonzero(score[:, O] - score[:, :O].max(axis=1) <= self.lead)
        found: dict[int, int] = {}
        if not len(open_):
            return found
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            part = score[run].copy()
            if run[0] > 0:
                part[0] += self.moves[O]
            if run[-1] < len(tokens) - 1:
                part[-1] += self.moves[:, O]
            found.update((int(t), tag) for t, tag in zip(run, viterbi(part, self.moves)) if tag != O)
        return found

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        tokens = TOKEN.findall(text)
        tags = self.tags(tokens) if tokens else {}
        if not tags:
            return []
        found: list[tuple[str, int, int]] = []
        last = -2
        for k, m in enumerate(TOKEN.finditer(text)):
            if k in tags:
                if tags[k] == I and last == k - 1:
                    found[-1] = ("crf", found[-1][1], m.end())
                else:
                    found.append(("crf", m.start(), m.end()))
                last = k
        return [s for s in found if s[2] - s[1] >= MIN_SECRET]


def _file_from_counts(shapes: list[tuple], counts: np.ndarray) -> np.ndarray:
    """file_features from how often each shape occurs."""
    n, kinds, assigns = max(1, int(counts.sum())), Counter(), 0
    for k in np.flatnonzero(counts):
        s, c = shapes[k], int(counts[k])
        kinds[s[0]] += c
        assigns += c if s[0] == "sign" and (s[1] or s[2]) else 0
    x = np.zeros(FILE)
    x[0] = 1
    x[1 + min(2, int(20 * kinds["mixed"] / n))] = 1
    x[4], x[5], x[6] = kinds["sign"] / n, min(1.0, 10 * assigns / n), kinds["known"] > 0
    return x


def tagged_text(text: str) -> tuple[list[tuple[str, int, int]], list[int], list[float]]:
    """Tokens with their spans, tags by the base spans, and file features of a text."""
    parts = secret_parts(text, base_spans(text))
    found = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)]
    tags: list[int] = []
    for _, a, b in found:
        inside = next((p for p in parts if p[0] <= a and b <= p[1]), None)
        tags.append(O if inside is None else B if a == inside[0] or not tags or tags[-1] == O else I)
    return found, tags, file_features([shape(t) for t, _, _ in found]).tolist()


def windows(text: str, secret: bool) -> list[tuple[list[str], list[int], list[float]]]:
    """(tokens, tags, file features) around every secret, or around one token far from all of them, by a hash of the
    text: of those that are no plain words, as these teach most, if there are any."""
    found, tags, whole = tagged_text(text)
    centres = [k for k, tag in enumerate(tags) if tag == B]
    if not secret:
        near = {k for c in centres for k in range(c - HALF_WINDOW, c + HALF_WINDOW + 1)}
        far = [k for k in range(len(found)) if k not in near]
        some = [k for k in far if shape(found[k][0])[0] == "mixed"] or far
        centres = [some[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(some)]] if some else []
    cut = lambda values, c: values[max(0, c - HALF_WINDOW) : c + HALF_WINDOW]
    return [([t for t, _, _ in cut(found, c)], cut(tags, c), whole) for c in centres]


def labelled(text: str) -> list[tuple[bool, list[str], list[int], list[float]]]:
    """The windows that a text offers: (holds a secret, tokens, tags, file features)."""
    return [(secret, *w) for secret in (True, False) for w in windows(text, secret)]


class Smallest:
    """The entries with the smallest keys, each once; at most twice `most` are held."""

    def __init__(self, most: int):
        self.most, self.found, self.bound = most, {}, None

    def add(self, key: tuple, entry) -> None:
        if self.bound is None or key < self.bound:
            self.found[key] = entry
            if len(self.found) >= 2 * self.most:
                self.found = dict(self.entries())
                self.bound = max(self.found)

    def entries(self) -> list[tuple]:
        return sorted(self.found.items(), key=lambda x: x[0])[: self.most]


def training_rows(docs: DataFrame, most: int = TRAIN_WINDOWS) -> list:
    """The first `most` windows with a secret, and the windows without one of the first `most` texts, by their hashes."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret, texts = Smallest(most), Smallest(most)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                if base_spans(text):
                    for entry in windows(text, True):
                        key = zlib.crc32("\0".join(entry[0]).encode("utf-8", "surrogatepass"))
                        secret.add((key, tuple(entry[0])), entry)
                texts.add((zlib.crc32(text.encode("utf-8", "surrogatepass")), text), text)
        rows = [(True, key, *entry) for (key, _), entry in secret.entries()]
        for (key, _), text in texts.entries():
            rows.append((False, key, *(windows(text, False) or [([], [], [])])[0]))
        types = [pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["secret", "key", "tokens", "tags", "whole"])

    rows = written(docs.select("text").mapInArrow(run, "secret boolean, key long, tokens array<string>, tags array<long>, whole array<double>"), "secret-windows").distinct()
    order = ("key", "tokens")
    first = [*rows.where("secret").orderBy(*order).limit(most).collect(), *rows.where("NOT secret").orderBy(*order).limit(most).collect()]
    return sorted(r for r in first if r.tokens)


def fit(rows: list, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights of the field, or None without secrets to learn from."""
    if not any(r.secret for r in rows):
        return None
    return train([([shape(t) for t in r.tokens], list(r.tags), np.array(r.whole, np.float32)) for r in rows], epochs)


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans) of every row of docs."""
    python_ready(docs.sparkSession)
    model = fit(training_rows(docs)) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*model) if model else None
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = base_spans(text or "")
                more = tagger.spans(text) if tagger and text else []
                more = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
                n = Counter(s[0] for s in base)
                rows.append((key, n["assign"], n["access"], n["hex"], len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(ordered(base + more))))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")
