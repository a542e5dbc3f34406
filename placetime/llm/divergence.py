"""Quality rules by distribution divergence.

Two histograms of a document are compared with those of its language by the Jensen-Shannon distance
(base 2, square root, 0 to 1): character classes, and the language's most frequent words with one bin for
all other words.  Two passes: the first adds up the reference histograms of every language over all texts
that pass the base rules, the second judges every text.  The references are at most LANGUAGES rows of
TOP_WORDS words, so they are small whatever the size of the corpus.

Guards: a text with fewer than `min_chars` characters or `min_words` words is not judged by the matching
histogram.  Limits widen for short texts, because a small sample of the same distribution lies further away.
A language with fewer than `min_reference` words in the corpus has no reference of its own: its texts are compared
with that of all languages, by classes that do not tell a script (letters, marks and blanks; symbols; digits; stops and
other signs), and not by words.

Null or empty texts have no words and fail the base rule.  A null or odd language counts as `und`.  Repeated
rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from .common import BLANKS, free_name, python_ready

SYMBOLS = "#*$%&|<>"
CLASSES = ["blank", "symbol", "lower", "upper", "digit", "stop", "other_lower", "other_upper", "other_letter", "mark", "other"]
STOPS = ".,;:!?'\"()-"
#: Codes of two or three letters: the number of languages, and so of reference rows, has this bound.
LANGUAGES = 26**2 + 26**3
TOP_WORDS = 64
MIN_WORDS, MIN_CHARS, MIN_REFERENCE = 30, 180, 5_000
#: The distance of a fair sample falls with the root of its size, so a limit is `base + noise / sqrt(size)`.
CHAR_LIMIT, WORD_LIMIT = (0.2, 2.0), (0.25, 1.5)
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def language(lang):
    """Primary code of a language tag, `und` for anything else."""
    code = F.regexp_extract(F.lower(F.coalesce(lang, F.lit(""))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code == "", "und").otherwise(code)


@cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    of = {"Ll": 6, "Lu": 7, "Lt": 7, "Lm": 8, "Lo": 8, "Mn": 9, "Mc": 9, "Me": 9, "Nd": 4}
    table = np.array([of.get(unicodedata.category(chr(c)), 10) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    for chars, k in ((BLANKS, 0), (SYMBOLS, 1), (STOPS, 5)):
        for c in chars:
            table[ord(c)] = k
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1] = 2, 3
    return table


def class_counts(text: str) -> np.ndarray:
    return np.bincount(class_table()[np.frombuffer(text.encode("utf-32-le"), "<u4")], minlength=len(CLASSES))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of `size` words that occur twice or more in the text."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    window = word
    for k in range(1, size):  # numbered anew after each step, so products stay exact
        window = window[: n - k] * len(ids) + word[k:]
        if k + 1 < size:
            window = np.unique(window, return_inverse=True)[1] if int(window.max()) >= 2**62 // max(len(ids), 1) else window
    order = np.sort(window)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, which, counts = np.unique(window, return_inverse=True, return_counts=True)
    again, inside = counts[which] > 1, np.zeros(n, bool)
    for k in range(size):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def base_stats(text: str | None) -> tuple[list[int], list[bytes], np.ndarray]:
    """STATS, the words and the character classes of a whole text."""
    text = text or ""
    words, classes = text.encode("utf-8").split(), class_counts(text)
    return [len(words), len(text) - int(classes[0]), int(classes[1]), repeated_lines(text), repeated_words(words)], words, classes


def base_failed(stats: list[int]) -> bool:
    return stats[0] < 10 or 100 * stats[4] > 20 * stats[0]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of counts."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(parts, 0.0) / 2))


def far(distance: float | None, size: int, limit: tuple[float, float]) -> bool:
    return distance is not None and distance > limit[0] + limit[1] / size**0.5


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    classes: dict[str, np.ndarray] = {}

    def passed() -> pa.RecordBatch:
        rows = [(lang, "w", w.decode("utf-8"), n) for (lang, w), n in words.items()]
        rows += [(lang, "c", str(k), int(n)) for lang, x in classes.items() for k, n in enumerate(x) if n]
        words.clear(), classes.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string()] * 3 + [pa.int64()])], names=["lang", "kind", "item", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            stats, own, counts = base_stats(text)
            if base_failed(stats):
                continue
            for w, n in Counter(own).items():
                words[lang, w] += n
            classes[lang] = classes.get(lang, 0) + counts
            if len(words) >= HELD_WORDS:
                yield passed()
    if words or classes:
        yield passed()


def references(docs: DataFrame, top_words: int = TOP_WORDS) -> DataFrame:
    """Reference histograms: (lang, kind c or w, item, n, total) with `top_words` words a language, over all texts."""
    python_ready(docs.sparkSession)
    counts = (
        docs.select(language(F.col("lang")).alias("lang"), "text")
        .mapInArrow(_partial_counts, "lang string, kind string, item string, n long")
        .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    first = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max(top_words, len(CLASSES)))
    return top.where((F.col("kind") == "c") | (F.col("rank") <= top_words)).join(totals, ["lang", "kind"])


def _histograms(rows) -> dict[str, tuple]:
    """Per language: class counts, word -> bin, bin counts (the last one: all other words), words in the reference."""
    found: dict[str, tuple] = {}
    for lang in sorted({r.lang for r in rows}):
        classes = np.zeros(len(CLASSES))
        for r in rows:
            if r.lang == lang and r.kind == "c":
                classes[int(r.item)] = r.n
        top = sorted((r for r in rows if r.lang == lang and r.kind == "w"), key=lambda r: (-r.n, r.item))
        total = top[0].total if top else 0
        bins = np.array([r.n for r in top] + [total - sum(r.n for r in top)], float)
        found[lang] = classes, {r.item.encode("utf-8"): k for k, r in enumerate(top)}, bins, total
    return found


def scriptless(classes: np.ndarray) -> np.ndarray:
    """Counts that do not tell a script: letters, marks and blanks as one class, stops and other signs as one."""
    of = {c: float(n) for c, n in zip(CLASSES, classes, strict=True)}
    apart = [of["symbol"], of["digit"], of["stop"] + of["other"]]
    return np.array([sum(of.values()) - sum(apart), *apart])


def judge(
    docs: DataFrame, refs: DataFrame | None = None, *, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS,
    min_reference: int = MIN_REFERENCE, char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT,
) -> DataFrame:
    """All columns of docs, and OUT (clashing input columns give way to them)."""
    python_ready(docs.sparkSession)
    known = _histograms((references(docs) if refs is None else refs).collect())
    pooled = scriptless(sum((r[0] for r in known.values()), np.zeros(len(CLASSES))))
    names = [x.split()[0] for x in OUT.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in names]
    code = free_name(docs, "_language")
    fields = docs.select(*[F.col(f"`{c}`") for c in kept]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(code).to_pylist(), batch.column("text").to_pylist(), strict=True):
                stats, words, classes = base_stats(text)
                failed, chars, common = base_failed(stats), None, None
                if lang in known and known[lang][3] >= min_reference:
                    ref, bin_of, bins, _ = known[lang]
                    if text and len(text) >= min_chars:
                        chars = js_distance(classes, ref)
                    if stats[0] >= min_words:
                        own = np.bincount([bin_of.get(w, len(bin_of)) for w in words], minlength=len(bins))
                        common = js_distance(own, bins)
                elif pooled.sum() and text and len(text) >= min_chars:
                    chars = js_distance(scriptless(classes), pooled)
                good = not failed and not far(chars, len(text or ""), char_limit) and not far(common, stats[0], word_limit)
                rows.append((*stats, failed, chars, common, good))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=kept + names)

    schema = StructType(fields.fields + StructType.fromDDL(OUT).fields)
    return docs.select(*[F.col(f"`{c}`") for c in kept], language(F.col("lang")).alias(code)).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    aside = docs
    for k, c in enumerate(docs.columns):
        if c not in ("text", "lang"):
            aside = aside.withColumnRenamed(c, f"_own{k}")
    back = [F.col(c if c in ("text", "lang") else f"_own{k}").alias(c) for k, c in enumerate(docs.columns)]
    return judge(aside, **settings).where("kept").select(*back)
