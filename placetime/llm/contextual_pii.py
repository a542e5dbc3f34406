"""Personal data: fixed patterns, and bootstrapped contextual extraction that finds more.

Fixed patterns give the base spans of four kinds; they are the seeds.  One pass over the whole texts notes
every seed, and every candidate: a word with MIN_DIGITS digits or an `@` outside the seeds.  Each has three
lexical patterns: the two words before, the words on either side, the two words after.  The distinct
(pattern, instance) pairs are a graph, and Spark scores it in ROUNDS rounds:

* a pattern's score for a kind is the trusted share of its instances, if at least MIN_SUPPORT are trusted;
* an instance's score for a kind is 1 - product of (1 - score) over its patterns; seeds keep 1.

Candidates whose best score reaches MIN_SCORE become spans of kind `context`.  A candidate that is written
differently from a seed but has the same digits or address is the same instance.

Hot patterns and hot instances are single rows of the graph, because pairs are distinct; sums have map-side
partials.  Spans are code points, end exclusive; base spans always stay.  Null texts are empty.  Repeated
rows and doc_ids are judged row by row.  Without seeds nothing is discovered.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import python_ready, written

#: Kinds and patterns.  Possessive runs and look-behinds take what the plain patterns take, in linear time.
KINDS = ("email", "ip", "card", "phone", "context")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MIN_DIGITS, MIN_LENGTH = 4, 6
ROUNDS, MIN_SUPPORT, MIN_SHARE, MIN_SCORE = 3, 2.0, 0.5, 0.6
EDGES = "\"'()[]{}<>.,;:!?"
UNITS = "array<struct<start:long,stop:long,instance:string,kind:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    found, end = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        a = m.start()
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            found.append(("email", a, m.end()))
            end = m.end()
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return found


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def instance(text: str) -> str:
    """What a written identifier stands for: its digits, or its text in lower case."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    return f"#{digits}" if len(digits) >= 7 and not any(c.isalpha() for c in text) and text.count(".") < 3 else text.lower()


def units(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str | None, list[str]]]:
    """(start, stop, instance, kind or None, patterns) of seeds and candidates."""
    if not spans and not any(c in text for c in "0123456789@"):
        return []
    seeds = sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1]))
    items: list[tuple] = []  # (start, stop, context word, instance, kind)
    at, covered = 0, -1
    for m in re.finditer(r"\S+", text):
        a, b = m.span()
        while at < len(seeds) and seeds[at][0] < b:
            start, stop, kind = seeds[at]
            at += 1
            if start >= covered:
                items.append((start, stop, f"<{kind}>", instance(text[start:stop]), kind))
                covered = stop
        if a < covered or (items and items[-1][3] and items[-1][0] >= a):
            continue
        word = m[0].strip(EDGES)
        if len(word) >= MIN_LENGTH and (sum("0" <= c <= "9" for c in word) >= MIN_DIGITS or "@" in word):
            a += m[0].index(word)
            items.append((a, a + len(word), "<x>", instance(word), None))
        else:
            items.append((a, b, re.sub(r"[0-9]", "0", word.lower()) or m[0][:3], None, None))
    words = ["^", "^", *(x[2] for x in items), "$", "$"]
    return [
        (a, b, what, kind, [f"{words[k]} {words[k + 1]} _", f"{words[k + 1]} _ {words[k + 3]}", f"_ {words[k + 3]} {words[k + 4]}"])
        for k, (a, b, _, what, kind) in enumerate(items) if what
    ]


def noted(docs: DataFrame) -> DataFrame:
    """(part, row, doc_id, base, units) of every row of docs; base are spans `kind:start:end`."""
    python_ready(docs.sparkSession)
    unit = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("instance", pa.string()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = base_spans(text or "")
                own = [dict(zip(("start", "stop", "instance", "kind", "patterns"), u)) for u in units(text or "", base)]
                rows.append((part, row, key, [f"{k}:{a}:{b}" for k, a, b in base], own))
                row += 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(unit)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["part", "row", "doc_id", "base", "units"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"part int, row long, doc_id long, base array<string>, units {UNITS}")


def scores(notes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) of instances that are not seeds, after the last round."""
    each = notes.select(F.explode("units").alias("u")).select("u.*")
    graph = written(each.select("instance", F.explode("patterns").alias("pattern")).distinct(), "graph")
    seeds = written(each.where("kind IS NOT NULL").groupBy("instance", "kind").agg(F.lit(1.0).alias("score")), "seeds")
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    trusted = seeds
    for _ in range(rounds):
        support = graph.join(trusted, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("trust"))
        good = support.where(F.round("trust", 6) >= MIN_SUPPORT).join(sizes, "pattern").withColumn("share", F.round(F.col("trust") / (F.col("n") + 1), 6))
        good = written(good.where(F.col("share") >= MIN_SHARE).select("pattern", "kind", "share"), "patterns")
        reached = graph.join(good, "pattern").groupBy("instance", "kind").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("share")))), 6).alias("score"))
        new = written(reached.join(seeds.select("instance").distinct(), "instance", "left_anti"), "instances")
        trusted = seeds.unionByName(new)
    return trusted


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans) of every row of docs."""
    notes = written(noted(docs), "units")
    best = W.partitionBy("instance").orderBy(F.desc("score"), "kind")
    found = scores(notes).where(F.col("score") >= MIN_SCORE).withColumn("r", F.row_number().over(best)).where("r = 1").select("instance")
    open_ = notes.select("part", "row", F.explode("units").alias("u")).where("u.kind IS NULL").select("part", "row", "u.instance", "u.start", "u.stop")
    spans = open_.join(found, "instance").groupBy("part", "row").agg(F.collect_list(F.struct("start", "stop")).alias("more"))  # of one text
    joined = notes.select("part", "row", "doc_id", "base").join(spans, ["part", "row"], "left").select("doc_id", "base", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, base, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = Counter(s.split(":")[0] for s in base)
                more = [f"context:{a}:{b}" for a, b in sorted((m["start"], m["stop"]) for m in more or [])]
                digest = hashlib.sha256(",".join(base).encode()).hexdigest()
                rows.append((key, n["email"], n["ip"], n["card"], n["phone"], len(more), digest, ",".join(base + more)))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_context", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return joined.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_context long, base_sha256 string, spans string")
