"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule accepts and URLs that a rule rejects train one variable-order Markov model each: contexts
of 0 to ORDER characters, interpolated by Witten-Bell smoothing, so a position is predicted from the longest
context that the model knows.  All grams and contexts of all ruled URLs count, and stay tables: nothing is cut
by the size of the input, collected or broadcast by hand.

1. Each distinct URL is counted once with its rows.  Its longest grams (ORDER characters and the next) are
   counted; shorter grams are sums of longer ones, as each position has ORDER characters before it.
2. Level by level, from single characters to the longest grams, each distinct gram meets its context and the
   gram without the first character: the probabilities of both models, and at last one log ratio a gram.
3. The grams of each distinct URL that no rule decides meet the ratios in an equality join, which adaptive
   execution splits at common grams; their sum over the URL's length is the score.  Ratios are added as whole
   numbers of 1 / SCALE, so the order of the rows never shows.

The limit is the score that best separates a tenth of the ruled URLs, which the models have not seen.

Null URLs and those without `://` have empty host and path and no rule; the models judge the null URL as an
empty string.  Without accepted or without rejected URLs all scores are 0, which is accepted.  Repeated rows
count as often as they occur.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, lower_ascii, only, written

ORDER, ALPHABET, SCALE = 4, 256, 1 << 32
START, END = "\x02", "\x03"
FOLDS, HELD_OUT = 10, 0
BINS, REACH = 2_000, 10.0
Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text = verdict = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        site, slash, start = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + start)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def longest_grams(url: Column, order: int) -> Column:
    """Every character of a URL and its end, with the `order` characters before."""
    padded = F.concat(F.lit(START * order), F.coalesce(url, F.lit("")), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - order), lambda i: F.substr(padded, i, F.lit(order + 1)))


def _with_shorter(order: int) -> list[Column]:
    """(k, gram): a longest gram and what is left of it without its first characters."""
    k = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    return [k, F.substr("gram", order + 1 - F.col("k"), F.col("k") + 1).alias("gram")]


def gram_counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(verdict, k, gram, n): every character with its k characters before, for k up to order."""
    longest = urls.select("verdict", F.explode(longest_grams(F.col("url"), order)).alias("gram")).groupBy("verdict", "gram").agg(F.count(F.lit(1)).alias("n"))
    k, gram = _with_shorter(order)
    return longest.select("verdict", "n", "gram", k).select("verdict", "n", "k", gram).groupBy("verdict", "k", "gram").agg(F.sum("n").alias("n"))


def fit(urls: DataFrame, order: int = ORDER) -> dict[str, dict[str, tuple]]:
    """The models in memory, for small tables and tests; by verdict: gram -> count, and context -> (characters, distinct characters)."""
    models: dict[str, tuple[dict, dict]] = {}
    for r in gram_counts(urls, order).collect():
        grams, contexts = models.setdefault(r.verdict, ({}, {}))
        grams[r.gram] = r.n
        n, kinds = contexts.get(r.gram[:-1], (0, 0))
        contexts[r.gram[:-1]] = n + r.n, kinds + 1
    return models


def probability(model: tuple[dict, dict], context: str, char: str) -> float:
    """Witten-Bell: each longer known context takes its share from the shorter ones."""
    grams, contexts = model
    p = 1.0 / ALPHABET
    for k in range(len(context) + 1):
        before = context[len(context) - k :]
        n, kinds = contexts.get(before, (0, 0))
        if not n:
            break
        p = (grams.get(before + char, 0) + kinds * p) / (n + kinds)
    return p


def ratios(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) of every longest gram of urls (url, allow, block: rows that train a model); ratio in 1 / SCALE."""
    counted = [F.sum(v).alias(v) for v in ("allow", "block")]
    longest = urls.select("allow", "block", F.explode(longest_grams(F.col("url"), order)).alias("gram")).groupBy("gram").agg(*counted)
    k, gram = _with_shorter(order)
    grams = written(longest.select("allow", "block", "gram", k).select("allow", "block", "k", gram).groupBy("k", "gram").agg(*counted), "grams")
    total = grams.where("k = 0").agg(*counted).first()
    lower = None
    for k in range(order + 1):
        level = grams.where(F.col("k") == k).select("gram", "allow", "block", F.substr("gram", F.lit(1), F.lit(k)).alias("context"), F.substr("gram", F.lit(2)).alias("shorter"))
        contexts = level.groupBy("context").agg(*[f(v).alias(f"{v}_{c}") for v in ("allow", "block") for c, f in (("n", F.sum), ("kinds", lambda v: F.count_if(F.col(v) > 0)))])
        both = level.join(contexts, "context")
        both = both.join(lower, "shorter") if k else both.withColumns({f"{v}_p": F.lit(1.0 / ALPHABET) for v in ("allow", "block")})
        p = [  # as in probability()
            F.when(F.col(f"{v}_n") > 0, (F.col(v) + F.col(f"{v}_kinds") * F.col(f"{v}_p")) / (F.col(f"{v}_n") + F.col(f"{v}_kinds"))).otherwise(F.col(f"{v}_p")).alias(f"{v}_p")
            for v in ("allow", "block")
        ]
        lower = both.select(F.col("gram").alias("shorter"), *p)
    ratio = F.round((F.log("allow_p") - F.log("block_p")) * SCALE).cast("long") if total.allow and total.block else F.lit(0).cast("long")
    return written(lower.select(F.col("shorter").alias("gram"), ratio.alias("ratio")), "ratios")


def scored(urls: DataFrame, ratio: DataFrame, order: int = ORDER, out: str = "score") -> DataFrame:
    """urls (id, url, ...) with the score of `url`: the log-likelihood difference a character, accepted against rejected."""
    grams = urls.select("id", F.explode(longest_grams(F.col("url"), order)).alias("gram"))
    sums = grams.join(ratio, "gram").groupBy("id").agg((F.sum("ratio") / F.count(F.lit(1)) / SCALE).alias(out))
    return urls.join(sums, "id")


def calibrate(labelled: DataFrame) -> float:
    """The score that best separates held-out accepted from rejected rows (verdict, score, rows), from a histogram of BINS bins."""
    cell = F.least(F.greatest(F.floor((F.col("score") + REACH) * (BINS / (2 * REACH))), F.lit(0)), F.lit(BINS - 1))
    counts = labelled.groupBy("verdict", cell.alias("cell")).agg(F.sum("rows").alias("n")).collect()
    sizes = {v: sum(r.n for r in counts if r.verdict == v) for v in ("allow", "block")}
    if not all(sizes.values()):
        return 0.0
    below = {v: [0] * (BINS + 1) for v in sizes}
    for r in counts:
        below[r.verdict][r.cell + 1] += r.n
    best, at, so_far = -2.0, BINS // 2, {v: 0 for v in sizes}
    for k in range(BINS + 1):
        so_far = {v: so_far[v] + below[v][k] for v in sizes}
        gain = so_far["block"] / sizes["block"] - so_far["allow"] / sizes["allow"]
        if (gain, -abs(k - BINS // 2)) > (best, -abs(at - BINS // 2)):
            best, at = gain, k
    return at * 2 * REACH / BINS - REACH


def judge(pages: DataFrame, rules: Sequence[Rule], *, order: int = ORDER) -> DataFrame:
    """pages with host, path, rule, verdict and score (null where a rule decides); clashing columns give way."""
    ours = ("host", "path", "rule", "verdict", "score")
    others = [c for c in pages.columns if c.lower() not in ours]
    host, path = host_and_path(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    known = only(pages, others).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "verdict": verdict})
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    distinct = known.groupBy("url", "verdict").agg(F.count(F.lit(1)).alias("rows"))
    trains = lambda v: F.when((F.col("verdict") == v) & (fold != HELD_OUT), F.col("rows")).otherwise(F.lit(0)).alias(v)
    urls = written(distinct.select(F.monotonically_increasing_id().alias("id"), "url", "verdict", "rows", trains("allow"), trains("block")), "urls")
    asked = urls.where("verdict IS NULL OR allow + block = 0").select("id", "url", "verdict", "rows")
    found = written(scored(asked, ratios(urls, order), order), "scores")
    limit = calibrate(found.where("verdict IS NOT NULL"))
    key, out = free_name(known, "_url"), free_name(known, "_score")
    own = found.where("verdict IS NULL").select(F.col("url").alias(key), F.col("score").alias(out))
    judged = known.join(own, F.col("url").eqNullSafe(F.col(key)), "left")
    mark = F.col("rule").isNull()
    return judged.select(
        *[F.col(f"`{c}`") for c in others], "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col(out) >= limit, "allow").otherwise("block")).alias("verdict"),
        F.when(mark, F.col(out)).alias("score"),
    )
