import math
import random
import re

from pyspark.sql import functions as F

from placetime.llm import url_model as u

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SCHEMA = "page_id long, url string, host string, score string, kept string"


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    for what, rule in sorted(RULES, key=lambda r: -len(r[1])):
        site, start = rule.split("/", 1)
        if (host == site or host.endswith("." + site)) and path.startswith("/" + start):
            return rule, what
    return None, None


def pages(spark, urls):
    return spark.createDataFrame([(k, x, "clash", "clash", "clash") for k, x in enumerate(urls)], SCHEMA)


def test_parts_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Example.ORG/es/1", "https://a.example.org/en/12?x#y", "https://org/", "https://notorg/", "ftp://x.com/fr/://z",
        "http://x.com?/fr/", "http://É.COM/de/ä", "http://example.org", "http://example.org/en/2", "x://y.com#/de/", "http://a.com/de/\nb", "://com/fr/",
    ]
    got = {r.page_id: r for r in u.judge(pages(spark, urls), RULES).collect()}
    for k, url in enumerate(urls):
        host, path = plain(url)
        rule, verdict = rule_of(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), url
        assert got[k].verdict == verdict if rule else got[k].verdict in ("allow", "block")


def test_probabilities_are_smoothed_and_add_up(spark):
    df = pages(spark, ["aab", "aab", "abb", "aab"]).select("url").withColumn("verdict", F.lit("allow"))
    model = u.fit(df, 2)["allow"]
    chars = [chr(c) for c in range(u.ALPHABET)]
    for context in ("", "a", "aa", "ab", "zz"):
        total = sum(u.probability(model, context, c) for c in chars)
        assert math.isclose(total, 1, rel_tol=1e-9)
    assert u.probability(model, "aa", "b") > u.probability(model, "ab", "a") > 0


def test_counts_are_of_all_rows(spark):
    df = pages(spark, ["ab", "ab", None]).select("url").withColumn("verdict", F.lit("block"))
    got = {(r.k, r.gram): r.n for r in u.gram_counts(df, 1).collect()}
    assert got == {(0, "a"): 2, (0, "b"): 2, (0, "\x03"): 3, (1, "\x02a"): 2, (1, "ab"): 2, (1, "b\x03"): 2, (1, "\x02\x03"): 1}


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    good = ["garden", "history", "science", "library", "museum"]
    bad = ["casino", "cheap-pills", "winbig", "xxxcams", "lottery"]
    make = lambda words, tld: f"http://www.{rng.choice(words)}{rng.randint(1, 99)}.{tld}/{rng.choice(words)}/{rng.randint(1, 999)}"
    urls = [make(good, "site") for _ in range(300)] + [make(bad, "site") for _ in range(300)]
    rules = [("allow", "good.test/"), ("block", "bad.test/")]
    train = [x.replace(".site", ".good.test") for x in urls[:200]] + [x.replace(".site", ".bad.test") for x in urls[300:500]]
    test = urls[200:300] + urls[500:]
    df = pages(spark, train + [x.replace(".site", ".new.test") for x in test])
    got = [r.verdict for r in u.judge(df, rules).where("rule IS NULL").orderBy("page_id").collect()]
    right = sum(v == ("allow" if k < 100 else "block") for k, v in enumerate(got))
    assert right >= 190


def test_no_labels_and_no_rows(spark):
    assert {r.verdict for r in u.judge(pages(spark, ["http://a.net/x", None]), RULES).collect()} == {"allow"}
    assert u.judge(pages(spark, []), RULES).count() == 0


def plain_models(rows, order):
    """As u.fit, from (url, verdict) rows."""
    models = {"allow": ({}, {}), "block": ({}, {})}
    for url, verdict in rows:
        grams, contexts = models[verdict]
        text = u.START * order + url + u.END
        for i in range(order, len(text)):
            for k in range(order + 1):
                g = text[i - k : i + 1]
                n, kinds = contexts.get(g[:-1], (0, 0))
                contexts[g[:-1]] = n + 1, kinds + (g not in grams)
                grams[g] = grams.get(g, 0) + 1
    return models


def plain_score(models, url, order):
    text, total = u.START * order + url + u.END, 0.0
    for i in range(order, len(text)):
        total += math.log(u.probability(models["allow"], text[i - order : i], text[i])) - math.log(u.probability(models["block"], text[i - order : i], text[i]))
    return total / (len(text) - order)


def test_every_gram_counts_at_any_size(spark):
    """Over 100,000 characters a class, rare grams still count, once as often as they are: scores equal those of whole models."""
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(40))
    good, bad = [f"http://{name()}.good.test/{name()}" for _ in range(1500)], [f"http://{name()}.bad.test/{name()}" for _ in range(1500)]
    train = good + bad + good[:40] + ["http://zq.good.test/zqxjkv", "http://wy.bad.test/wyvbnp"]
    new = ["http://new.test/zqxjkv", "http://new.test/wyvbnp", "http://other.test/" + name(), "", "日本"]
    df = pages(spark, train + new + new[:1] + [None])
    rules = [("allow", "good.test/"), ("block", "bad.test/")]
    ruled = df.where("url LIKE '%.good.test/%' OR url LIKE '%.bad.test/%'").selectExpr("url", "IF(url LIKE '%.good.test/%', 'allow', 'block') AS verdict")
    trained = ruled.where(F.pmod(F.xxhash64("url"), F.lit(u.FOLDS)) != u.HELD_OUT)
    models = plain_models(trained.collect(), u.ORDER)
    assert u.fit(trained) == models
    assert all(sum(n for g, n in grams.items() if len(g) == 1) > 100_000 for grams, _ in models.values())
    got = [(r.url, r.score) for r in u.judge(df, rules).where("rule IS NULL").collect()]
    assert sorted(x for x, _ in got if x is not None) == sorted(new + new[:1]) and len(got) == len(new) + 2
    for url, score in got:
        assert math.isclose(score, plain_score(models, url or "", u.ORDER), abs_tol=1e-8), url
