"""Cross-street index, corner search and stop search over many queries at once.

Queries and entries are reduced to distinct token sets first.  A subset match is looked up on
the query's two rarest tokens; queries of one token or one prefix take answers that are settled
once for each token or prefix, so a word shared by most entries joins nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.geo import equirect_m, to_e5
from ..functions.ranks import global_rank, materialize, number_within
from ..functions.text import name_tokens, parse_stop_code, street_tokens, token_key
from .rollup import ranked
from .spatial import assign_polygon, near_pairs


def corner_index(pairs: DataFrame, order: str) -> DataFrame:
    """One row per unordered pair of distinct streets, the first seen in `order`.

    pairs: street_1, street_2, lat, lng (text).  Rows that lack a street, name one street
    twice, or have no usable coordinate are left out.
    """
    rows = usable_pairs(pairs)
    key = F.array_join(F.array_sort(F.array("k1", "k2")), " x ").alias("pair_key")
    best = F.min(F.struct(order, "street_1", "street_2", "lat_e5", "lng_e5"))
    return rows.select("*", key).groupBy("pair_key").agg(best.alias("b")).select(
        "pair_key", "b.*"
    )


def usable_pairs(pairs: DataFrame) -> DataFrame:
    one, two = (F.trim(F.coalesce(c, F.lit(""))) for c in ("street_1", "street_2"))
    return pairs.withColumns({
        "street_1": one, "street_2": two,
        "k1": token_key(street_tokens(F.col("street_1"))),
        "k2": token_key(street_tokens(F.col("street_2"))),
        "lat_e5": to_e5(F.col("lat").try_cast("double")),
        "lng_e5": to_e5(F.col("lng").try_cast("double")),
    }).where("k1 <> '' and k2 <> '' and k1 <> k2 and lat_e5 is not null and lng_e5 is not null")


def street_dictionary(index: DataFrame) -> DataFrame:
    """(street, code): each display name once, coded by sorted position."""
    names = index.select(F.explode(F.array("street_1", "street_2")).alias("street")).distinct()
    return global_rank(names, [F.col("street")], "code")


def local_index(entries: DataFrame, order: str, min_tokens: int = 2) -> DataFrame:
    """Reported places by token key: first name and position seen, and how many rows.
    entries: name, lat_e5, lng_e5 and the unique `order` column."""
    # each distinct place is tokenised once, however many rows report it
    seen = entries.where("name is not null and name <> ''").groupBy("name", "lat_e5", "lng_e5").agg(
        F.count(F.lit(1)).alias("c"), F.min(order).alias(order)
    )
    rows = seen.withColumn("tokens", street_tokens(F.col("name"))).where(F.size("tokens") >= min_tokens)
    keyed = rows.withColumn("key", token_key(F.col("tokens")))
    first = F.min(F.struct(order, "name", "lat_e5", "lng_e5"))
    return keyed.groupBy("key").agg(F.sum("c").alias("count"), first.alias("f")).select(
        "key", F.col(f"f.{order}").alias("pos"), "f.name", "f.lat_e5", "f.lng_e5", "count",
        F.split("key", " ").alias("tokens"), F.lit(False).alias("is_hotspot"),
    )


def hotspot_first_index(hotspots: DataFrame, reported: DataFrame) -> DataFrame:
    """Classified cells' names first, then reported corners they do not cover.  Both need key,
    pos, name, lat_e5, lng_e5, tokens, is_hotspot."""
    cols = ["key", "pos", "name", "lat_e5", "lng_e5", "tokens", "is_hotspot"]
    rest = reported.join(hotspots.select("key"), "key", "left_anti")
    return hotspots.select(*cols).unionByName(rest.select(*cols))


def match_corner(queries: DataFrame, index: DataFrame, hotspot_aware: bool = False) -> DataFrame:
    """Best entry per query token set: equal sets beat subsets, hotspots beat plain corners
    when asked, then the earliest entry.  queries: qkey, tokens (distinct per qkey)."""
    q = queries.select("qkey", "tokens").distinct()
    posts = index.select("key", "pos", "name", "lat_e5", "lng_e5", "is_hotspot",
                         F.col("tokens").alias("e_tokens"))
    same, hot = F.col("key") == F.col("qkey"), F.col("is_hotspot")
    if hotspot_aware:
        score = F.when(same & hot, 4).when(same, 3).when(hot, 2).otherwise(1)
    else:
        score = F.when(same, 2).otherwise(1)
    best = F.min(F.struct((-score).alias("s"), "pos", "key", "name", "lat_e5", "lng_e5", "is_hotspot")).alias("b")
    # one token: its best entry is settled once for all queries, however many entries hold it
    asked = q.where(F.size("tokens") == 1).select("qkey").distinct()
    single = posts.select("*", F.explode("e_tokens").alias("qkey")).groupBy("qkey").agg(best).join(asked, "qkey")
    # more tokens: entries meet queries on the two rarest of them
    freq = posts.select(F.explode("e_tokens").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    many = q.where(F.size("tokens") > 1)
    terms = many.select("qkey", F.explode("tokens").alias("tok"))
    # an unknown token means no entry holds the whole set
    rare = terms.join(freq, "tok", "left").groupBy("qkey").agg(
        F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("r"), F.count_if(F.col("df").isNull()).alias("unknown")
    ).where("unknown = 0")     # the tokens of one query
    two = rare.select("qkey", F.array_sort(F.transform(F.slice("r", 1, 2), lambda x: x["tok"])).alias("two"))
    sorted_ = F.array_sort(F.array_distinct("e_tokens"))
    pairs = F.flatten(F.transform(sorted_, lambda x: F.transform(F.filter(sorted_, lambda y: y > x), lambda y: F.array(x, y))))
    candidates = posts.withColumn("two", F.explode(pairs)).join(two.join(many, "qkey"), "two")
    hits = candidates.where(F.size(F.array_except("tokens", "e_tokens")) == 0)
    return single.unionByName(hits.groupBy("qkey").agg(best)).select(
        "qkey", (-F.col("b.s")).alias("score"), "b.key", "b.name", "b.lat_e5", "b.lng_e5", "b.is_hotspot"
    )


def tokenized_queries(queries: DataFrame, text: str) -> DataFrame:
    return queries.withColumn("tokens", street_tokens(F.col(text))).withColumn(
        "qkey", token_key(F.col("tokens"))
    )


def resolve_corners(
    queries: DataFrame,
    text: str,
    local: DataFrame,
    city: DataFrame,
    rings: DataFrame | None = None,
    district: str | None = None,
    hotspot_aware: bool = False,
) -> DataFrame:
    """status per query: need-two, local, city, out-of-district or none; city matches say
    whether local activity lies within 80 m and which corner is nearest."""
    # both indexes are used several times: write them once
    local, city = materialize(local, "local-index"), materialize(city, "city-index")
    q = tokenized_queries(queries, text)
    sets = q.where(F.size("tokens") >= 2).select("qkey", "tokens").distinct()
    first = match_corner(sets, local, hotspot_aware).withColumn("status", F.lit("local"))
    rest = sets.join(first.select("qkey"), "qkey", "left_anti")
    second = match_corner(rest, city).withColumn("status", F.lit("city"))
    if rings is not None and district is not None:
        second = assign_polygon(second, rings, holes=True).withColumn(
            "status", F.when(F.col("district") == district, "city").otherwise("out-of-district")
        ).drop("district")
    spots = second.where("status = 'city'").select("lat_e5", "lng_e5").distinct()
    around = local.groupBy(F.col("lat_e5").alias("t_lat"), F.col("lng_e5").alias("t_lng")).agg(
        F.min(F.struct("pos", "name")).alias("e")
    )
    # the pair search uses its own distance, so it reaches a little further than the test
    pairs = near_pairs(spots, around, fixed.NEARBY_M * 1.05, fixed.NEARBY_M * 1.05, measured=False)
    metres = equirect_m(F.col("lat_e5"), F.col("lng_e5"), F.col("t_lat"), F.col("t_lng"))
    near = pairs.withColumn("m", metres).where(F.col("m") <= fixed.NEARBY_M).groupBy(
        "lat_e5", "lng_e5"
    ).agg(F.min(F.struct("m", F.col("e.pos").alias("pos"), F.col("e.name").alias("name"))).alias("b"))
    second = second.join(
        near.select("lat_e5", "lng_e5", F.col("b.name").alias("near_name")), ["lat_e5", "lng_e5"], "left"
    )
    cols = ["qkey", "status", "name", "lat_e5", "lng_e5", "near_name"]
    found = first.withColumn("near_name", F.lit(None).cast("string")).select(*cols).unionByName(
        second.withColumn("near_name", F.when(F.col("status") == "city", F.col("near_name"))).select(*cols)
    )
    out = q.join(found, "qkey", "left")
    status = F.when(F.size("tokens") < 2, "need-two").otherwise(F.coalesce("status", F.lit("none")))
    return out.withColumn("status", status).withColumn("nearby", F.col("near_name").isNotNull())


#: Entries of a prefix in its first block; each further block holds twice as many.
SEARCH_BLOCK = 1024


def _first_hits(queries: DataFrame, posted: DataFrame, k: int) -> DataFrame:
    """Entries (q, n_toks, id, bonus) that fit all words of a query: the first k of the ranking are among them.

    A query reads the entries of its rarest word in ranking order, block by block, and stops after the block that
    brings its k-th hit or ends the list.  So frequent words together cost what the hits need, and a rare word beside
    a frequent one costs the rare word's entries.  queries: q, toks, n_toks; posted: pre, at, held, block, entry.
    """
    sizes = posted.where("at = 0").select(F.col("pre").alias("t"), "held")
    words = queries.select("q", "toks", "n_toks", F.explode("toks").alias("t")).join(sizes, "t", "left")
    rarest = words.groupBy("q", "toks", "n_toks").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "t")).alias("r"))
    waiting = materialize(rarest.where("r.held > 0").select("q", "toks", "n_toks", F.col("r.t").alias("pre"), F.col("r.held").alias("list")), "search-open")
    every = F.forall("toks", lambda t: F.exists("_words", lambda w: F.startswith(w, t)))
    hits, block = None, 0
    while hits is None or not waiting.isEmpty():
        met = posted.where(F.col("block") == block).join(waiting, "pre").where(every).select("q", "n_toks", "id", "bonus")
        found = materialize(met, "search-hits")
        hits = found if hits is None else hits.unionByName(found)
        served = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("q")
        read = SEARCH_BLOCK * (2 ** (block + 1) - 1)
        waiting = materialize(waiting.where(F.col("list") > read).join(served, "q", "left_anti"), "search-open")
        block += 1
    return hits


def search_stops(queries: DataFrame, stops: DataFrame, k: int = 12) -> DataFrame:
    """Top k stops per query text.

    4-5 digit queries match an id, a code or an id prefix, in id order.  Other queries need
    every word to start some word of the stop's name or streets; listed stops get +0.5 and
    sheltered ones +0.1.  A query of words that do not count (street types) fits every stop.  stops: id (text), code, name, on, at, shelter, listed.
    queries: q.
    """
    s = stops.withColumn(
        "_words",
        F.array_distinct(name_tokens(F.concat_ws(" ", "name", F.coalesce("on", F.lit("")), F.coalesce("at", F.lit(""))))),
    )
    q = queries.select("q").distinct().withColumn("_t", F.trim("q")).where("_t <> ''")
    numeric = F.col("_t").rlike(r"^\d{4,5}$")
    wanted = F.coalesce(parse_stop_code(F.col("_t")), F.col("_t"))
    nq = q.where(numeric).select("q", F.col("_t").alias("code_q"), wanted.alias("id_q"))
    prefixes = F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("id"))), lambda n: F.substring(F.col("id"), 1, n))
    by_id = s.withColumn("id_q", F.explode(F.array_distinct(prefixes))).join(nq, "id_q").select("q", "id")
    by_code = s.join(nq, s["code"] == nq["code_q"]).select("q", "id")
    numbered = by_id.unionByName(by_code).distinct().withColumn("score", F.lit(0.0))
    wq = q.where(~numeric).select("q", F.array_distinct(name_tokens(F.col("_t"))).alias("toks"), F.size(name_tokens(F.col("_t"))).alias("n_toks"))
    starts = F.array_distinct(F.flatten(F.transform(
        "_words", lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.substring(w, F.lit(1), n))
    )))
    bonus = F.when(F.col("listed"), 0.5).otherwise(0.0) + F.when(F.col("shelter"), 0.1).otherwise(0.0)
    order = [F.desc("bonus"), F.length("id"), F.col("id")]
    # hits of a query rank as the stops do, so the stops of each prefix stand in that order once for all queries
    placed = global_rank(s.select("id", bonus.alias("bonus"), "_words"), order, "place")
    posted = placed.select("id", "bonus", "place", "_words", F.explode(starts).alias("pre"))
    posted = materialize(
        number_within(posted, ["pre"], ["place"], "at", size="held").withColumn("block", F.floor(F.log2(F.col("at") / SEARCH_BLOCK + 1))), "postings"
    )
    score = (F.col("n_toks") + F.col("bonus")).alias("score")
    one = wq.where(F.size("toks") == 1).withColumn("pre", F.get("toks", F.lit(0))).join(posted.where(F.col("at") < k), "pre").select("q", "id", score)
    more = _first_hits(wq.where(F.size("toks") > 1), posted, k).select("q", "id", score)
    # no word that counts: every stop fits, so the best ones of all
    top = ranked(s.select("id", bonus.alias("bonus")), k, [], order).agg(F.collect_list(F.struct("id", "bonus")).alias("top"))
    none = wq.where(F.size("toks") == 0).withColumn("hit", F.explode(top.scalar())).select("q", "hit.id", F.col("hit.bonus").alias("score"))
    worded = one.unionByName(more).unionByName(none)
    hits = numbered.unionByName(worded)
    return ranked(hits, k, ["q"], [F.desc("score"), F.length("id"), F.col("id")])
