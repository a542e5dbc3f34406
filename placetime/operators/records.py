"""Intervention records: projection, validation, ids and change logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.geo import to_e5
from ..functions.ranks import number_within
from ..functions.text import is_email, query_param, sentence_case, truncated, well_formed_links
from .spatial import assign_polygon

TRACKER_TEXT = ("description", "evidence", "tactics", "owner", "agencies", "roadblock", "outcomes", "notes")


def _blank(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def public_records(records: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Public form of stored records: legacy link parameters fill missing fields, a default
    status, the stored district or the pin's, and no e-mail.

    records: id, intervention, levers, url, status, start_date, end_date, district, lat, lng,
    radius, email, created, last_edited.
    """
    own = F.col("intervention") != ""
    url = F.col("url")
    legacy = ~F.coalesce(own, F.lit(False))
    dp = F.when(legacy, query_param(url, "dp")).otherwise(F.get("levers", F.lit(0)))
    date = F.when(legacy, query_param(url, "date")).otherwise(_blank("start_date"))
    what = F.when(legacy, query_param(url, "what")).otherwise(F.col("intervention"))
    plat = F.coalesce(F.col("lat"), query_param(url, "lat").try_cast("double"))
    plng = F.coalesce(F.col("lng"), query_param(url, "lng").try_cast("double"))
    out = records.withColumns({
        "what": what, "dp": dp, "date": date, "lat": plat, "lng": plng,
    }).withColumns({
        "intervention": F.coalesce(_blank("intervention"), "what"),
        "levers": F.when(F.col("levers").isNotNull(), F.col("levers")).otherwise(
            F.when(F.col("dp").isNotNull(), F.array("dp")).otherwise(F.array().cast("array<string>"))
        ),
        "status": F.coalesce(_blank("status"), F.lit(fixed.RECORD_STATES[0])),
        "start_date": F.coalesce(_blank("start_date"), "date"),
        "last_edited": F.coalesce("last_edited", "created"),
    })
    if rings is not None:
        pins = out.withColumns({"lat_e5": to_e5(F.col("lat")), "lng_e5": to_e5(F.col("lng"))})
        stored = pins.withColumnRenamed("district", "_stored")
        out = assign_polygon(stored, rings, unknown="Other").withColumn(
            "district", F.coalesce(_blank("_stored"), "district")
        ).drop("_stored", "lat_e5", "lng_e5")
    return out.drop("email")


def table_rows(public: DataFrame) -> DataFrame:
    """Rows of the tracker table: title fallbacks and the KR label of the first lever."""
    labels = F.create_map(*[F.lit(x) for kv in fixed.KR_LABELS.items() for x in kv])
    title = F.coalesce(
        _blank("intervention"), F.nullif(sentence_case(F.col("what")), F.lit("")), F.lit("Saved intervention")
    )
    kr = F.coalesce(F.try_element_at(labels, F.col("dp")), sentence_case(F.col("dp")))
    return public.withColumns({"intervention": title, "target_kr": F.coalesce(kr, F.lit(""))})


def third_kpi(district: Column) -> Column:
    """The district's own third measure as (signal, label, goal); null elsewhere."""
    entries = [x for name, kpi in fixed.DISTRICT_THIRD_KPI.items() for x in (
        F.lit(name), F.struct(*[F.lit(v).alias(c) for c, v in zip(("signal", "label", "goal"), kpi)])
    )]
    return F.try_element_at(F.create_map(*entries), district)


STORED = "id string, intervention string, levers array<string>, status string, deleted boolean, lat double, lng double"


def stored_documents(rows: DataFrame, doc: str = "doc", schema: str = STORED) -> DataFrame:
    """Records from their stored JSON documents, deleted ones left out; a document that cannot be read has
    an error and no fields."""
    parsed = rows.withColumn("_r", F.from_json(doc, schema, {"mode": "PERMISSIVE"}))
    broken = F.coalesce(F.col(doc), F.lit("")).rlike(r"^\s*\{[\s\S]*\}\s*$") & F.col("_r").isNotNull()
    out = parsed.withColumn("error", F.when(~broken, "not a document"))
    return out.where(~F.coalesce("_r.deleted", F.lit(False))).select(*rows.drop(doc).columns, "_r.*", "error").drop("deleted")


def visible_rows(rows: DataFrame) -> DataFrame:
    """Archived rows (any closed state) are hidden."""
    return rows.where(~F.coalesce(F.col("status"), F.lit("")).rlike("^closed"))


def stale(last_evaluated: Column, today: str, days: int = 30) -> Column:
    return F.coalesce(F.datediff(F.lit(today).cast("date"), last_evaluated) > days, F.lit(False))


def validate_records(rows: DataFrame, districts: Sequence[str] = tuple(fixed.ID_PREFIXES)) -> DataFrame:
    """Cleaned rows with `errors`, every rule a row breaks.  Lists and texts beyond their limits are an
    error and are trimmed; `<column>_whole` keeps what was sent."""
    title = F.trim(F.coalesce("intervention", F.lit("")))
    person = truncated(F.col("person_submitted"), 200)
    email = F.trim(F.coalesce("email", F.lit("")))
    district = F.trim(F.coalesce("district", F.lit("")))
    status = F.coalesce(_blank("status"), F.lit(fixed.RECORD_STATES[0]))
    rules = {
        "title required": title == "",
        "title too long": F.length(title) > 500,
        "name required": person.isNull(),
        "email not valid": (email != "") & (~is_email(email) | (F.length(email) > 254)),
        "district required": ~district.isin(*districts),
        "status not valid": ~status.isin(*fixed.RECORD_STATES),
    }
    levers = F.filter(F.coalesce("levers", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    links = well_formed_links(F.col("links"))
    limited = {c: n for c, n in fixed.TEXT_LIMITS.items() if c in rows.columns}
    long = reduce(or_, [F.length(F.trim(F.coalesce(c, F.lit("")))) > n for c, n in limited.items()], F.lit(False))
    rules |= {
        "too many levers": F.size(levers) > fixed.MOST_LEVERS, "too many links": F.size(links) > fixed.MOST_LINKS, "text too long": long,
    }
    marks = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    texts = {c: truncated(F.col(c), n) for c, n in limited.items()}
    whole = {f"{c}_whole": F.col(c) for c in limited}
    return rows.withColumns({
        "errors": F.array_compact(marks), "intervention": title, "person_submitted": person,
        "email": F.nullif(email, F.lit("")), "district": district, "status": status,
        "levers": F.slice(levers, 1, fixed.MOST_LEVERS), "levers_whole": levers,
        "links": F.slice(links, 1, fixed.MOST_LINKS), "links_whole": links, **texts, **whole,
    })


def validate_links(url: Column, origins: Sequence[str] | str, path: str) -> Column:
    """First problem of a shared-analysis link, null when it is fine.  origins: a list, or a pattern."""
    origin = F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("AUTHORITY")))
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "required")
        .when(F.length(url) > 2048, "too long")
        .when(~F.coalesce(url.rlike(r"(?i)^https?://[^\s/]+"), F.lit(False)), "not valid")
        .when(~F.coalesce(origin.rlike(origins) if isinstance(origins, str) else origin.isin(*origins), F.lit(False)), "other site")
        .when(~F.coalesce(F.contains(F.parse_url(url, F.lit("PATH")), F.lit(path)), F.lit(False)), "other page")
        .when(F.coalesce(query_param(url, "what"), F.lit("")) == "", "no intervention")
    )


def next_ids(new: DataFrame, issued: DataFrame, prefixes: dict[str, str], order: Sequence[str]) -> DataFrame:
    """Ids like CEN001 for new records: numbers continue after the highest one issued for the
    prefix, in creation order.

    Positions inside a prefix are counted in ranges, so a prefix holding most of the
    new records is not numbered by one task.
    """
    pairs = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    other = prefixes.get("Other", "OTH")
    rows = new.withColumn("prefix", F.coalesce(F.try_element_at(pairs, F.col("district")), F.lit(other)))
    rows = number_within(rows, ["prefix"], order, "_pos")
    last = issued.select(
        F.regexp_extract("intervention_id", r"^([A-Z]+)(\d+)$", 1).alias("prefix"),
        F.regexp_extract("intervention_id", r"^([A-Z]+)(\d+)$", 2).try_cast("int").alias("num"),
    ).where("num is not null").where(
        F.col("prefix").isin(*prefixes.values(), other)
    ).groupBy("prefix").agg(F.max("num").alias("_last"))
    num = F.coalesce("_last", F.lit(0)) + F.col("_pos") + 1
    text = num.cast("string")
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0"))
    return (
        rows.join(F.broadcast(last), "prefix", "left")   # at most one row per known prefix
        .withColumn("intervention_id", F.concat("prefix", padded))
        .drop("_pos", "_last")
    )


def apply_changes(records: DataFrame, changes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Active records after a change log.

    changes: id, at, op ('patch', 'close', 'reopen', 'delete') and the patched fields (null =
    unchanged).  Per field the latest change that sets it wins; a deleted id leaves the
    list.  Each field is one max over (at, value), so a record with a long log is combined
    before it is shuffled.
    """
    at = F.col("at")
    status = F.when(F.col("op") == "close", F.lit("closed_completed")).when(
        F.col("op") == "reopen", F.lit("open_in_progress")
    ).otherwise(F.col("status"))
    ended = F.struct(
        at, F.when(F.col("op") == "close", F.substring(at.cast("string"), 1, 10)).alias("end_date")
    )
    rows = changes.withColumn("status", status)
    latest = rows.groupBy("id").agg(
        F.max("at").alias("_at"), F.max((F.col("op") == "delete")).alias("_gone"),
        F.max(F.when(F.col("op").isin("close", "reopen"), ended)).alias("_end"),
        *[
            F.max(F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("v")))).alias(f"_{c}")
            for c in fields
        ],
    )
    j = records.join(latest, "id", "left")
    out = j.where(~F.coalesce("_gone", F.lit(False)))
    sets = {c: F.coalesce(F.col(f"_{c}.v"), F.col(c)) for c in fields}
    if "end_date" in records.columns:
        sets["end_date"] = F.when(F.col("_end").isNotNull(), F.col("_end.end_date")).otherwise(F.col("end_date"))
    sets["last_edited"] = F.greatest("last_edited", "_at")
    return out.withColumns(sets).select(*records.columns)


def newest_first(df: DataFrame, limit: int | None = None, by: str = "created", tie: str = "id") -> DataFrame:
    out = df.orderBy(F.desc(by), tie)
    return out if limit is None else out.limit(limit)


def union_records(curated: DataFrame, saved: DataFrame) -> DataFrame:
    return curated.unionByName(saved, allowMissingColumns=True)
