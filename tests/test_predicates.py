"""Filters as trees: column, SQL text, normal form and plain part agree on rows with nulls."""

import itertools
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from placetime.operators import quality as qu
from placetime.sources import events as se
from placetime.sources import predicates as pr
from placetime.sources import registry as rg
from placetime.sources import sinks as sk

VALUES = ["a", "b", "Sale", "for sale", "o'x\\y", None]


@pytest.fixture(scope="module")
def table(spark):
    every = list(itertools.product(VALUES, VALUES, [1, 2, None]))
    return spark.createDataFrame([(k, *r) for k, r in enumerate(every)], "id int, x string, y string, n int")


def some(rnd, depth):
    kind = rnd.randrange(8 if depth else 5)
    if kind == 0:
        return pr.one_of(rnd.choice("xy"), *rnd.sample([v for v in VALUES if v], rnd.randint(1, 3)))
    if kind == 1:
        return pr.IsNull(rnd.choice("xyn"))
    if kind == 2:
        return pr.HasToken(rnd.choice("xy"), tuple(rnd.sample(["SALE", "SALES", "A", "FOR", "O'"], rnd.randint(1, 3))))
    if kind == 3:
        return pr.one_of("n", *rnd.sample([1, 2, 3], rnd.randint(1, 2)))
    if kind == 4:
        return rnd.choice([pr.From("x", "b"), pr.FoldedOneOf("x", ("sale", "a"))])
    if kind == 5:
        return pr.Not(some(rnd, depth - 1))
    return (pr.All if kind == 6 else pr.Any)(tuple(some(rnd, depth - 1) for _ in range(rnd.randint(1, 3))))


def plain_test(p, row):
    """A condition on a row, in Python."""
    if isinstance(p, pr.OneOf):
        return row[p.col] in p.values
    if isinstance(p, pr.IsNull):
        return row[p.col] is None
    if isinstance(p, pr.From):
        return row[p.col] is not None and row[p.col] >= p.value
    if isinstance(p, pr.FoldedOneOf):
        return row[p.col] is not None and row[p.col].lower() in p.values
    if isinstance(p, pr.HasToken):
        return row[p.col] is not None and any(t in row[p.col].upper() for t in p.tokens)
    if isinstance(p, pr.Not):
        return not plain_test(p.term, row)
    return (all if isinstance(p, pr.All) else any)(plain_test(t, row) for t in p.terms)


def test_all_forms_take_the_same_rows(spark, table):
    rnd = random.Random(8)
    trees = [some(rnd, 3) for _ in range(40)]
    data = [r.asDict() for r in table.collect()]
    table.createOrReplaceTempView("predicate_rows")
    for k in range(0, 40, 10):
        part = trees[k : k + 10]
        forms = [f(p) for p in part for f in (lambda p: p.column(), lambda p: F.expr(p.sql()), lambda p: p.normal().column(), lambda p: (p.plain() or pr.All(())).column())]
        got = table.select("id", *[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(forms)]).collect()
        for r in got:
            row = data[r.id]
            for i, p in enumerate(part):
                want = plain_test(p, row)
                column, text, normal, plain = r[1 + 4 * i : 5 + 4 * i]
                assert column == text == normal == want and (plain or not want), p
    found = pr.matching(table, {str(k): p for k, p in enumerate(trees)}, "name")
    assert rows(found, "id", "name") == sorted((row["id"], str(k)) for row in data for k, p in enumerate(trees) if plain_test(p, row))


def test_normal_form_ignores_order_nesting_and_repetition():
    a, b, c = pr.one_of("x", "p"), pr.IsNull("y"), pr.HasToken("z", ("SALE", "SALES"))
    assert pr.same(pr.All((a, pr.All((b, c)))), pr.All((c, b, a, a)))
    assert pr.same(pr.Any((pr.one_of("x", "q"), a)), pr.one_of("x", "p", "q")) and pr.same(c, pr.HasToken("z", ("SALE",)))
    assert pr.same(~(a | b), ~a & ~b) and pr.same(~~a, a) and not pr.same(a & b, a | b)
    assert pr.same((a & b) | (pr.one_of("x", "q") & b), pr.one_of("x", "q", "p") & b)
    assert not pr.same(pr.HasToken("z", ("A",)), pr.HasToken("z", ("A",), "lower"))


def test_known_parity_of_the_registries():
    assert pr.same(rg.STOPS["cfs_presence"].filter, rg.UNHOUSED["cfs_sitlie"].filter | rg.UNHOUSED["cfs_homeless"].filter)
    parts = pr.Any(tuple(p for _, p in rg.UNHOUSED["encampment"].components))
    assert pr.same(rg.UNHOUSED["encampment"].filter, parts)


def test_texts_are_searched_once_and_plain_parts_reach_the_scan(spark, tmp_path):
    rows_ = [("Street and Sidewalk Cleaning", "x", "needle", "2024-01-01", "1", None, None, "a"), ("Noise", None, None, "2020-01-01", "2", None, None, "b")]
    raw = spark.createDataFrame(rows_, "service_name string, service_subtype string, service_details string, requested_datetime string, service_request_id string, lat string, long string, address string")
    raw.write.parquet(f"{tmp_path}/raw")
    stored = spark.read.parquet(f"{tmp_path}/raw")
    found = se.lever_events({"raw_311": stored}, rg.LEVERS, "2023-01-01")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line).split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(requested_datetime,2023-01-01)" in pushed and "Or(" in pushed
    assert plan.count("lower(service_details") == 1 and plan.count("Contains") == plan.count("Contains(_text")
    tokens = {t for sigs in rg.LEVERS.values() for s in sigs for leaf in s.filter.leaves() if isinstance(leaf, pr.HasToken) and leaf.col == "service_details" for t in leaf.tokens}
    assert all(plan.count(f", {t})") == 1 for t in tokens)
    assert rows(found, "lever", "id") == [("hazard", "1")]


def test_conditions_known_as_columns_still_work(spark, table):
    found = rg.tag_signals(table, {"a": F.col("x") == "a", "none": F.lit(None).cast("boolean"), "n": pr.one_of("n", 1) & pr.IsNull("x")})
    assert found.groupBy("signal").count().collect() and {r.signal for r in found.collect()} == {"a", "n"}
    with pytest.raises(ValueError):
        pr.as_predicate(F.col("x") == "a").sql()


def test_columns_may_stand_inside_trees(spark, table):
    gate, a = F.col("n") == 1, F.col("x") == "a"
    got = rg.tag_signals(table, {"other": rg.complement(gate, a, pr.one_of("x", "b")), "not": ~pr.one_of("n", 1, 2) & a, "either": pr.Any((pr.IsNull("x"), a))})
    assert rows(got.groupBy("signal").count()) == [("either", 36), ("not", 6), ("other", 24)]
    one = pr.as_predicate(a)
    assert pr.same(pr.All((one, one)), one) and not pr.same(one, pr.as_predicate(F.col("x") == "a"))


@pytest.mark.parametrize("name", ["tag_signals", "complement_class"])
def test_tagging_queries_match_sql(spark, name):
    import duckdb

    from placetime.plans import catalog

    catalog.load_all()
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    assert rows(got) == sorted(tuple(r[c] for c in got.columns) for r in con.execute(catalog.ORACLES[name]).df().to_dict("records"))


def test_provenance_texts_give_their_own_counts(spark, table):
    reg = rg.Registry((
        rg.Signal("one", "t", pr.one_of("x", "o'x\\y"), "id", "n", caveat="c", components=(("part", pr.one_of("n", 1)),)),
        rg.Signal("opaque", "t", lambda: F.col("x") == "a", "id", "n"), rg.Signal("none", "t", pr.one_of("x", "zz"), "id", "n"),
    ))
    got = rows(sk.audited(sk.provenance_filters(reg, spark), {"t": table}), "signal", "component", "caveat", "records")
    assert sorted(got, key=str) == [("none", None, None, 0), ("one", "part", "c", 36), ("one", None, "c", 18)]


def test_parity_reports_form_and_rows(spark, table):
    a, b = pr.one_of("x", "a", "b"), pr.one_of("x", "b", "a")
    got = rows(qu.filter_parity({"t": table}, {"order": ("t", a, b), "drift": ("t", a, pr.one_of("x", "a"))}), "entity", "same_form", "ours", "theirs", "apart")
    assert got == [("drift", False, 36, 18, 18), ("order", True, 36, 36, 0)]
