import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from placetime.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(hashes, fanout):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + fanout]) for k in range(0, len(last), fanout)])
    return levels


def path_of(levels, at, fanout):
    path = []
    for level in levels[:-1]:
        first = at - at % fanout
        path.append((level[first:at], level[at + 1 : first + fanout]))
        at //= fanout
    return path


def plain(rows, fanout=3):
    """One tuple a row (doc_id, text, lang, source, n_chars), in any order."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        seen = h(*map(field, (doc_id, source, lang, n_chars, changed)))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, seen, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([r[2] for r in sorted(groups[s])], fanout) for s in names}
    top = levels_of([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, seen, doc_id) in enumerate(sorted(groups[s])):
            path = path_of(trees[s], at, fanout) + path_of(top, k, fanout)
            folded = seen
            for left, right in path:
                folded = h(*left, folded, *right)
            proof = h(*[x for left, right in path for x in left + right])
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_proofs_equal_a_plain_tree(docs_of):
    rnd = random.Random(5)
    rows = [(rnd.randrange(10**9), rnd.choice(["a\nb", "ü\n\n", "x", "", None]), rnd.choice(["en", None]), rnd.choice(["hot"] * 6 + ["a", "é", "Z", None])) for _ in range(90)]
    rows += [(7, "only\none", "en", "lone"), (8, "t", "en", "")]
    docs = docs_of(rows)
    got = merkle.checked(docs.repartition(5)).select(*COLUMNS).collect()
    kept = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert order(got) == order(plain(kept))
    assert {r.verified for r in got} == {True, False}


def test_odd_rows_and_clashing_columns(docs_of, odd_rows):
    docs = docs_of(odd_rows).withColumns({"grp": F.lit("x"), "hash": F.lit("y"), "level": F.lit(1), "key": F.lit(2)})
    kept = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert order(merkle.checked(docs).select(*COLUMNS).collect()) == order(plain(kept))


def test_no_rows_and_one_row(docs_of):
    assert merkle.checked(docs_of([(1, "a")]).limit(0)).collect() == []
    (row,) = merkle.checked(docs_of([(1, "a")])).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h()


@pytest.mark.parametrize("fanout", [2, 4])
def test_intervals_nest(spark, fanout):
    docs = spark.range(23).select("id", F.when(F.col("id") % 4 > 0, "a").alias("g"))
    made = merkle.manifest(docs, "g", "id", {"hash": merkle.leaf([F.col("id")])}, fanout)
    nodes = [r.asDict() for r in made.tree.nodes().collect()]
    for node in nodes:
        assert node["lo"] % fanout ** node["level"] == 0 and node["hi"] == min(node["n"], node["lo"] + fanout ** node["level"])
        parents = [p for p in nodes if p["grp"] == node["grp"] and p["level"] == node["level"] + 1 and p["lo"] <= node["lo"] and node["hi"] <= p["hi"]]
        assert len(parents) == (node["hi"] - node["lo"] < node["n"])
    leaves = made.leaves.collect()
    assert len(leaves) == 23
    for g in ("", "=a"):
        mine = sorted((r for r in leaves if r.grp == g), key=lambda r: r.key)
        tree = levels_of([r.hash for r in mine], fanout)
        top = levels_of([next(r.subroot for r in leaves if r.grp == s) for s in ("", "=a")], fanout)
        for at, r in enumerate(mine):
            path = path_of(tree, at, fanout) + path_of(top, ["", "=a"].index(g), fanout)
            assert [(s["left"], s["right"]) for s in r.path] == [("".join(left), "".join(right)) for left, right in path]
