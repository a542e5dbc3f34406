"""Merkle manifest of a dataset: nested-interval labels.

Rows are leaves: H (lowercase hex sha256) of their fields, each `-` if null, else its UTF-8 byte count, `:` and its
value.  Leaves of a group (a source) ascend by key; while several nodes remain, every `fanout` consecutive ones become
their H.  The last node is the group's subroot; subroots, ordered by group (null first, then bytewise), make the root
in the same way.

A node carries the interval [lo, hi) of leaf ranks it covers, so structure is arithmetic: a node of level L lies in
bucket lo / fanout^L, its ancestor of level A in bucket lo / fanout^A of that level.  Ancestors are attached by joins
on (group, bucket) that check containment; what a parent's interval holds beside the node's own interval are the
siblings.  A key meets at most `fanout` rows in every join and aggregation, however large a group is, and ranks come
from a range-partitioned sort.  Levels are tables in the shared folder: level L has rows / fanout^L nodes.

Null keys come first.  Rows with equal keys are ordered by their hash; equal rows are interchangeable.  A null group
is a group.  An empty table has no nodes and no root.  Extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranks import global_rank, rank_within
from .common import written

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a table needs to be a level of a tree.
LABEL = ("grp", "n", "level", "lo", "hi", "hash")


def digest(*parts: Column) -> Column:
    """H of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*[encoded(f) for f in fields])


def group_key(group: Column) -> Column:
    """A group as a text that is never null and sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Tree:
    """Levels from the leaves up; level 0 keeps the extra columns of the leaves."""
    levels: list[DataFrame]
    fanout: int

    def nodes(self) -> DataFrame:
        """(grp, n, level, lo, hi, hash) of every node."""
        out = self.levels[0].select(*LABEL)
        for level in self.levels[1:]:
            out = out.unionByName(level.select(*LABEL))
        return out

    def subroots(self) -> DataFrame:
        """The node that covers its whole group, one a group: (grp, hash)."""
        return self.nodes().where("lo = 0 and hi = n").select("grp", "hash")


def grow(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """The trees of all groups over leaves (grp, rank, hash, ...)."""
    sizes = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    own = leaves.join(sizes, "grp").withColumns({"level": F.lit(0), "lo": F.col("rank"), "hi": F.col("rank") + 1}).drop("rank")
    levels = [written(own, "merkle-0")]
    most = sizes.agg(F.max("n")).first()[0] or 0
    width = 1
    while width < most:
        width *= fanout
        below = levels[-1].where("hi - lo < n")
        members = F.array_sort(F.collect_list(F.struct("lo", "hi", "hash")))
        level = below.groupBy("grp", "n", F.expr(f"lo div {width}").alias("bucket")).agg(members.alias("members"))
        level = level.select(
            "grp", "n", F.lit(len(levels)).alias("level"), F.col("members")[0]["lo"].alias("lo"), F.array_max("members.hi").alias("hi"),
            digest(F.array_join("members.hash", "")).alias("hash"), "members",
        )
        levels.append(written(level, f"merkle-{len(levels)}"))
    return Tree(levels, fanout)


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """Leaves with `path`: the siblings of the node and of its ancestors, level by level, as hashes to the left and to
    the right.  `above` (grp, path) goes on from the subroots."""
    step = "array<struct<left:string,right:string>>"
    attached = None
    for k in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[k]
        whole = level.where("lo = 0 and hi = n").join(above, "grp")
        if attached is not None:
            width = tree.fanout ** (k + 1)
            parent = attached.select(
                F.col("grp").alias("p_grp"), F.expr(f"lo div {width}").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                F.col("members").alias("p_members"), F.col("path").alias("p_path"),
            )
            met = level.where("hi - lo < n").withColumn("bucket", F.expr(f"lo div {width}"))
            met = met.join(parent, (F.col("grp") == F.col("p_grp")) & (F.col("bucket") == F.col("p_bucket")) & (F.col("lo") >= F.col("p_lo")) & (F.col("hi") <= F.col("p_hi")))
            left = F.array_join(F.filter("p_members", lambda m: m["hi"] <= F.col("lo"))["hash"], "")
            right = F.array_join(F.filter("p_members", lambda m: m["lo"] >= F.col("hi"))["hash"], "")
            own = F.array(F.struct(left.alias("left"), right.alias("right")))
            inner = met.withColumn("path", F.concat(own, "p_path").cast(step)).select(*level.columns, "path")
            whole = whole.select(*level.columns, F.col("path").cast(step)).unionByName(inner)
        attached = whole
    return attached


def fold(hash_: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, hash_, lambda own, s: digest(s["left"], own, s["right"]))


def siblings(path: Column) -> Column:
    """All sibling hashes of a path, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass(frozen=True)
class Manifest:
    tree: Tree                     # one tree a group
    top: Tree                      # over the subroots
    leaves: DataFrame              # grp, key columns, hash, path, subroot, root

    def nodes(self) -> DataFrame:
        """Every node of the groups' trees, and of the top tree with a null grp."""
        top = self.top.nodes().where("level > 0").withColumn("grp", F.lit(None).cast("string"))
        return self.tree.nodes().unionByName(top)


def manifest(docs: DataFrame, group: str, key: str, hashes: dict[str, Column], fanout: int = FANOUT) -> Manifest:
    """The manifest of docs.  hashes["hash"] is the leaf; further entries are kept beside it."""
    own = docs.select(group_key(F.col(f"`{group}`")).alias("grp"), F.col(f"`{key}`").alias("key"), *[c.alias(n) for n, c in hashes.items()])
    own = written(own, "merkle-leaves").withColumn("copy", F.monotonically_increasing_id())
    ranked = rank_within(own, ["grp"], [F.col("key").asc_nulls_first(), F.col("hash"), F.col("copy")], "rank").drop("copy")
    tree = grow(ranked, fanout)
    subroots = tree.subroots()
    top = grow(global_rank(subroots.withColumnRenamed("grp", "of"), [F.col("of")], "rank").withColumn("grp", F.lit("")), fanout)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = top.subroots().select("grp", F.col("hash").alias("root"), nothing.alias("path"))
    above = proofs(top, root.select("grp", "path")).join(root.select("grp", "root"), "grp")
    above = written(above.select(F.col("of").alias("grp"), F.col("hash").alias("subroot"), "root", "path"), "merkle-top")
    leaves = proofs(tree, above.select("grp", "path")).join(above.select("grp", "subroot", "root"), "grp")
    return Manifest(tree, top, leaves)


def checked(docs: DataFrame) -> DataFrame:
    """Each document's leaf, subroot, root and proof, and the root that its copy gives: texts of documents whose
    decimal doc_id has an even crc32 lose their line feeds there (a null doc_id or text stays)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    hashes = {"hash": leaf([F.col(c) for c in FIELDS]), "seen": leaf([text if c == "text" else F.col(c) for c in FIELDS])}
    found = manifest(docs, "source", "doc_id", hashes).leaves
    folded = found.withColumn("folded_root", fold(F.col("seen"), F.col("path")))
    return folded.select(
        F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if c == "text" else c) for c in FIELDS) + ")"


#: crc32 has no function in DuckDB: eight shifts a byte of the decimal digits.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(doc_id::varchar, '')]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""

SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {_leaf_sql('text')} AS leaf,
         CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS seen
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY grp) AS n FROM base
), tree AS (
  SELECT 0 AS level, grp, rank AS idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, grp, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY level, grp, idx // 3
), subroots AS (
  SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS rank, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, rank AS idx, n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 3
), steps AS (
  SELECT a.grp, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM tree a JOIN tree b ON a.grp = b.grp AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
), top_steps AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
), heights AS (SELECT grp, max(level) AS height FROM tree GROUP BY grp), walk AS (
  SELECT doc_id, grp, rank, n, 0 AS k, rank AS at, leaf, seen AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.grp, w.rank, w.n, w.k + 1, CASE WHEN w.k + 1 = t.height THEN r.rank WHEN w.k = t.height THEN r.rank // 3 ELSE w.at // 3 END, w.leaf,
         sha256(coalesce(s.l, p.l) || w.h || coalesce(s.r, p.r)), w.proof || coalesce(s.l || s.r, p.l || p.r)
  FROM walk w JOIN heights t USING (grp) JOIN subroots r USING (grp)
  LEFT JOIN steps s ON s.grp = w.grp AND s.level = w.k AND s.idx = w.at AND w.k < t.height
  LEFT JOIN top_steps p ON w.k >= t.height AND p.level = w.k - t.height AND p.idx = (CASE WHEN w.k = t.height THEN r.rank ELSE w.at END)
  WHERE s.l IS NOT NULL OR p.l IS NOT NULL
), last AS (
  SELECT w.*, row_number() OVER (PARTITION BY grp, rank ORDER BY k DESC) AS newest FROM walk w
)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, l.h AS folded_root,
       l.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM last l JOIN subroots s USING (grp) WHERE newest = 1
"""
