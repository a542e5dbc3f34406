import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from placetime.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op2": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op6": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op7": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op9": {"page_id", "host", "path", "rule", "verdict"},
    "op10": {"doc_id", "n_shingles", "component_id"},
}


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("op", CONTRACT)
def test_contract_columns(spark, op):
    name = next(n for n in queries.QUERIES if n.startswith(op + "_"))
    assert CONTRACT[op] <= set(queries.QUERIES[name](spark, SF).columns)


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(21)
    common = "the of and to in is that for it as with was on be by".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(["ra", "ne", "ti", "mol", "se", "ko", "bu"]) for _ in range(6)) for _ in range(n))
    item = prose(40)
    rows = [(k, prose(120) + "\nShared footer of the site", "en", f"src{k % 2}") for k in range(60)]
    rows += [(100, rows[3][1], "en", "src1"), (101, rows[4][1].replace(" the ", " THE ", 1) + " end", "en", "src0")]
    rows += [(200, prose(40) + " " + item + " " + prose(40), "en", "src0"), (300, " ".join(w.upper() + "!!" for w in prose(120).split()), "en", "src0"), (301, "too short", "en", "src1"), (302, None, None, None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == df.columns, name
        out.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(60))
    assert seen[0] == clean | {100, 101, 200}
    assert seen[1] == seen[0]
    texts = [r.text for r in spark.read.parquet(f"{sf}/stage1").collect()]
    assert not any("Shared footer of the site" in t.split("\n") for t in texts)
    assert seen[2] == clean | {200}
    assert seen[3] == clean and seen[4] == clean
    pieces = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, pieces.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect())) or \
        pieces.groupBy("doc_id").agg({"length": "sum"}).orderBy("doc_id").collect() == docs.groupBy("doc_id").agg({"length": "sum"}).orderBy("doc_id").collect()


def test_near_copies_from_four_fifths_on(spark):
    """Pairs of a five-word similarity of 0.80 to 0.85 lose a copy, those below stay; all are under 0.85 with four words."""
    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    jaccard = lambda a, b, k: (lambda x, y: len(x & y) / len(x | y))(*({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (a, b)))
    pairs = []
    for p in range(10):
        long, short = words(2 * p, 100), words(2 * p + 1, 50)
        pairs += [(long, long + words(f"end{p}", 18 + p % 7)), (short, short[:20] + [f"other{p}"] + short[21:])]  # a block at the end; one word changed
        pairs.append((words(f"low{p}", 100), words(f"low{p}", 100) + words(f"more{p}", 25)))
    rows = [(2 * i + j, " ".join(t), "en", "src0", 0) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = {r.doc_id for r in corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    copies = {2 * i + 1 for i, pair in enumerate(pairs) if jaccard(*pair, 5) >= 0.8}
    assert got == {r[0] for r in rows} - copies and len(copies) == 20
    assert all(jaccard(*pair, 4) < 0.85 for pair in pairs)


def test_oracle_of_lines(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = "doc_id, source, n_lines, n_dropped, text"
    want = con.sql(f"SELECT {cols} FROM ({queries.ORACLES['op4_site_line_frequency']})").fetchall()
    got = queries.QUERIES["op4_site_line_frequency"](spark, SF).select(*cols.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
