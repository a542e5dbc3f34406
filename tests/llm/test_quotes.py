import random

from placetime.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, body string, depth string"


def order(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return {(r.conv_id, r.turn, r.role): r for r in quotes.reply_order(df).collect()}


def test_links_levels_and_order(spark):
    got = order(spark, [
        (1, 0, "u", "Hello there friend.\nHow are you?\n\nSecond paragraph here"), (1, 1, "a", "> How are you?\nFine."),
        (1, 2, "u", "On 3 May, Ann wrote:\n> > how  ARE you?\n> Fine.\nGreat"), (1, 3, "u", "> Second paragraph here\nok"),
        (1, 4, "u", "> unknown\nx"), (1, 5, "a", ">Great\nthanks"), (1, 6, "a", "> Hello there friend. how are\n"), (2, 0, "u", None),
        (None, 0, "u", "> Great"), (1, None, "u", "> Great"), (3, 0, "u", "same"), (3, 0, "u", "same"), (3, 1, "a", "> same\nyes"),
    ])
    body = {k[:2]: (r.body, r.parent_turn, r.root_turn, r.depth) for k, r in got.items()}
    assert body[1, 0] == ("Hello there friend.\nHow are you?\n\nSecond paragraph here", None, 0, 0)
    assert body[1, 1] == ("Fine.", 0, 0, 1)
    assert body[1, 2] == ("Great", 1, 0, 2)
    assert body[1, 3] == ("ok", 0, 0, 1)
    assert body[1, 4] == ("x", None, 4, 0)
    assert body[1, 5] == ("thanks", 2, 0, 3)
    assert body[2, 0] == ("", None, 0, 0)
    assert body[None, 0][1] is None and body[1, None][1] is None
    assert body[3, 1] == ("yes", 0, 0, 1)
    turns = sorted((r.position, k[1]) for k, r in got.items() if k[0] == 1 and k[1] is not None)
    assert [t for _, t in turns] == [0, 1, 3, 2, 5, 4, 6]


def test_hot_line_goes_to_the_latest_holder(spark):
    rng = random.Random(5)
    rows, latest, want = [], None, {}
    for t in range(900):
        quoting = rng.random() < 0.5 and latest is not None
        rows.append((9, t, "u", "> same line" if quoting else ("same line" if rng.random() < 0.02 or t == 0 else f"other {t}")))
        if quoting:
            want[t] = latest
        if rows[-1][3] == "same line":
            latest = t
    got = order(spark, rows)
    assert {k[1]: r.parent_turn for k, r in got.items() if r.parent_turn is not None} == want
    assert sorted(r.position for r in got.values()) == list(range(900))


def test_empty_table(spark):
    assert order(spark, []) == {}
