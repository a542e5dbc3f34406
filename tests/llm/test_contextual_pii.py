import hashlib
import random
import re

from placetime.llm import contextual_pii as c


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and c.luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans():
    rng = random.Random(3)
    for k in range(20_000):
        if k % 3:
            text = "".join(rng.choice("a@.b12 5+-(%é0") for _ in range(rng.randint(0, 40)))
        else:
            text = " ".join(rng.choice(["4111 1111 1111 1111", "1.2.3.4.5.6", "a@b.c@d.e", "+1 (415) 555-0100", "300.1.1.1", "0000.1.2.3", "x"]) for _ in range(4))
        assert c.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 100_000):
        c.base_spans(text)


def test_contexts_discover_unseen_identifiers(spark, docs_of):
    rows = [(k, f"please call agent on +1 415 555 01{k:02d} during office hours today") for k in range(12)]
    rows += [(50 + k, f"my badge number is 77{k}123 and it is green") for k in range(3)]  # another context: stays
    rows += [(90, "please call agent on 5559911 during office hours today"), (91, "or 14155550103 works"), (92, "plain words")]
    got = {r.doc_id: r for r in c.scan(docs_of(rows)).collect()}
    assert got[90].spans == "context:21:28" and got[90].n_phone == 0
    assert got[91].n_context == 1  # the digits of a seed
    assert all(got[k].n_context == 0 for k in [*range(12), 50, 51, 52, 92])


def test_scores_by_hand(spark, docs_of):
    rows = [(k, f"ring me at +4420794600{k:02d} now ok") for k in range(4)] + [(9, "ring me at 998877 now ok")]
    notes = c.noted(docs_of(rows))
    got = {r.instance: r.score for r in c.scores(notes, 1).collect() if not r.instance.startswith("#")}
    share = 4 / 6  # four trusted of five instances, one more in the divisor
    assert abs(got["998877"] - (1 - (1 - round(share, 6)) ** 3)) < 1e-5


def test_odd_rows(spark, docs_of, odd_rows):
    rows = odd_rows + [(100, "mail a.b@c.org or 10.0.0.1"), (100, "mail a.b@c.org or 10.0.0.1")]
    got = c.scan(docs_of(rows)).collect()
    want = sorted((str(r[0]), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(r[1] or "")).encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    assert {r.spans for r in got if r.doc_id == 100} == {"email:5:14,ip:18:26"}
    assert c.scan(docs_of(rows).limit(0)).count() == 0
