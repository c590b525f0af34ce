"""Personal data: seeds against the stated expressions, and what patterns discover."""

import hashlib
import random
import re

from grainspan.llm import pii

from .helpers import awkward, docs, prose

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, expression in PLAIN.items():
        for m in re.finditer(expression, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def answer(spark, tmp_path, rows, name):
    docs(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
    return pii.op7_personal_data(spark, str(tmp_path / name)).collect()


PIECES = ["a@b.co", "a@b.co_x@c.de", "x..y@-.-", "@b.c", "a@b", "1.2.3.4", "1.2.3.4.5", "001.255.256.1", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111--1111 1111", "4111111111111111111111", "79927398713", "+1 (555) 555-1234", "+12345", "+1 2 3 4 5 6 7 8 9)", "++49 30 1234567", "é1.1.1.1é", "\U0001f600 a.b@c.d.e.", "٣.1.1.1", "word", "12 34", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]


def test_seeds(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1000 + i, "".join(rng.choice(PIECES) + rng.choice([" ", "", ", ", "\n", "."]) for _ in range(rng.randint(0, 14)))) for i in range(300)] + awkward()
    got = answer(spark, tmp_path, rows, "seeds")
    want = sorted(((i, ",".join(brute(t)), hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=repr) == [(i, h) for i, _, h in want]
    by_id = {r.doc_id: r for r in got}
    for i, spans, _ in want:
        listed = spans.split(",") if spans else []
        assert [by_id[i][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in listed) for k in pii.KINDS]
        assert set(listed) <= set(by_id[i].spans.split(",")) or i in (None, 4)


def test_long_runs_are_linear(spark, tmp_path):
    rows = [(1, "a" * 200000), (2, "1 " * 100000), (3, "a." * 100000 + "@x.y"), (4, "1" * 200000), (5, "+1" + " " * 100000), (6, "x@" + "y." * 50000 + "z")]
    got = {r.doc_id: r for r in answer(spark, tmp_path, rows, "long")}
    assert got[6].n_email == 1 and got[3].n_email == 1 and got[2].n_card == got[4].n_card == got[5].n_phone == 0


def test_patterns_discover(spark, tmp_path):
    rows = [(i, f"My phone number: +1 (555) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(100 + i, f"my phone number: 555-{100 + i}-1234, and the weather of the day is 20-30-4{i}") for i in range(10)]
    rows += [(200 + i, " ".join(prose(50, i, 20)) + " of the +1 (555) 555-77" + f"{10 + i} day of the 12-34-5678 end " + "of the day " * 40) for i in range(10)]
    got = {r.doc_id: r for r in answer(spark, tmp_path, rows, "patterns")}
    assert all(got[100 + i].spans == "phone:17:29" and got[100 + i].n_phone == 0 for i in range(10))
    assert all(got[200 + i].spans == ",".join(brute(rows[22 + i][1])) for i in range(10))
    assert all(got[i].n_phone == 1 for i in range(12))


def test_spaced_identifiers(spark, tmp_path):
    rows = [(i, f"My phone number: +1 (555) 555-{1000 + i} thanks") for i in range(12)]
    cards = [f"4111 1111 {a} {b}" for a in range(1000, 1040) for b in range(1000, 1020)]
    good, bad = [c for c in cards if luhn(c.replace(" ", ""))], [c for c in cards if not luhn(c.replace(" ", ""))]
    rows += [(50 + i, f"my card is {c}, thanks") for i, c in enumerate(good[:12])]
    phones = ["(555) 555-1234", "0171 1234567", "01712345 678", "0171-123 4560", "555-100-1200", "(0)20 7946 0958"]
    rows += [(100 + i, f"x\tmy phone number: {p}{end}") for i, (p, end) in enumerate(zip(phones, [" 5th day", ". 12 men", ", 7", ")", " 2 men", "\n1 2"], strict=True))]
    rows += [(200, f"my card is ({bad[0]}) or"), (201, f"my card is {bad[1].replace(' ', '')} 12/25"), (202, "my phone number: 12 34 of")]
    rows += [(203, "é " * 700 + "my phone number: [(555) 555-1234]")]
    got = {r.doc_id: r.spans for r in answer(spark, tmp_path, rows, "spaced")}
    assert [got[100 + i] for i in range(len(phones))] == [f"phone:19:{19 + len(p)}" for p in phones]
    assert [got[200], got[201], got[202], got[203]] == ["card:12:31", "card:11:27", "", "phone:1418:1432"]


def test_all_patterns_are_used(spark, tmp_path):
    # 4,200 patterns with four seeds each, which discover nothing, and one with three that does
    noise = [" ".join(f"a{p} b{p} x{p}.{i}@c.de and" for p in range(b, b + 100)) + " " + " ".join(f"a{p} b{p} c" for p in range(b, b + 100) for _ in range(3)) for b in range(0, 4200, 100) for i in range(4)]
    rows = list(enumerate(noise)) + [(1000 + i, f"zz number: +1 (555) 555-{1000 + i}") for i in range(3)] + [(2000, "then zz number: 555-100-1234.")]
    got = {r.doc_id: r for r in answer(spark, tmp_path, rows, "all")}
    assert got[2000].spans == "phone:16:28"
    assert got[0].n_email == 100 and got[1001].n_phone == 1


def test_joins_without_broadcast_give_the_same(spark, tmp_path, monkeypatch):
    rows = [(i, f"My phone number: +1 (555) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(100 + i, f"my phone number: 555-{100 + i}-1234, mail to (a{i}@b.de) or my phone number: none") for i in range(10)]
    rows += [(200 + i, f"mail to a{i}@b.de and mail to x{i}@local, on the 1{i}.2.3.4") for i in range(10)] + awkward()
    few = sorted(map(repr, answer(spark, tmp_path, rows, "few")))
    monkeypatch.setattr(pii, "FEW", 0)
    assert sorted(map(repr, answer(spark, tmp_path, rows, "many"))) == few
    assert any("phone:17:29" in r for r in few)


def test_empty_table(spark, tmp_path):
    assert answer(spark, tmp_path, [], "none") == []


def test_discovered_identifiers_induce(spark, tmp_path):
    rows = [(i, f"My phone number: +1 (555) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(100 + i, f"my phone number: 555-{100 + i}-1234") for i in range(5)]
    rows += [(200 + i, f"please call 555-{100 + i}-1234") for i in range(5)]  # values known only by discovery
    rows += [(300, "please call 555-777-9999"), (301, "it was a 555-777-9998")]
    got = {r.doc_id: r.spans for r in answer(spark, tmp_path, rows, "again")}
    assert got[200] == got[300] == "phone:12:24" and got[301] == ""


def test_many_hits_in_one_text_are_linear(spark, tmp_path):
    rows = [(i, f"My phone number: +1 (555) 555-{1000 + i} thanks") for i in range(12)]
    some = [f"my phone number: {'+1 ' * (i % 3 > 0)}555-{i}-123" for i in range(10_000, 40_000)]
    rows += [(100, " ".join(some))]
    got = {r.doc_id: r.spans for r in answer(spark, tmp_path, rows, "hits")}
    at, want = 0, []
    for x in some:
        want.append(f"phone:{at + 17}:{at + len(x)}")
        at += len(x) + 1
    assert got[100].split(",") == want


def test_far_words_and_further_columns(spark, tmp_path):
    long = "w" * 300
    rows = [(i, f"{long} number: +1 (555) 555-{1000 + i} thanks", "en", "s", 1, "a", None, "b") for i in range(4)] + [(10, f"{long} number: 555-100-1234", None, None, None, None, "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, hits string, words string")
    frame.write.parquet(str(tmp_path / "far" / "documents.parquet"))
    got = {r.doc_id: r.spans for r in pii.op7_personal_data(spark, str(tmp_path / "far")).collect()}
    assert got[10] == "phone:309:321"
