"""Decontamination against a search for each window."""

import hashlib
import random
import re

import pytest

from grainspan.llm import decontaminate

from .helpers import LOW, awkward, docs, prose


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, items):
    w = norm(text)
    hit, found = set(), set()
    for item, t in items:
        b = norm(t)
        n = min(10, len(b))
        for i in range(len(b) - n + 1) if b else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), sorted(hit), sorted(found)


def tables(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(prose(rng.choice([0, 1, 3, 10, 15, 30]), seed * 50 + k, 40))) for k in range(12)]
    items += [(100, items[3][1]), (101, None), (102, ""), (None, " ".join(prose(12, 7, 40))), (10, "Some, Text! it's"), (5, items[5][1])]
    rows = awkward()
    for k in range(40):
        w = prose(rng.randint(0, 60), k, 40)
        for _ in range(2):
            part = (rng.choice(items)[1] or "").split()
            w[rng.randint(0, len(w)) : 0] = part[: rng.randint(0, len(part))]
        rows.append((200 + k, ("  " if k % 2 else ", ").join(w).upper() if k % 3 else " ".join(w)))
    return rows, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [1 << 22, 200])
def test_brute_force(spark, seed, limit):
    rows, items = tables(seed)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hit string")
    out = decontaminate.contamination(docs(spark, rows), bench, limit)
    got = sorted(((r.doc_id, r.n_words, r.hit, r["items"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, *brute(t, items)) for i, t in rows), key=repr)
    kept = sorted((r.doc_id for r in decontaminate.clean(docs(spark, rows), bench).collect()), key=repr)
    assert kept == sorted((i for i, t in rows if not brute(t, items)[1]), key=repr)


def test_spans_in_the_original():
    machine = decontaminate.automaton({p: frozenset({"1"}) for p in decontaminate.windows("The Quick  café-fox")})
    text = "éé! the QUICK, café; (fox)... end"
    n, hit, items = decontaminate.find(text, machine)
    assert (n, hit.tolist(), items) == (6, [1, 2, 3, 4], {"1"})
    words = [x for p in decontaminate.original_words(text, hit) for x in p]
    hits, (a, b) = decontaminate.in_runs(hit.tolist(), words)
    assert hits == [1, 2, 3, 4] and text[a:b] == "the QUICK, café; (fox"


def test_spans_do_not_depend_on_the_number_of_automata(spark):
    rows, items = tables(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(spark, rows).withColumnRenamed("lang", "row").withColumnRenamed("source", "hit").withColumnRenamed("n_chars", "k")
    answers = []
    for limit in (1 << 22, 200):
        out = decontaminate.contamination(frame, bench, limit, spans=True).collect()
        answers.append(sorted(((r.doc_id, r.hit, r["items"], r.spans) for r in out), key=repr))
        assert decontaminate.clean(frame, bench).columns == frame.columns
    assert answers[0] == answers[1] and any(len(a[3]) > 2 for a in answers[0])
    texts = dict(rows)
    for i, hit, _, spans in answers[0]:
        if i is not None and i >= 200:
            inside = [w for a, b in zip(spans[::2], spans[1::2], strict=True) for w in norm(texts[i][a:b])]
            assert inside == [norm(texts[i])[k] for k in hit]


def test_digest(spark, tmp_path):
    docs(spark, [(1, "a b"), (2, "c")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, "B"), (9, "a"), (8, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: r for r in decontaminate.op10_decontaminate(spark, str(tmp_path)).collect()}
    assert rows[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and rows[1].contaminated and rows[1].n_items == 2
    assert rows[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not rows[2].contaminated


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), none).count() == 0
    assert all(not r.hit for r in decontaminate.contamination(docs(spark, awkward()), none).collect())
