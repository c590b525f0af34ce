"""Near-duplicates against all pairs, by brute force."""

import random

import numpy as np
import pytest

from grainspan.llm import neardup
from grainspan.llm.components import connected
from grainspan.llm.scratch import Scratch
from grainspan.llm.textkit import shingle_sets

from .helpers import awkward, docs, prose, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] == sets[j]
            if sets[i] and sets[j] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common) or same_id:
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [doc]
        out.append((doc, len(sets[i]), min(ids, default=None) if ids else None))
    return sorted(out, key=repr)


def answer(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=repr)


def family(base, n, changes, seed, start):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
        out.append((start + k, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed):
    rows = []
    for k in range(6):
        rows += family(prose(random.Random(seed + k).randint(3, 200), seed * 100 + k, 5000), 25, 4, seed * 7 + k, 1000 * k)
    passage = prose(60, 99, 5000)  # shared by texts that are otherwise different
    rows += [(9000 + k, " ".join(prose(80, 500 + k, 5000) + passage)) for k in range(30)]
    assert answer(neardup.near_duplicates(docs(spark, rows))) == brute(rows)


def test_chain(spark):
    """Neighbours are linked, ends are not: one component all the same."""
    base = prose(300, 5, 9000)
    rows, w = [], list(base)
    for k in range(12):
        rows.append((50 - k, " ".join(w)))
        w[k * 20] = f"z{k}"
    got = answer(neardup.near_duplicates(docs(spark, rows)))
    assert got == brute(rows) and {c for _, _, c in got} == {39}


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = family(prose(120, 8, 9000), 90, 6, 3, 0) + family(prose(120, 8, 9000), 40, 1, 4, 500)
    assert answer(neardup.near_duplicates(docs(spark, rows))) == brute(rows)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", -1)
    rows = family(prose(50, 1), 8, 1, 1, 0) + [(100, "all alone here")]
    assert answer(neardup.near_duplicates(docs(spark, rows))) == brute(rows)
    assert sorted(r.doc_id for r in neardup.one_of_each(docs(spark, rows)).collect()) == sorted({c for _, _, c in brute(rows)})


def test_awkward_rows(spark):
    rows = awkward()
    frame = docs(spark, rows).withColumnRenamed("n_chars", "component_id").withColumnRenamed("lang", "fp").withColumnRenamed("source", "rep")
    assert answer(neardup.near_duplicates(frame)) == brute(rows)
    kept = neardup.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]  # the row without an id is a copy of 4


def test_rows_that_share_an_id_but_not_their_text(spark):
    base = prose(60, 3, 9000)
    texts = [" ".join(base), " ".join(prose(60, 4, 9000)), "quite another text here", None, "", " ".join(base[:-1]), "with no id", "with no id", "nor this one"]
    ids = [5, 5, 5, 5, 5, 3, None, None, None]
    rows = list(zip(ids, texts, strict=True))
    # the first is a near-duplicate of 3's only text, and goes; of the rest only the repeated row does
    want = sorted([*rows[1:6], rows[6], rows[8]], key=repr)
    got = sorted(((r.doc_id, r.text) for r in neardup.one_of_each(docs(spark, rows)).collect()), key=repr)
    assert got == want
    again = rows + [(5, texts[1]), (7, texts[1])]
    assert sorted(((r.doc_id, r.text) for r in neardup.one_of_each(docs(spark, again)).collect()), key=repr) == want


def test_links_do_not_depend_on_which_text_of_an_id_comes_first(spark):
    a, b = prose(100, 11, 9000), prose(100, 12, 9000)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-2])), (3, " ".join(b[:-2]))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(1, 96, 1), (2, 94, 1), (3, 94, 1)}


def test_recall_at_the_threshold(spark):
    """Pairs of similarity just over 0.85, each on its own: none is missed."""
    rows = []
    for k in range(300):
        w = prose(220, 1000 + k, 10**6)
        v = list(w)
        for at in (20, 70, 120)[: 2 + k % 2]:  # five shingles each: 0.91 or 0.87
            v[at] = f"other{k}"
        v = v if k % 2 else v[:-8]  # 0.88 ... 0.87
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    linked = [k for k in range(300) if 100 * len(shingles(rows[2 * k][1]) & shingles(rows[2 * k + 1][1])) >= 85 * len(shingles(rows[2 * k][1]) | shingles(rows[2 * k + 1][1]))]
    assert len(linked) == 300 and all(got[2 * k + 1] == 2 * k for k in linked)


def test_empty_table(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert neardup.one_of_each(docs(spark, [])).count() == 0


def test_hashes_do_not_depend_on_place():
    texts = [b"a b c d e f g", b"zz a b c d e f g", b"one", b""]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sets = shingle_sets(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert [s.size for s in sets] == [3, 4, 1, 0] and set(sets[0]) <= set(sets[1])
    sig = neardup.signature(sets[:3])
    assert sig.shape == (3, 64) and 20 < (sig[0] == sig[1]).sum() < 64 and not (sig[0] == sig[2]).any()


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)]
    frame = connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.component for r in frame.collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
