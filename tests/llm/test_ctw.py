"""Context-tree weighting against the textbook recursion, bit by bit."""

import collections
import math
import zlib

import numpy as np
import pytest

from grainspan.llm import ctw

from .helpers import awkward, docs, prose, words


def brute_model(texts, depth):
    """Counts of (context, node) for all depths, in dictionaries."""
    counts = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        raw = bytes([255]) * depth + t + b"\xff"
        for i in range(depth, len(raw)):
            for level in range(8):
                node, bit = (1 << level) | (raw[i] >> (8 - level)), (raw[i] >> (7 - level)) & 1
                for d in range(depth + 1):
                    counts[raw[i - d : i], node][bit] += 1
    return counts


def brute_score(text, counts, depth):
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    children = collections.defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append((context, node))
    memo = {}

    def log_pw(key):
        if key not in memo:
            pe = kt(*counts[key])
            memo[key] = pe if len(key[0]) == depth else np.logaddexp(pe, sum(log_pw(c) for c in children[key])) - math.log(2)
        return memo[key]

    total = 0.0
    raw = bytes([255]) * depth + text + b"\xff"
    for i in range(depth, len(raw)):
        for level in range(8):
            node, bit = (1 << level) | (raw[i] >> (8 - level)), (raw[i] >> (7 - level)) & 1
            left, p, last = 1.0, 0.0, 0.5
            for d in range(depth + 1):
                key = (raw[i - d : i], node)
                if key not in counts:
                    break
                zeros, ones = counts[key]
                last = (ones + 0.5) / (zeros + ones + 1)
                stop = 1.0 if d == depth else math.exp(kt(zeros, ones) - math.log(2) - log_pw(key))
                p, left = p + left * stop * last, left * (1 - stop)
            p += left * last
            total += math.log10(p if bit else 1 - p)
    return total


def texts_of(rows):
    return [(t or "").lower().encode() for _, t in rows]


ROWS = [(i, " ".join(prose(25, i, 30)).title()) for i in range(40)] + [(100, None), (101, ""), (102, "naïve \U0001f600"), (3, "again again"), (None, "no id")]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("limit", [10**7, 3000, 200])
def test_brute_force(spark, limit):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ctw.scored(docs(spark, ROWS), limit).collect()), key=lambda r: (repr(r[0]), r[2]))
    train = [(i, t) for i, t in ROWS if not held(i)]
    counts = brute_model(texts_of(train), ctw.DEPTH)
    tokens = collections.Counter(w for _, t in train for w in [*words(t), None])
    n, v = sum(tokens.values()), len(tokens)
    want = []
    for i, t in ROWS:
        ws = [*words(t), None]
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in ws)
        want.append((i, held(i), len(ws), sum(tokens[w] > 0 for w in ws), n, base, brute_score((t or "").lower().encode(), counts, ctw.DEPTH)))
    want.sort(key=lambda r: (repr(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5)


def test_distribution_is_proper(spark):
    data = np.frombuffer(b"the cat sat on the mat and the rat", np.uint8)
    keys, n = ctw.count_sorted(ctw.grams(data, np.array([0, data.size]))[0])
    tree = ctw.Tree(keys, n, 2)
    import pandas as pd

    ones = pd.DataFrame({"node": ctw._parent(tree.node[2], 2).astype(np.int64), "zeros": tree.zeros[2], "ones": tree.ones[2], "log_children": tree.log_pw[2]}).groupby("node", as_index=False).sum()
    top = ctw.Top(ones)
    mixed = tree.mixtures(*top.above(tree.node[2]))

    def sort(d):
        k = ctw.turn(tree.node[d], d)
        order = np.argsort(k)
        return k[order], mixed[d][order]

    gram = ctw.turn(keys, ctw.DEPTH)
    order = np.argsort(gram)
    model = ctw.Model(gram[order], ctw.byte_cost(keys, tree.node[ctw.DEPTH], mixed[ctw.DEPTH])[order], [(top.node0, top.p0), (top.node1, top.p1), *(sort(d) for d in range(2, ctw.DEPTH + 1))])
    for context in (b"\xff\xff\xff\xff\xff", b"n the", b"zzzzz", b"xx th"):
        every = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        turned = np.sort(ctw.turn(every, ctw.DEPTH))
        assert (10 ** model.costs(turned)).sum() == pytest.approx(1, abs=1e-9)


def test_turning_is_undone():
    x = np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64)
    assert (ctw.turn_back(ctw.turn(x, 5), 5) == x).all() and np.unique(ctw.turn(x, 5)).size == np.unique(x).size


def test_awkward_and_empty_tables(spark):
    rows = ctw.scored(docs(spark, awkward())).collect()
    assert len(rows) == len(awkward()) and all(r.score < 0 and r.base_score <= 0 for r in rows)
    assert ctw.scored(docs(spark, [])).count() == 0
    only = next(i for i in range(100) if held(i))
    r = ctw.scored(docs(spark, [(only, "ab")])).first()  # nothing to learn from
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-24 * math.log10(2))


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 100.5, 1e6 + 0.5])
    np.testing.assert_allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
