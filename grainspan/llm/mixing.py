"""Mixing to target weights by soft membership.

1. A classifier learns domains from a labelled table: logistic regression on which hashed words and word
   beginnings a text has. The domains are plain, low (of low quality) and toxic. It learns on at most ``LABELLED`` labelled rows (those
   with the smallest hash of doc_id) whose crc32(doc_id as text) mod 4 is not 2; buckets that fewer than ``LEAST_ROWS`` of them have, or that no
   domain has far more or less often than chance, are left out: they are counted in the cluster, and the driver gets the rest only.
2. One scan gives every whole document its tokens (words) and its posterior for each domain.
3. Each document d gets a rate r_d >= 0, the expected number of its copies, by projected-gradient least squares on

       sum over domains k of (sum over d of r_d * share_d * p_dk  -  budget * target_k) ** 2

   from r = 1, with momentum, in the metric of token shares; rates also stay at or below ``MOST`` where that is set. A document's step is
   divided by the sum over domains of p_dk * (share of k in all tokens), which bounds the curvature, so the rates of a rare domain
   move as fast as those of a frequent one. Steps end when every residual, or its change in ``STILL`` steps in a row, is below
   ``CLOSE`` of its own domain's share. Rates in a step follow from the document's
   posterior and the residuals of the steps before, so a step is one pass over the small table of tokens and posteriors
   that adds up one number a domain, and what the driver keeps is steps * domains numbers. The budget defaults to
   the most that needs no domain upsampled. A target below what the least likely documents of a domain already hold of it cannot be met;
   the largest residual that is left, relative to its domain's budget, is returned with the rates, and over ``TOLERANCE`` it is warned of.
4. A rate becomes copies: it is rounded up with the chance of its fraction, by a hash of doc_id, and else down, so that
   expected totals stay for every rate. ``achieved`` gives each domain's share before, its target, and its expected and its realised share.

Defined results: null or empty texts have no tokens, the posterior of a text without words, and the rate that follows
from it; repeated rows are treated alike; a label that is null or whose document is missing is not learnt from; without
labels of two domains, posteriors are the labels' shares (even, if there are none); an empty table gives
an empty result; further columns are passed by (``mixed`` keeps them).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import bucket
from .scratch import Scratch, table
from .textkit import LOWER, mix, runs, span_hashes, word_bounds

#: Domains by the labelled table's columns, and the weights of their tokens that are asked for.
DOMAINS = ("plain", "low", "toxic")
DOMAIN = "CASE WHEN toxic = 1 THEN 2 WHEN toxic = 0 THEN 1 - quality END"
TARGETS = (0.88, 0.06, 0.06)
#: Of a corpus that has passed a quality filter: plain and toxic documents only.
FILTERED_DOMAIN, FILTERED_TARGETS = "toxic", (0.99, 0.01)
LABELLED = 6000
LEAST_ROWS = 5
BUCKET_BITS = 20
PREFIXES = (4, 5)
PENALTY = 0.3
#: Deviations from chance that make a bucket worth keeping.
SURE = 3.5
#: Rates are kept from 0 to this, so that no document is repeated; None sets no bound.
MOST: float | None = 1.0
#: A guard against endless runs, with a warning; steps end by ``CLOSE``.
STEPS = 1000
CLOSE = 1e-4
STILL = 3
KEPT = 25
TOLERANCE = 0.02


def hashed(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of the distinct features of documents (those of ``mask`` only), and the words of each."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets)
    every_row, every_bucket = [], []
    for k, size in enumerate((0, *PREFIXES)):
        use = slice(None) if not size else np.flatnonzero(ends - starts > size)
        s = starts[use]
        h = span_hashes(data, s, ends[use] if not size else s + size)
        b = (mix(h + np.uint64(k)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        r = rows[use]
        if mask is not None:
            good = mask[b]
            b, r = b[good], r[good]
        every_row.append(r)
        every_bucket.append(b)
    key = np.sort((np.concatenate(every_row) << BUCKET_BITS) | np.concatenate(every_bucket))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if key.size else key
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), np.bincount(rows, minlength=n)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Classifier:
    """Posteriors of the domains from the distinct features of a text."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights.astype(np.float32), bias
        self.mask = np.abs(self.weights).max(1) > 1e-4

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, buckets, words = hashed(data, offsets, self.mask)
        n = len(offsets) - 1
        z = np.stack([np.bincount(rows, self.weights[buckets, k], minlength=n) for k in range(len(self.bias))], 1)
        return words, softmax(z + self.bias)


def fit(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, domains: int = len(DOMAINS)) -> Classifier:
    """Multinomial logistic regression, by gradient steps of adaptive size."""
    size = 1 << BUCKET_BITS
    n = len(labels)
    shares = np.bincount(labels, minlength=domains) / n if n else np.full(domains, 1 / domains)
    if not n or (shares > 0).sum() < 2:
        return Classifier(np.zeros((size, domains)), np.log(np.maximum(shares, 1e-12)))
    used, at = np.unique(buckets, return_inverse=True)
    want = np.eye(domains)[labels]
    w, bias = np.zeros((used.size, domains)), np.log(np.maximum(shares, 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 61):
        z = np.stack([np.bincount(rows, w[at, k], minlength=n) for k in range(domains)], 1) + bias
        error = softmax(z) - want
        g = np.stack([np.bincount(at, error[rows, k], minlength=used.size) for k in range(domains)], 1) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3 * n)
        bias -= 0.5 * error.mean(0)
    full = np.zeros((size, domains))
    full[used] = w
    return Classifier(full, bias)


def telling(found: DataFrame, sizes: list[int]) -> np.ndarray:
    """Buckets of ``found`` (domain, buckets) that LEAST_ROWS rows have and some domain has far more or less often than chance
    would let all rows share them. ``sizes`` are the domains' rows."""
    domains, n = len(sizes), sum(sizes)
    names = [f"n{k}" for k in range(domains)]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BUCKET_BITS, domains), np.int64)
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[np.frombuffer(x.as_buffer(), np.int32), k] += 1
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(domains))], ["bucket", *names])

    seen = found.mapInArrow(tally, ", ".join(f"{c} long" for c in ("bucket", *names))).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names))
    every = sum(F.col(c) for c in names)
    far = F.lit(False)
    for c, size in zip(names, sizes, strict=True):
        due = every * F.lit(size / n)
        far = far | ((F.abs(F.col(c) - due) - 0.5) / F.sqrt(due * F.lit(1 - size / n) * (1 - every / F.lit(n)) + 0.25) > SURE)
    return np.array([r.bucket for r in seen.filter((every >= LEAST_ROWS) & far).select("bucket").toLocalIterator()], np.int64)  # at most 2 ** BUCKET_BITS


def learn(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN, domains: int = len(DOMAINS), limit: int = LABELLED) -> Classifier:
    """A classifier from the labelled rows of ``docs``; ``domain`` is the number of a labelled row's domain, in SQL."""
    scratch = Scratch(docs.sparkSession, "labelled")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(domain).cast("int").alias("domain"))
    marked = marked.filter(F.col("domain").between(0, domains - 1) & (bucket(F.col("doc_id"), 4) != 2) & F.col("doc_id").isNotNull())
    chosen = scratch.save(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in runs(batch.column(1)):
                rows, buckets, _ = hashed(data, offsets)
                parts = np.split(buckets.astype(np.int32), np.searchsorted(rows, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([p.tobytes() for p in parts], pa.binary())], ["domain", "buckets"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` ids
    found = scratch.save(texts.select("domain", "text").mapInArrow(run, "domain int, buckets binary"))
    sizes = [0] * domains
    for r in found.groupBy("domain").count().collect():
        sizes[r.domain] = r["count"]
    kept = telling(found, sizes) if sum(x > 0 for x in sizes) > 1 else np.zeros(0, np.int64)
    mask = np.zeros(1 << BUCKET_BITS, bool)
    mask[kept] = True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[mask[x]].tobytes() for x in every], pa.binary())], ["domain", "buckets"])

    parts, labelled = [], []
    for r in found.mapInArrow(pick, "domain int, buckets binary").toLocalIterator():
        parts.append(np.frombuffer(r.buckets, np.int32))
        labelled.append(r.domain)
    scratch.clear()
    rows = np.repeat(np.arange(len(parts)), [p.size for p in parts])
    return fit(rows, np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int64), np.array(labelled, np.int64), domains)


State = tuple[np.ndarray, np.ndarray, float, float]


def advance(p: np.ndarray, residuals: list[np.ndarray], step: float, most: float | None, state: State | None = None) -> State:
    """Rates, the point of the next residual, momentum and last error after ``residuals``, from ``state`` or from r = 1.

    A residual is (2, domains): the error of each domain, and the share of tokens that the domain has at r = 1.
    """
    r, y, t, last = state or (np.ones(len(p)), np.ones(len(p)), 1.0, np.inf)
    for e, share in residuals:
        scale = p @ share
        new = np.clip(y - step * np.divide(p @ e, scale, out=np.zeros(len(p)), where=scale > 0), 0.0, most)
        if e @ e > last:
            t = 1.0  # the momentum overshot
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.clip(new + (t - 1) / t_new * (new - r), 0.0, most)
        r, t, last = new, t_new, float(e @ e)
    return r, y, t, last


def rates(p: np.ndarray, residuals: list[np.ndarray], step: float, most: float | None = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps so far, and the point where the next residual is to be taken."""
    return advance(p, residuals, step, most)[:2]


def solve(weighted: DataFrame, targets: tuple[float, ...], budget: float | None = None, most: float | None = MOST) -> tuple[list[np.ndarray], float]:
    """Residuals of the steps, and the step size, for ``weighted`` (tokens, p); see ``solved``."""
    return solved(weighted, targets, budget, most)[:2]


def solved(weighted: DataFrame, targets: tuple[float, ...], budget: float | None = None, most: float | None = MOST) -> tuple[list[np.ndarray], float, float]:
    """Residuals of the steps, the step size, and the largest residual in the end relative to its domain's budget (to the
    whole budget where the target is 0), for ``weighted`` (tokens, p), a table that is read once a step.

    Every ``KEPT`` steps r and y are written down, so that a step repeats at most that many.
    """
    k = len(targets)
    want = np.array(targets, np.float64)
    want = want / want.sum()
    scratch = Scratch(weighted.sparkSession, "rates")
    step = 1.0
    residuals: list[np.ndarray] = []
    rows = weighted.select("tokens", "p", F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    kept, t, last = 0, 1.0, np.inf

    def states(batch: pa.RecordBatch) -> tuple[np.ndarray, State]:
        p = batch.column(1).flatten().to_numpy().reshape(-1, k)
        return p, advance(p, residuals[kept:], step, most, (batch.column(2).to_numpy(), batch.column(3).to_numpy(), t, last))

    def sums() -> tuple[np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + 1)
            for batch in batches:
                tokens = batch.column(0).to_numpy().astype(np.float64)
                p, state = states(batch)
                total[:k] += (tokens * state[1]) @ p
                total[k] += tokens.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], ["i", "v"])

        got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(k + 1)
        for r in got:
            out[r.i] = r.v
        return out[:k], out[k]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, state = states(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(state[0]), pa.array(state[1])], ["tokens", "p", "r", "y"])

    now, total = sums()
    if not total:
        return [], step, 0.0
    share = now / total
    if budget is None:
        budget = float(min(share[want > 0] / want[want > 0]))
    seen, still = None, 0
    while len(residuals) < STEPS:
        e = now / total - budget * want
        part = np.divide(e, share, out=np.zeros(k), where=share > 0)
        still = still + 1 if seen is not None and np.abs(part - seen).max() < CLOSE else 0
        if still == STILL or np.abs(part).max() < CLOSE:
            break
        seen = part
        residuals.append(np.stack([e, share]))
        if len(residuals) - kept == KEPT:
            fresh = scratch.save(rows.mapInArrow(write, "tokens long, p array<double>, r double, y double"))
            _, _, t, last = advance(np.zeros((0, k)), residuals[kept:], step, most, (np.zeros(0), np.zeros(0), t, last))
            if kept:
                scratch.drop(rows)
            rows, kept = fresh, len(residuals)
        now, _ = sums()
    else:
        warnings.warn(f"op4: rates still changed after {STEPS} steps", stacklevel=2)
    scratch.clear()
    left = float(np.max(np.abs(now / total - budget * want) / np.where(want > 0, budget * want, budget))) if budget > 0 else 0.0
    if left > TOLERANCE:
        warnings.warn(f"op4: the targets cannot be met; the largest residual is {left:.3f} of its domain's budget", stacklevel=2)
    return residuals, step, left


def copies(doc_id: pa.Array, rate: np.ndarray) -> np.ndarray:
    """Whole numbers of copies, whose expectation over ids is the rate."""
    ids = np.array([hash_id(x) for x in doc_id.to_pylist()], np.uint64)
    up = (mix(ids) >> np.uint64(11)).astype(np.float64) / 2**53 < rate - np.floor(rate)
    return (np.floor(rate) + up).astype(np.int64)


def hash_id(x: int | None) -> int:
    return 0 if x is None else (int(x) * 0x9E3779B97F4A7C15 + 1) % 2**64


class Mix:
    """A classifier, the rates it leads to, and the relative residual that they leave."""

    def __init__(self, classifier: Classifier, residuals: list[np.ndarray], step: float, left: float, most: float | None):
        self.classifier, self.residuals, self.step, self.left, self.most = classifier, residuals, step, left, most

    def rates(self, p: np.ndarray) -> np.ndarray:
        return rates(p, self.residuals, self.step, self.most)[0]


def plan(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, budget: float | None = None, most: float | None = MOST, domain: str = DOMAIN) -> tuple[Mix, DataFrame]:
    """The mix for ``docs``, and doc_id, tokens and p of each row."""
    classifier = learn(docs, labels, domain, len(targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in runs(batch.column(1)):
                words, p = classifier.posteriors(data, offsets)
                where = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(where, pa.array(p.ravel()))], ["doc_id", "tokens", "p"]
                )

    soft = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long, p array<double>")
    soft = Scratch(docs.sparkSession, "mixing").save(soft)
    return Mix(classifier, *solved(soft, targets, budget, most), most), soft


def rated(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, budget: float | None = None, most: float | None = MOST, domain: str = DOMAIN) -> DataFrame:
    """doc_id, n_tokens, p (by domain), rate and copies of each row of ``docs``, and the residual, one for all."""
    made, soft = plan(docs, labels, targets, budget, most, domain)
    k = len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = made.rates(batch.column(2).flatten().to_numpy().reshape(-1, k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(copies(batch.column(0), r))], ["doc_id", "n_tokens", "p", "rate", "copies"])

    return soft.mapInArrow(run, "doc_id long, n_tokens long, p array<double>, rate double, copies long").withColumn("residual", F.lit(made.left))


def achieved(mix: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """domain, before, target, expected and realised: shares of tokens, for the rows of ``rated``."""
    k = len(targets)
    of = lambda by: [F.sum(F.col("n_tokens") * F.col("p")[i] * by).alias(f"x{i}") for i in range(k)]
    parts = [mix.agg(*of(by)).select(F.lit(name).alias("what"), F.posexplode(F.array(*[F.col(f"x{i}") / sum(F.col(f"x{j}") for j in range(k)) for i in range(k)])).alias("domain", "share")) for name, by in (("before", F.lit(1.0)), ("expected", F.col("rate")), ("realised", F.col("copies")))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    wide = every.groupBy("domain").agg(*(F.max(F.when(F.col("what") == c, F.col("share"))).alias(c) for c in ("before", "expected", "realised")))
    return wide.withColumn("target", F.element_at(F.array(*[F.lit(t / sum(targets)) for t in targets]), F.col("domain") + 1))


def mixed(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, budget: float | None = None, most: float | None = MOST, domain: str = DOMAIN) -> DataFrame:
    """Each document as often as its rate says, all columns as they were. Texts stay where they are."""
    made, _ = plan(docs, labels, targets, budget, most, domain)
    text, doc_id = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = []
            for a, b, data, offsets in runs(batch.column(text)):
                _, p = made.classifier.posteriors(data, offsets)
                times.append(copies(batch.column(doc_id).slice(a, b - a), made.rates(p)))
            if times:
                yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), np.concatenate(times))))

    return docs.mapInArrow(run, docs.schema)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rates and copies of all documents."""
    out = rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies", "residual")
