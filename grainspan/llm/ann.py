"""Approximate nearest neighbours by additive quantisation.

A vector, at unit length, is approximated by the sum of one full-dimensional codeword from each of
``BOOKS`` codebooks. Books start as k-means on residuals and are then fitted together: codes by beam search,
books by least squares, in turns. They are learnt from at most ``SAMPLE`` vectors (those with the smallest
hash of vec_id); every vector is encoded by beam search and kept with the norm of its approximation.

A search takes the queries in blocks of about ``QUERIES``. A block is broadcast; each batch of the index sums
look-up tables of query-codeword products over its codes, divides by the stored norms, and reranks the best
``SHARE`` of the batch (at least ``LEAST``, all ties included) by the exact cosine of the original vectors in
double precision. Each task keeps the nearest few of each query, and these lists are merged by query. The
rerank share counts by batch, so recall does not fall as data grow; ``share=1`` is an exact search.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length
than most, take no part as query or candidate; a null vec_id takes no part; a query's own row is every row with
its vec_id; repeated rows are each a candidate; ties go to the smaller vec_id; further columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, table

BOOKS = 16
WORDS = 128
BEAM = 6
SAMPLE = 8192
ROUNDS = 2
QUERIES = 4096
SHARE = 0.04
LEAST = 128
NEAREST = 5


def _square(a: np.ndarray) -> np.ndarray:
    return np.einsum("...d,...d->...", a, a)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) with small error, by beam search book after book."""
    n, d = x.shape
    m, k, _ = books.shape
    out = np.empty((n, m), np.int32)
    for a in range(0, n, 512):
        part = x[a : a + 512]
        rows = np.arange(len(part))[:, None]
        rest, codes = part[:, None, :], np.zeros((len(part), 1, 0), np.int32)
        error = _square(part)[:, None]
        for book in books:
            cost = error[:, :, None] - 2 * rest @ book.T + _square(book)
            flat = cost.reshape(len(part), -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            error = np.take_along_axis(flat, best, 1)
            of, word = best // k, best % k
            rest = rest[rows, of] - book[word]
            codes = np.concatenate([codes[rows, of], word[:, :, None].astype(np.int32)], 2)
        out[a : a + 512] = codes[rows[:, 0], error.argmin(1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), books.shape[2]), books.dtype)
    for m in range(codes.shape[1]):
        out += books[m][codes[:, m]]
    return out


def learn(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Codebooks (books, words, dimensions) for unit vectors."""
    rng = np.random.default_rng(seed)
    words = min(words, max(1, len(x)))
    out, rest = [], x.copy()
    for _ in range(books):
        centre = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(8):
            near = (_square(centre) - 2 * rest @ centre.T).argmin(1)
            order = np.argsort(near, kind="stable")
            first = np.flatnonzero(np.diff(near[order], prepend=-1))
            total = np.zeros_like(centre)
            total[near[order][first]] = np.add.reduceat(rest[order], first, axis=0)
            count = np.bincount(near, minlength=words)
            centre[count > 0] = total[count > 0] / count[count > 0, None]
            empty = np.flatnonzero(count == 0)
            centre[empty] = rest[rng.choice(len(rest), empty.size)]
        near = (_square(centre) - 2 * rest @ centre.T).argmin(1)
        rest -= centre[near]
        out.append(centre)
    found = np.stack(out)
    for _ in range(rounds):
        codes = encode(x, found)
        used = np.zeros((len(x), books * words), np.float32)
        used[np.arange(len(x))[:, None], codes + np.arange(books) * words] = 1
        gram, right = (used.T @ used).astype(np.float64), (used.T @ x).astype(np.float64)
        old = found.reshape(-1, x.shape[1]).astype(np.float64)
        ridge = 0.5  # keeps unused words where they were
        found = np.linalg.solve(gram + ridge * np.eye(len(gram)), right + ridge * old).reshape(found.shape).astype(x.dtype)
    return found


def _vectors(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt(_square(x))[:, None]).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    sound = F.forall("embedding", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & F.exists("embedding", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & sound)
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("embedding") == top[0]["d"]) if top else rows.filter("false")


def index(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray | None]:
    """The index (vec_id, embedding, codes, norm) of all rows of ``usable`` vectors, and the codebooks."""
    ids = rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    ids = F.broadcast(Scratch(rows.sparkSession, "sample").save(ids.distinct()))  # at most ``sample`` ids
    some = rows.join(ids, "vec_id", "left_semi").limit(sample).select("embedding").toPandas()
    kind = rows.schema["embedding"].dataType.simpleString()
    if not len(some):
        return rows.select("vec_id", "embedding", F.lit(b"").alias("codes"), F.lit(1.0).alias("norm")), None
    books = learn(_unit(np.array(some["embedding"].tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = encode(_unit(_vectors(batch.column(1))), books)
            norm = np.sqrt(_square(decode(codes, books).astype(np.float64)))
            packed = codes.astype(np.uint8 if len(books[0]) <= 256 else np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(np.maximum(norm, 1e-12))], ["vec_id", "embedding", "codes", "norm"]
            )

    return rows.mapInArrow(run, f"vec_id long, embedding {kind}, codes binary, norm double"), books


def _nearer(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search_block(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, books: np.ndarray, share: float, k: int) -> Iterator[pa.RecordBatch]:
    unit = _unit(q)
    tables = np.einsum("qd,mkd->mqk", unit, books, optimize=True).astype(np.float32)
    q = q.astype(np.float64)
    q_norm = np.sqrt((q * q).sum(1))
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
    for batch in batches:
        vec = batch.column(0).to_numpy()
        x = np.ascontiguousarray(_vectors(batch.column(1)), np.float64)
        x_norm = np.sqrt((x * x).sum(1))
        codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(vec), -1)
        norm = batch.column(3).to_numpy().astype(np.float32)
        keep = min(len(vec), max(LEAST, int(np.ceil(share * len(vec)))))
        for a in range(0, len(ids), 256):
            guess = np.zeros((min(256, len(ids) - a), len(vec)), np.float32)
            for m in range(codes.shape[1]):
                guess += tables[m, a : a + 256][:, codes[:, m]]
            guess /= norm
            bar = np.partition(guess, len(vec) - keep, axis=1)[:, len(vec) - keep]
            for i in range(len(guess)):
                at = np.flatnonzero(guess[i] >= bar[i])
                at = at[vec[at] != ids[a + i]]
                exact = (x[at] * q[a + i]).sum(1) / (x_norm[at] * q_norm[a + i])
                old = best[a + i]
                who, how = np.concatenate([old[0], vec[at]]), np.concatenate([old[1], exact])
                if len(who) > 64:  # ties of the last place stay until ids decide
                    last = np.partition(how, len(how) - k)[len(how) - k]
                    who, how = who[how >= last], how[how >= last]
                top = _nearer(who, how, k)
                best[a + i] = (who[top], how[top])
    sizes = [len(w) for w, _ in best]
    if sum(sizes):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([w for w, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "vec_id", "score"]
        )


def search(indexed: DataFrame, books: np.ndarray | None, queries: DataFrame, share: float = SHARE, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows of the index for each row of ``queries``."""
    spark = indexed.sparkSession
    out_type = "query_id long, vec_id long, score double"
    n = queries.count()
    found = spark.createDataFrame([], out_type)
    blocks = -(-n // QUERIES)
    scratch = Scratch(spark, "ann")
    for b in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).dropDuplicates().toPandas()  # about QUERIES rows
        if not len(mine):
            continue
        shared = spark.sparkContext.broadcast((mine["vec_id"].to_numpy(), np.array(mine["embedding"].tolist()), books))
        part = scratch.save(
            indexed.select("vec_id", "embedding", "codes", "norm").mapInArrow(lambda it, shared=shared: _search_block(it, *shared.value, share, k), out_type)
        )
        found = found.unionByName(part)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every embedding whose vec_id is divisible by 50."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    indexed, books = index(rows)
    indexed = Scratch(spark, "index").save(indexed)
    return search(indexed, books, rows.filter("vec_id % 50 = 0"))
