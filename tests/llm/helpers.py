"""Small tables with awkward rows, and brute-force answers."""

import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def docs(spark, rows, schema=DOCS):
    """Rows of (doc_id, text), or of all columns."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) if len(r) == 2 else r for r in rows for i, t in [r[:2]]]
    return spark.createDataFrame(full, schema)


def awkward():
    """Nulls, empty and blank texts, ties, repeated rows, one long word and a long text."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "One two three."), (4, "One two three."), (None, "one two three."), (5, "x" * 20000), (6, " ".join(prose(4000, 1))), (7, "naïve   café \U0001f600 end")]
