"""Token counts of whole texts with the library's own tokenizer.

A text longer than ``CHUNK_CHARS`` characters is encoded in overlapping
chunks with offsets, so that memory stays bounded by the chunk: two neighbouring encodings are spliced
inside their overlap at a common boundary that is proven stable, and where there is none, the overlap is
widened until there is one or the rest of the text is one chunk.

A boundary at a character is proven stable if, in both encodings, one token ends there and another
begins, both encodings agree on the ``AGREE`` tokens on either side (ids and offsets), and the text
itself has white space there: the pre-tokenizer never joins characters across white space, so nothing
on one side can change the tokens of the other.

The same proof counts texts of up to CHUNK_CHARS characters: where the tokenizer's file shows that nothing of it
reaches across ASCII white space (``independent_pieces``), a text's tokens are those of the pieces between white space, and each
worker keeps the library's own count of the last ``PIECES`` distinct pieces. Any other tokenizer encodes such texts at once.

Defined results: null counts as empty; an empty text has 0 tokens; equal rows stay one row each; special
strings inside texts are handled as the library does by default; other columns are passed by.
"""

from __future__ import annotations

import bisect
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

TOKENIZER = "word_bpe_49k.json"
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
AGREE = 2
LIMIT = 2048
#: Texts that go to the library in one call have at most so many characters together.
BATCH_CHARS = 1 << 18
#: Distinct pieces whose counts a worker keeps (some 30 MB), and bytes of a piece that is kept.
PIECES = 1 << 18
PIECE_BYTES = 64

Encoded = list[tuple[int, int, int]]
_tokenizers: dict = {}

#: Parts of a tokenizer's file that never look across white space. A space composes with nothing, so normal forms
#: do not; the expression has no alternative that matches white space and drops all that no alternative matches.
_NORMAL_FORMS = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def independent_pieces(path: str) -> bool:
    """Whether the tokens of a text are proven to be those of its stretches between ASCII white space, in order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for t in spec.get("added_tokens") or []:
        if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]):
            return False

    def parts(x: dict | None, key: str) -> list[dict]:
        return [] if x is None else x[key] if x["type"] == "Sequence" else [x]

    for x in parts(spec.get("normalizer"), "normalizers"):
        if x["type"] not in _NORMAL_FORMS and not (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "):
            return False
    cut, *rest = parts(spec.get("pre_tokenizer"), "pretokenizers") or [None]
    if cut is None or not (cut["type"] == "WhitespaceSplit" or cut["type"] == "Split" and cut["pattern"] == {"Regex": _WORDS} and cut["behavior"] == "Removed" and cut["invert"]):
        return False
    return all(x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in rest)


class PieceCounts:
    """The library's token counts of pieces without ASCII white space; at most PIECES of them are kept."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known: dict[bytes, int] = {}

    def of(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        out = []
        for text in texts:
            pieces = text.split()
            try:
                out.append(sum(map(self.known.__getitem__, pieces)))
            except KeyError:
                out.append(self._learn(pieces))
        return out

    def _learn(self, pieces: list[bytes]) -> int:
        known = self.known
        new = list({p for p in pieces if p not in known})
        encoded = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in new], add_special_tokens=False)
        fresh = {p: len(e) for p, e in zip(new, encoded, strict=True)}
        total = sum(fresh[p] if p in fresh else known[p] for p in pieces)
        if len(known) + len(fresh) > PIECES:
            known.clear()
        known |= {p: n for p, n in fresh.items() if len(p) <= PIECE_BYTES}
        return total


def encoder(path: str) -> Callable[[str, int, int], Encoded]:
    """(id, start, end) of the tokens of a stretch of a text, offsets in the whole text."""
    t = load(path)

    def encode(text: str, start: int, end: int) -> Encoded:
        e = t.encode(text[start:end], add_special_tokens=False)
        return [(i, a + start, b + start) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    return encode


def splice(left: Encoded, right: Encoded, text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """Tokens to keep of ``left`` and to drop of ``right``, or None: the stable boundary nearest to the
    middle of the overlap [lo, hi)."""
    starts = [s for _, s, _ in left]
    at_right = {s: k for k, (_, s, _) in reversed(list(enumerate(right))) if s < hi}
    middle, best = (lo + hi) / 2, None
    for k in range(bisect.bisect_left(starts, lo), len(left)):
        s = left[k][1]
        j = at_right.get(s)
        if j is None or k < AGREE or j < AGREE or not text[s - 1 : s].isspace() or left[k - 1][2] > s - 1 or right[j - 1][2] > s - 1:
            continue
        if left[k - AGREE : k + AGREE] == right[j - AGREE : j + AGREE] and len(left) >= k + AGREE:
            if best is None or abs(s - middle) < abs(left[best[0]][1] - middle):
                best = (k, j)
    return best


def count_long(text: str, encode: Callable[[str, int, int], Encoded], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a text that is longer than a chunk."""
    n = len(text)
    end = min(n, chunk)
    left, total = encode(text, 0, end), 0
    while end < n:
        wide = overlap
        while True:
            lo = max(0, end - wide)
            new_end = min(n, lo + max(chunk, 2 * wide))
            right = encode(text, lo, new_end)
            cut = splice(left, right, text, lo, end)
            if cut:
                total += cut[0]
                left, end = right[cut[1] :], new_end
                break
            if lo == 0 or lo <= (left[0][1] if left else 0):
                # The overlap reaches back over all that isn't spliced yet: take more text in one piece.
                start = left[0][1] if left else lo
                while start > 0 and not text[start - 1].isspace() and start > lo:
                    start -= 1
                end = min(n, end + max(chunk, wide))
                left = encode(text, start, end)
                break
            wide *= 2
    return total + len(left)


def counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, encode = load(path), encoder(path)
        pieces = PieceCounts(t) if independent_pieces(path) else None
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1).cast(pa.large_binary())]
            found = [0] * len(texts)
            group: list[int] = []
            size = 0

            def whole(group: list[int], texts=texts, found=found) -> None:
                some = [texts[g] for g in group]
                each = pieces.of(some) if pieces else [len(e) for e in t.encode_batch_fast([x.decode("utf-8") for x in some], add_special_tokens=False)]
                for g, n in zip(group, each, strict=True):
                    found[g] = n

            for k, x in enumerate(texts):
                # Bytes bound characters from above, so only few texts are decoded to be measured.
                if len(x) > chunk and len(y := x.decode("utf-8")) > chunk:
                    found[k] = count_long(y, encode, chunk)
                    continue
                group.append(k)
                size += len(x)
                if size > BATCH_CHARS:
                    whole(group)
                    group, size = [], 0
            whole(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
