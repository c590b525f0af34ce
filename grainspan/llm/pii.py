"""Personal data by bootstrapped contextual extraction; DataFrame and SQL functions only.

1. Seeds: emails, ip addresses, card and phone numbers that four expressions find and checks confirm. An expression's
   matches and the gaps between them (its split) give code point offsets by a running sum for each text.
2. The same scan takes what may be an identifier: a token with a digit or an @ that has the loose shape of a kind (an @ among
   others, enough digits ...), or, for cards and phones, the longest run of digits in groups (6 to 15 digits of a phone, 12 to 19 of a
   card) that single spaces and brackets part and that no letter, digit or @ follows. A token that alone has 10 digits of a phone or 13 of
   a card is whole and is not extended. Each carries the two words before it and its offsets; only these rows leave the scan.
3. A pattern is a kind and the two words before a seed. All patterns before at least ``SUPPORT`` different seeds are kept.
   Up to ``FEW`` of them are broadcast; more are joined by shuffles, salted, with the same result.
4. A scan of all texts counts every occurrence of the patterns' words, whatever follows.
5. Patterns and instances form a graph that is scored ``ROUNDS`` times: a pattern by the mean score of what follows it,
   over all its occurrences; an instance by the chance that not all of its patterns are wrong; seeds are certain.
6. Patterns of at least ``CONFIDENT`` discover the identifiers that follow them and that no seed covers. Words
   such as "of the", which stand before anything, get scores near 0 and discover nothing.
7. Discovered identifiers are known values as seeds are, wherever else they stand, and induce further patterns; steps 3 to 6
   are repeated for these until a pass brings none, at most ``PASSES`` times.

Expressions use possessive quantifiers and start only where a run of characters starts, so that a text of any
length is scanned in linear time and without recursion.

Defined results: a null or empty text has no spans; seeds that fail a check are dropped without another try; rows that
repeat are each searched and a seed's value counts once for a pattern; null doc_ids keep their rows; an empty table
gives an empty result; further columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for its expression to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Looser shapes that a kind's patterns may discover.
SHAPES = {"email": r"^[^@]+@[^@]+$", "ip": r"^[0-9A-Fa-f]{1,4}([.:][0-9A-Fa-f]{0,4}){2,}$", "card": r"^[0-9][0-9Xx*-]{11,}$", "phone": r"^[+(]?[0-9][0-9().-]{5,}$"}
#: The same with spaces and brackets within: the kind's start, after any opening marks.
SPACED = {
    "card": r"[0-9](?:[ -]?[0-9Xx*]){11,18}(?![0-9A-Za-z@*])",
    "phone": r"(?:(?=\(\+?[0-9]{1,5}\))\()?\+?[0-9](?:(?:\.|[ ()-]{0,3})[0-9]){5,14}(?![0-9A-Za-z@])",
}
#: Digits that make a token whole.
WHOLE = {"card": 13, "phone": 10}
#: A token with a digit or an @; it is tried only where a token starts.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Further tokens that a spaced identifier can have (one digit each), characters of a gap and of a token that are looked at
#: for it (a longer gap or token ends it), and tokens whose lengths are added up at once.
SPAN, GAP, LONG, CHUNK = 18, 4, 100, 256
SUPPORT = 3
#: Patterns up to this number are broadcast, and their words are a list in a filter.
FEW = 4096
#: Parts that the rows of one pattern are dealt over in a join without broadcast.
SALTS = 16
ROUNDS = 3
CONFIDENT = 0.5
#: Rounds of induction.
PASSES = 3

_PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def luhn(value: Column) -> Column:
    """Whether the digits of a card pass the check, from the right, every second doubled."""
    digits = F.reverse(F.regexp_replace(value, "[ -]", ""))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + F.element_at(F.array(*[F.lit(v) for v in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1 + F.when(i % 2 == 0, 10).otherwise(0)),
        lambda a: a % 10 == 0,
    )


def valid(kind: Column, value: Column) -> Column:
    """The checks of the base spans."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(rf"^{_PART}(\.{_PART}){{3}}$"))
        .when(kind == "card", F.when(digits.between(13, 19), luhn(value)).otherwise(False))
        .otherwise(digits.between(9, 15))
    )


def words_before(left: Column) -> Column:
    """The two words that end a stretch of text, each before one white space character, lower-cased; empty if there are none."""
    turned = F.regexp_extract(F.reverse(left), r"^\s(\S++\s\S++)", 1)
    return F.lower(F.regexp_replace(F.reverse(turned), r"\s", " "))


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id and, for each kind, the parts of the text: gap length, words that end the gap, match; and hits.

    The rows are numbered here once; what is written with them has no other number.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text.alias("text"))
    some = F.col("text").rlike("[0-9]")
    cols = []
    for k in KINDS:
        may = F.col("text").contains("@") if k == "email" else some if HINTS[k] is None else some & F.col("text").contains(HINTS[k])
        found, gaps = F.regexp_extract_all("text", F.lit(EXPRESSIONS[k]), F.lit(0)), F.split("text", EXPRESSIONS[k], -1)
        # Before all gaps but the first there is a match, which a word at the start of the gap would be part of.
        gaps = F.transform(gaps, lambda g, i: F.struct(g.alias("g"), F.when(i > 0, F.concat(F.lit("+"), g)).otherwise(g).alias("left")))
        parts = F.zip_with(found, gaps, lambda m, g: F.struct(F.char_length(g.g).alias("gap"), words_before(g.left).alias("words"), m.alias("value")))
        cols.append(F.when(may, F.filter(parts, lambda p: p.value.isNotNull())).alias(k))
    has = F.col("text").rlike("[0-9@]")
    tokens = [F.when(has, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("m"), F.when(has, F.split("text", TOKEN, -1)).alias("g")]
    return with_hits(out.select("row", "doc_id", *cols, *tokens)).select("row", "doc_id", *KINDS, "hits")


def with_hits(rows: DataFrame) -> DataFrame:
    """``hits``: start, words before, token and rest of each token of ``m`` (tokens) and ``g`` (the gaps before them and the last).

    A start is the sum of all lengths before: of whole chunks, then within the chunk, so a text of any number of tokens takes
    a bounded number of steps for each.
    """
    rows = rows.withColumn("lens", F.expr("transform(m, (x, i) -> char_length(x) + char_length(get(g, i)))"))
    rows = rows.withColumn("near", F.expr(f"transform(m, (x, i) -> concat(left(get(g, i), {GAP}), left(x, {LONG})))"))
    rows = rows.withColumn("sums", F.expr(f"transform(sequence(0, (size(m) - 1) div {CHUNK}), c -> aggregate(slice(lens, c * {CHUNK} + 1, {CHUNK}), 0L, (a, x) -> a + x))"))
    # size(sums) is there so that sums stay a column of their own and are not worked out again for each chunk.
    rows = rows.withColumn("bases", F.expr("if(size(sums) > 1, transform(sums, (x, c) -> aggregate(slice(sums, 1, c), 0L, (a, y) -> a + y)), array(0L))"))
    # A generator of one row: without it the optimizer would move these columns into the function below, for each element anew.
    arrays = ("m", "g", "lens", "near", "bases")
    rows = rows.select(*[c for c in rows.columns if c not in (*arrays, "sums")], F.inline(F.array(F.struct(*arrays))))
    hit = F.expr(
        f"""transform(m, (x, i) -> named_struct(
          'start', get(bases, i div {CHUNK}) + aggregate(slice(lens, i div {CHUNK} * {CHUNK} + 1, i % {CHUNK}), 0L, (a, y) -> a + y) + char_length(get(g, i)),
          'left', concat(coalesce(get(m, i - 2), ''), coalesce(get(g, i - 1), ''), coalesce(get(m, i - 1), ''), get(g, i)),
          'token', x,
          'rest', concat(x, array_join(slice(near, i + 2, {SPAN}), ''))))"""
    )
    rows = rows.withColumn("all", F.when(F.size("m") > 0, hit))
    kept = F.transform("all", lambda h: F.struct(h.start.alias("start"), words_before(h.left).alias("words"), h.token.alias("token"), h.rest.alias("rest")))
    return rows.withColumn("hits", F.filter(kept, lambda h: h.words != ""))


def base_spans(parts: DataFrame) -> DataFrame:
    """row, kind, start, end, value and left of the confirmed seeds of ``matches``."""
    each = None
    for k in KINDS:
        one = parts.select("row", F.lit(k).alias("kind"), F.posexplode(k).alias("n", "p"))
        each = one if each is None else each.unionByName(one)
    so_far = Window.partitionBy("row", "kind").orderBy("n")  # the matches of one text
    end = F.sum(F.col("p.gap") + F.char_length("p.value")).over(so_far).cast("long")
    each = each.withColumn("end", end).select("row", "kind", (F.col("end") - F.char_length("p.value")).alias("start"), "end", F.col("p.value").alias("value"), F.col("p.words").alias("words"))
    return each.filter(valid(F.col("kind"), F.col("value")))


def with_patterns(left: DataFrame, patterns: DataFrame, few: bool, spread: list[str]) -> DataFrame:
    """Inner join on words and kind; without a broadcast, the rows of a pattern are dealt over by the columns ``spread``."""
    if few:
        return left.join(F.broadcast(patterns), ["words", "kind"])
    salted = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS))).join(salted.hint("shuffle_merge"), ["words", "kind", "salt"]).drop("salt")


def instances(parts: DataFrame) -> DataFrame:
    """row, words, kind, value, start and end of all that has a kind's loose shape, of the hits of ``matches``."""
    found = parts.select("row", F.explode("hits").alias("h")).select("row", "h.*").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    core = F.regexp_replace("token", r"^[\"'<\[(]+|[\"'>\]),.;:!?]+$", "")
    lead = F.char_length(F.regexp_extract("token", r"^[\"'<\[(]*", 0))
    shape = spaced = opening = whole = F.when(F.lit(False), F.lit(None))
    for k in KINDS:
        shape = shape.when(F.col("kind") == k, F.col("core").rlike(SHAPES[k]))
        if k in SPACED:
            marks = rf"^([\"'<\[(]*?)({SPACED[k]})"
            spaced = spaced.when(F.col("kind") == k, F.regexp_extract("rest", marks, 2))
            opening = opening.when(F.col("kind") == k, F.char_length(F.regexp_extract("rest", marks, 1)))
            whole = whole.when(F.col("kind") == k, F.col("shaped") & (F.char_length(F.regexp_replace("core", "[^0-9Xx*]", "")) >= WHOLE[k]))
    found = found.withColumns({"core": core, "lead": lead}).withColumn("shaped", shape)
    found = found.withColumns({"spaced": F.coalesce(spaced, F.lit("")), "opening": opening, "whole": F.coalesce(whole, F.lit(False))})
    longer = ~F.col("whole") & (F.char_length("spaced") > F.when(F.col("shaped"), F.char_length("core")).otherwise(0))
    found = found.withColumn("longer", longer).filter("shaped or longer")
    found = found.withColumns({"value": F.when(F.col("longer"), F.col("spaced")).otherwise(F.col("core")), "start": F.col("start") + F.when(F.col("longer"), F.col("opening")).otherwise(F.col("lead"))})
    return found.select("row", "words", "kind", "value", "start", (F.col("start") + F.char_length("value")).alias("end"))


def occurrences(docs: DataFrame, patterns: DataFrame, few: bool) -> DataFrame:
    """words and total: how often the words of ``patterns`` stand in all texts, whatever follows."""
    tokens = docs.select(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", -1).alias("t"))
    pairs = tokens.select(F.explode(F.expr("transform(sequence(2, greatest(size(t), 2)), i -> lower(concat(get(t, i - 2), ' ', get(t, i - 1))))")).alias("words"))
    if few:
        lefts = [r.words for r in patterns.select("words").distinct().collect()]  # at most FEW
        return pairs.filter(F.col("words").isin(lefts)).groupBy("words").agg(F.count("*").alias("total"))
    return pairs.filter("words is not null").groupBy("words").agg(F.count("*").alias("total")).join(patterns.select("words").distinct().hint("shuffle_merge"), "words")


def score(patterns: DataFrame, known: DataFrame, after: DataFrame, scratch: Scratch, rounds: int = ROUNDS, few: bool = True) -> DataFrame:
    """words, kind and score of the patterns. ``patterns`` has totals, ``after`` (words, kind, value) what follows them, ``known``
    (kind, value, prior) the values that are certain (1) or were discovered before, with their score."""
    edges = after.groupBy("words", "kind", "value").agg(F.count("*").alias("n")).join(known, ["kind", "value"], "left")
    edges = scratch.save(edges.select("words", "kind", "value", "n", F.coalesce("prior", F.lit(0.0)).alias("prior")))
    scores = None
    for _ in range(rounds):
        if scores is None:
            weighed = edges.withColumn("s", F.col("prior"))
        else:
            doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
            instance = with_patterns(edges, scores, few, ["value"]).groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("i"))
            weighed = edges.join(instance, ["kind", "value"]).withColumn("s", F.when(F.col("prior") >= 1, 1.0).otherwise(F.greatest("i", "prior")))
        new = weighed.groupBy("words", "kind").agg(F.sum(F.col("s") * F.col("n")).alias("good"))
        scores = scratch.save(new.join(patterns, ["words", "kind"]).select("words", "kind", F.least(F.col("good") / F.greatest("total", "good"), F.lit(1.0)).alias("score")))
    return scores


def apart(new: DataFrame, seeds: DataFrame) -> DataFrame:
    """The spans of ``new`` that overlap none of ``seeds``, by two passes along each text."""
    both = new.select("row", "kind", "start", "end", "value", F.lit(False).alias("seed")).unionByName(seeds.select("row", "kind", "start", "end", "value", F.lit(True).alias("seed")))
    along = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"before": F.max(F.when(F.col("seed"), F.col("end"))).over(along), "next": F.min(F.when(F.col("seed"), F.col("start"))).over(back)})
    return both.filter("not seed and (before is null or before <= start) and (next is null or next >= end)").select("row", "kind", "start", "end", "value")


def personal_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, base and added (arrays of kind number, kind, start, end, value) for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "pii")
    docs = docs.select("doc_id", "text")
    parts = scratch.save(matches(docs))
    seeds = scratch.save(base_spans(parts))
    spans = seeds.select("row", "kind", "start", "end", "value", F.lit(False).alias("added"))
    found = scratch.save(instances(parts).join(seeds.select("row", "kind", "start"), ["row", "kind", "start"], "left_anti"))
    certain = seeds.select("kind", "value").distinct().withColumn("prior", F.lit(1.0))
    known, patterns, discovered, sure = certain, None, None, None
    stands = seeds.filter("words <> ''").select("words", "kind", "value")
    for _ in range(PASSES):
        induced = stands.groupBy("words", "kind").agg(F.countDistinct("value").alias("support")).filter(F.col("support") >= SUPPORT).drop("support")
        if patterns is not None:
            induced = induced.join(patterns.select("words", "kind"), ["words", "kind"], "left_anti")
        induced = scratch.save(induced)
        more = induced.count()
        if not more:
            break
        fresh = induced.join(occurrences(docs, induced, more <= FEW), "words")
        patterns = scratch.save(fresh if patterns is None else patterns.unionByName(fresh))
        few = patterns.count() <= FEW
        names = patterns.select("words", "kind")
        after = with_patterns(found, names, few, ["row", "start"]).select("words", "kind", "value")
        after = after.unionByName(with_patterns(seeds.select("row", "start", "words", "kind", "value"), names, few, ["row", "start"]).select("words", "kind", "value"))
        sure = score(patterns, known, after, scratch, few=few).filter(F.col("score") >= CONFIDENT)
        at = with_patterns(found, sure, few, ["row", "start"])
        discovered = scratch.save(at.groupBy("row", "start").agg(F.max_by(F.struct("kind", "end", "value"), F.struct("score", "end", "kind")).alias("best"), F.max("score").alias("score")).select("row", "start", "best.*", "score"))
        if discovered.isEmpty():
            discovered = None
            break
        # A value that was discovered somewhere is known wherever it stands.
        values = discovered.groupBy("kind", "value").agg(F.max("score").alias("prior")).join(certain, ["kind", "value"], "left_anti")
        known = scratch.save(certain.unionByName(values.select("kind", "value", "prior")))
        stands = scratch.save(
            seeds.filter("words <> ''").select("words", "kind", "value").unionByName(found.select("words", "kind", "value").distinct().join(known.select("kind", "value"), ["kind", "value"]).select("words", "kind", "value"))
        )
    if discovered is not None:
        so_far = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        new = discovered.withColumn("past", F.max("end").over(so_far)).filter("past is null or past <= start")  # none within another
        new = apart(new, seeds)
        spans = spans.unionByName(new.select("row", "kind", "start", "end", "value", F.lit(True).alias("added")))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct(number.alias("k"), "start", "end", "kind", "value")
    lists = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(~F.col("added"), item))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("added"), item))).alias("added")
    )
    return parts.select("row", "doc_id").join(lists, "row", "left")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in all documents."""
    out = personal_spans(table(spark, sf_dir, "documents"))
    empty = F.expr("cast(array() as array<struct<k:bigint,start:bigint,end:bigint,kind:string,value:string>>)")
    out = out.select("doc_id", *[F.coalesce(F.col(c), empty).alias(c) for c in ("base", "added")])
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans")
    )
