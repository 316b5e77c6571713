"""Operator 9, secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

DataFrame functions only. Matches and their places come from one substitution that
puts a marker before and after each match: splitting at the marker gives the texts
between and the matches in turn, and sums of their lengths give the places. The
marker U+FFFE is not in any pattern; one in a text is first replaced by U+FFFD.

The models are two first-order chains over 66 symbols (A-Z, a-z, 0-9, three marks
and all others): random strings and ordinary identifiers. They are trained from
labelled samples: digests in hex and base 64 and the base matches of the sampled
documents as random; as ordinary the other words of those documents, identifiers made of three words in a row (camel case, snake
case, constants, paths, with numbers between), and UUIDs. ``SAMPLE``
documents are sampled, by a hash of id and text (repeated rows once). The counted pairs are a table of at most
2 * 66 * 66 rows. A word of ``SHORTEST`` or more such characters, with digits and letters,
that no base span overlaps, is a span of kind markov if its log-likelihood ratio is at
least ``MARGIN`` nats, and so much a character as parts the samples best that are held out of the counts: one in
``HELD`` of the sampled documents and digests. Null texts are empty; repeated rows are scanned each; texts of
any length are scanned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table

KINDS = ("assign", "access", "hex", "markov")
SAMPLE = 4000
DIGESTS = 4000
SHORTEST = 20
MARGIN = 12.0
#: One sampled document and digest in so many is held out to choose the cut, and so many words of each class at most; without any it is RATE.
HELD, HELD_WORDS = 5, 4000
RATE = 0.5
#: Weight of a chain's single symbols in its pairs: rare first symbols lean on the symbols' own frequencies.
PRIOR = 4.0
_MARK = "￾"
#: The base patterns, and the least length of a match (of group 2 for assign).
_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
_WORD = r"[A-Za-z0-9+/_=-]{" + str(SHORTEST) + r",}"
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_"
_WIDTH = len(_SYMBOLS) + 1
_STEP = 256


_SPANS = "array<struct<s:int,e:int,t:string>>"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; what a lambda names from outside it is else evaluated for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(size: Column) -> Column:
    """The place of each piece (and one more for each block of ``_STEP``), from the pieces' lengths: sums in two levels, about linear."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(size) - 1) / _STEP).cast("int")), lambda k: F.slice(size, k * _STEP + 1, _STEP))
    running = lambda items, first: F.aggregate(items, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    sums = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    placed = lambda both: F.flatten(F.transform(both["blocks"], lambda b, k: running(b, F.get(both["heads"], k))))
    return let(blocks, lambda blocks: let(F.struct(blocks.alias("blocks"), running(sums(blocks), F.lit(0)).alias("heads")), placed))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<s, e, t>>: code points from zero, end exclusive."""

    def span(x: Column, i: Column) -> Column:
        start = F.get(x["starts"], i + F.floor(i / _STEP).cast("int"))  # each block has its end besides its pieces
        return F.struct(start.alias("s"), (start + F.length(F.get(x["part"], i))).alias("e"), F.get(x["part"], i).alias("t"))

    placed = lambda x: F.transform(F.sequence(F.lit(1), F.size(x["part"]) - 2, F.lit(2)), lambda i: span(x, i))
    found = lambda part: F.when(F.size(part) > 1, let(F.struct(part.alias("part"), _starts(F.transform(part, F.length)).alias("starts")), placed)).otherwise(F.array().cast(_SPANS))
    return let(F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1), found)


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _MARK, "�")


def base_matches(text: Column) -> dict[str, Column]:
    """The base spans by kind, of a text without markers. A short text without the needed characters skips the scan."""
    none = F.array().cast(_SPANS)
    assign = F.filter(matches(text, _ASSIGN), lambda m: F.length(F.regexp_extract(m["t"], _ASSIGN, 2)) >= 6)
    return {
        "assign": F.when(text.rlike(_ASSIGN), assign).otherwise(none),
        "access": F.when(F.contains(text, F.lit("AKIA")), matches(text, _ACCESS)).otherwise(none),
        "hex": F.when(text.rlike(_HEX), matches(text, _HEX)).otherwise(none),
    }


def _symbol(text: Column, at: Column) -> Column:
    """1 to 65 for the listed symbols, 66 for any other."""
    place = F.instr(F.lit(_SYMBOLS), F.substring(text, at, F.lit(1)))
    return F.when(place > 0, place).otherwise(_WIDTH)


def _pairs(words: DataFrame) -> DataFrame:
    """(random, a, b, n): counts of neighbouring symbols of (word, random)."""
    steps = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(_symbol(F.col("word"), i).alias("a"), _symbol(F.col("word"), i + 1).alias("b")))
    return words.where(F.length("word") > 1).select("random", F.explode(steps).alias("p")).groupBy("random", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


class Model(NamedTuple):
    """The log-likelihood ratio (random against ordinary) of each pair of symbols, a * 66 + b from (1, 1); and the cut a character."""

    weights: list[float]
    rate: float


def _identifiers(words: Column) -> Column:
    """Identifiers of each three words in a row, in one of six forms by their place."""
    a, b, c = (lambda i, k=k: F.get(words, i * 3 + k) for k in range(3))
    n = lambda i: (i * 7 % 113).cast("string")

    def named(i: Column) -> Column:
        x, y, z = F.lower(a(i)), F.lower(b(i)), F.lower(c(i))
        forms = [F.concat(x, F.initcap(y), F.initcap(z), n(i)), F.concat(F.initcap(x), n(i), F.initcap(y), F.initcap(z)), F.concat_ws("_", x, y, n(i), z), F.concat_ws("/", x, y, F.concat(z, n(i))), F.concat_ws("-", x, n(i), y, z), F.upper(F.concat_ws("_", x, y, z, n(i)))]
        return F.get(F.array(*forms), (i % len(forms)).cast("int"))

    n_made = F.floor(F.size(words) / 3).cast("int")
    return F.when(n_made > 0, F.transform(F.sequence(F.lit(0), n_made - 1), named)).otherwise(F.array().cast("array<string>"))


def _cut(held: DataFrame, weights: list[float]) -> float:
    """The ratio a character that parts the held-out (word, random) with the fewest errors, each class weighing the same; the middle of the best gap."""
    scored = held.where(F.length("word") >= SHORTEST).select("random", (ratio(F.col("word"), _literal(weights)) / F.length("word")).alias("s"))
    rows = sorted((r.s, r.random) for r in scored.collect())
    n = [sum(r == side for _, r in rows) for side in (0, 1)]
    if not all(n):
        return RATE
    errors = best = 1.0  # a cut below all takes the ordinary ones for random
    cut = RATE
    for (s, side), (t, _) in zip(rows, rows[1:]):
        errors += 1 / n[1] if side else -1 / n[0]
        if errors < best and t > s:
            best, cut = errors, (s + t) / 2
    return cut


def fit(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    # rows of the sample count once, however often they are repeated
    keyed = docs.select("text", row_key().alias("row"))
    rows = keyed.select("row").distinct().orderBy("row").limit(SAMPLE)
    held = F.pmod("row", F.lit(HELD)) == 0
    text = keyed.join(F.broadcast(rows), "row", "left_semi").dropDuplicates(["row"]).select(held.alias("held"), _clean(F.col("text")).alias("text"))
    base = base_matches(F.col("text"))
    found = text.select("held", F.explode(F.concat(F.transform(base["assign"], lambda m: F.regexp_extract(m["t"], _ASSIGN, 2)), *(F.transform(base[k], lambda m: m["t"]) for k in ("access", "hex")))).alias("word")).where(F.length("word") >= SHORTEST)
    rest = text.select("held", F.regexp_replace(F.regexp_replace(F.regexp_replace("text", _ASSIGN, " "), _ACCESS, " "), _HEX, " ").alias("text"))
    plain = rest.select("held", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("word"))
    made = rest.select("held", F.regexp_extract_all("text", F.lit(r"[A-Za-z]{3,}"), F.lit(0)).alias("words")).select("held", F.explode(_identifiers(F.col("words"))).alias("word"))
    digest = spark.range(0, DIGESTS, 1, 8).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("x"), "id", (F.col("id") % HELD == 0).alias("held"))
    random = found.unionByName(digest.select("held", F.when(F.col("id") % 4 == 0, F.substring("x", 1, 40)).otherwise(F.rtrim(F.base64(F.unhex("x")), F.lit("="))).alias("word")))
    uuid = digest.select("held", F.concat_ws("-", *(F.substring("x", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))).alias("word"))
    words = random.withColumn("random", F.lit(1)).unionByName(plain.unionByName(made).unionByName(uuid).withColumn("random", F.lit(0)))
    rows = _pairs(words.where(~F.col("held")).select("word", "random")).collect()
    count = [[[0] * _WIDTH for _ in range(_WIDTH)] for _ in range(2)]
    for r in rows:
        count[r.random][r.a - 1][r.b - 1] += r.n
    log_p = []
    for pairs in count:
        single = [0.5 + sum(row[b] for row in pairs) for b in range(_WIDTH)]
        share = [x / sum(single) for x in single]
        log_p.append([[math.log((row[b] + PRIOR * share[b]) / (sum(row) + PRIOR)) for b in range(_WIDTH)] for row in pairs])
    weights = [log_p[1][a][b] - log_p[0][a][b] for a in range(_WIDTH) for b in range(_WIDTH)]
    both = made.unionByName(uuid).withColumn("random", F.lit(0)), random.where("word rlike '[g-zG-Z+/]'").withColumn("random", F.lit(1))  # random strings in hex are for the base patterns
    asked = [side.where("held").select("word", "random").orderBy(F.xxhash64("word"), "word").limit(HELD_WORDS) for side in both]
    return Model(weights, _cut(asked[0].unionByName(asked[1]), weights))


def _literal(weights: list[float]) -> Column:
    """One literal, where F.lit would build thousands."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def ratio(word: Column, weights: Column) -> Column:
    """The log-likelihood ratio of a word of two or more characters."""
    return F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), F.lit(0.0), lambda acc, i: acc + F.get(weights, (_symbol(word, i) - 1) * _WIDTH + _symbol(word, i + 1) - 1))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """The spans of (doc_id, text): base ones by kind, and the added ones."""
    table_ = _literal(model.weights)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _clean(F.col("text")).alias("text"))
    found = text.select("doc_id", "text", *(c.alias(k) for k, c in base_matches(F.col("text")).items()))
    named = lambda kind, order: F.transform(F.col(kind), lambda m: F.struct(m["s"].alias("s"), F.lit(order).alias("o"), m["e"].alias("e"), F.lit(kind).alias("k")))
    based = found.select("*", F.array_sort(F.concat(*(named(k, i) for i, k in enumerate(KINDS[:3])))).alias("base"))
    likely = F.when(F.col("text").rlike(_WORD), matches(F.col("text"), _WORD)).otherwise(F.array().cast(_SPANS))
    mixed = based.select("*", F.filter(likely, lambda m: m["t"].rlike("[0-9]") & m["t"].rlike("[A-Za-z]") & ~F.exists(F.col("base"), lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))).alias("likely"))
    added = F.filter("likely", lambda m: ratio(m["t"], table_) >= F.greatest(F.lit(MARGIN), F.lit(model.rate) * F.length(m["t"])))
    return mixed.select("doc_id", "assign", "access", "hex", "base", F.transform(added, lambda m: F.struct(m["s"].alias("s"), F.lit(3).alias("o"), m["e"].alias("e"), F.lit("markov").alias("k"))).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = scan(docs, fit(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["k"], m["s"].cast("string"), m["e"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
