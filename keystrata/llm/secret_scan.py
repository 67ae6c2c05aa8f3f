"""Operator 1: secret scan by fixed patterns and by character Markov models. Columns only, no Python on executors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.shared import fresh

#: The base patterns, and how long a match (of assign: group 2) must be.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
#: Kinds in the order that breaks ties of the start; the last is the method's.
KINDS = ("assign", "access", "hex", "markov")

#: Characters that the models know; any other ends a candidate.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Candidates are whole runs of the alphabet of so many characters that hold a letter, with padding at their end,
#: and, since ordinary names may stand before a secret in a path, the parts of a run between slashes.
CANDIDATE_CHARS = 16
CANDIDATE, PART = (
    f"(?<![{known}])[{known}]{{{CANDIDATE_CHARS},}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?" for known in ("A-Za-z0-9+/_-", "A-Za-z0-9+_-")
)
#: A candidate is a secret if the random model is e^8 times as likely, and e^0.35 times per character.
MIN_RATIO, MIN_RATIO_PER_CHAR = 8.0, 0.35
#: Without a digit it must be so many times as likely per character.
MIN_LETTERS_RATIO_PER_CHAR = 1.0
#: Counted with every pair of characters before the samples are.
SMOOTHING = 0.5
#: Samples of each kind: made-up strings and identifiers, and words of prose, those of the least hashes.
SAMPLES = 4000
#: Words of ordinary identifiers in the samples.
IDENTIFIER_WORDS = (
    "get set user name list item index value count total order price date time start end first last next node tree path file line text word page site link "
    "data table row column key map array string number float double type class object method field event error state status config option param result "
    "request response server client session cache queue thread worker task job batch stream buffer reader writer parser format version update delete insert "
    "select query filter group join sort limit offset default public private static main test build release debug info warning message handler manager"
).split()

#: Rows of a block of a fold.
FOLD = 128

_SPAN = "array<struct<start:bigint,end:bigint,kind:int>>"


def labelled_samples(spark: SparkSession, prose: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Labelled samples (sample, random): random strings and ordinary identifiers.

    Random strings are digests in both kinds of base 64, base 32 style and hexadecimal. Identifiers
    join two to four words in snake, kebab and camel case and as paths, some with a number or date; words
    come from IDENTIFIER_WORDS. If prose is given, SAMPLES of its distinct words are ordinary too, chosen by
    their hash among all, so the models don't depend on how rows are dealt.
    """
    n = spark.range(SAMPLES).select("id", F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    cased = F.translate(F.substring("h", 1, 40), "0123456789abcdef", "k3QzX7vTp9LmW2rB")
    random = n.select(F.explode(F.array(F.substring(b64, 1, 40), F.translate(F.substring(b64, 1, 40), "+/", "-_"), cased, F.substring("h", 9, 32), F.upper(F.substring(b64, 5, 20)))).alias("sample"), F.lit(True).alias("random"))
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")
    pick = lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    a, b, c = pick(1), pick(2), pick(3)
    year = F.when(F.col("id") % 4 == 0, (F.lit(1990) + F.col("id") % 60).cast("string")).otherwise("")
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 5 % 20_000).cast("int")), "yyyy/MM/dd")
    ordinary = n.select(F.explode(F.array(F.concat_ws("_", a, b, c, year), F.concat_ws("-", a, b, c), F.concat(a, F.initcap(b), F.initcap(c), year), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("/", F.lit(""), a, b, c, year), F.concat_ws("/", a, day, b))).alias("sample"), F.lit(False).alias("random"))
    if prose is not None:
        found = prose.select(F.explode(F.split(F.col(text_col), "[^A-Za-z]+")).alias("sample")).filter("length(sample) > 3").distinct().orderBy(F.xxhash64("sample"), "sample").limit(SAMPLES)
        ordinary = ordinary.unionByName(found.select("sample", F.lit(False).alias("random")))
    return random.unionByName(ordinary)


def log_ratios(samples: DataFrame) -> list[float]:
    """Of each pair of characters, the log of P(second | first) under random over that under ordinary.

    Both models are counted by one aggregation; the result has len(ALPHABET) squared entries.
    """
    k = len(ALPHABET)
    pairs = F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring(F.col("sample"), i, F.lit(2)))
    counted = samples.filter("length(sample) > 1").select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    counts = {True: [[SMOOTHING] * k for _ in range(k)], False: [[SMOOTHING] * k for _ in range(k)]}
    for random, pair, n in counted.filter(F.col("pair").rlike("^[A-Za-z0-9+/_-]{2}$")).collect():  # at most two rows for each pair of the alphabet
        counts[random][ALPHABET.index(pair[0])][ALPHABET.index(pair[1])] += n
    return [
        math.log(counts[True][i][j] / sum(counts[True][i])) - math.log(counts[False][i][j] / sum(counts[False][i]))
        for i in range(k)
        for j in range(k)
    ]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row; lambdas would compute an expression for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(rows: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step emits over an array in order, of the array type kind: (state, row) to (next state, emitted array).

    An array that grows is copied at every step, so rows are folded in blocks and the blocks'
    arrays flattened: the work stays about in proportion to the rows.
    """
    none = F.array().cast(kind)

    def inner(acc: Column, row: Column) -> Column:
        after, emitted = step(acc["state"], row)
        return F.struct(after.alias("state"), F.concat(acc["out"], emitted).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        got = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return _let(got, lambda g: F.struct(g["state"].alias("state"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

    begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(_blocks(rows), begin, block, lambda acc: F.flatten(acc["out"]))


def _blocks(rows: Column) -> Column:
    """An array cut into arrays of FOLD."""
    last = lambda r: F.greatest(F.floor((F.size(r) - 1) / FOLD), F.lit(0)).cast("int")
    return _let(rows, lambda r: F.transform(F.sequence(F.lit(0), last(r)), lambda b: F.slice(r, b * FOLD + 1, F.lit(FOLD))))


def _span(start: Column, end: Column, kind: Column) -> Column:
    return F.array(F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"))).cast(_SPAN)


def _matches(text: Column, pattern: str, kind: int, judged: Callable[[Column], Column]) -> Column:
    """Spans of all matches, leftmost and non-overlapping, for which judged(matches) holds.

    Splitting at the pattern gives the pieces between matches, so a running sum of lengths gives
    every position in code points.
    """
    none = F.array().cast(_SPAN)

    def spans(v: Column) -> Column:
        gaps = F.slice(v["between"], 2, F.size(v["found"]) + 1)
        sizes = F.zip_with(v["found"], gaps, lambda m, g: F.struct(F.length(m).cast("long").alias("m"), F.length(g).cast("long").alias("gap")))
        rows = F.zip_with(sizes, judged(v["found"]), lambda x, keep: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), keep.alias("keep")))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            return at + x["m"] + x["gap"], F.when(x["keep"], _span(at, at + x["m"], F.lit(kind))).otherwise(none)

        return _fold(rows, F.length(F.element_at(v["between"], 1)).cast("long"), step, _SPAN)

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")), spans)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, by start, then kind."""
    none = F.array().cast(_SPAN)
    low = F.lower(text)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    every = lambda found: F.transform(found, lambda m: F.lit(True))
    assign = F.when(
        F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api")),
        _matches(text, ASSIGN, 0, lambda found: F.transform(values, lambda v: F.length(v) >= ASSIGN_CHARS)),
    ).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, 1, lambda found: F.transform(found, lambda m: F.length(m) >= ACCESS_CHARS))).otherwise(none)
    # A run of hex digits is never part of a longer one, so the least length can stand in the pattern.
    long_run = "[0-9a-f]{%d,}+" % HEX_CHARS
    hexes = F.when(text.rlike(long_run), _matches(text, long_run, 2, every)).otherwise(none)
    return _sorted(F.concat(assign, access, hexes))


def _sorted(spans: Column) -> Column:
    """By start, then kind."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def markov_spans(text: Column, ratios: list[float]) -> tuple[Column, Column]:
    """Spans of whole candidates, and of parts between slashes, that the random model explains better by the set ratio."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def likely(m: Column) -> Column:
        own = F.rtrim(m, F.lit("="))
        codes = F.transform(F.split(own, ""), lambda c: F.position(c, F.lit(ALPHABET)))
        pairs = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(table, ((a - 1) * len(ALPHABET) + b).cast("int")))
        score = _let(codes, lambda c: F.aggregate(pairs(c), F.lit(0.0), lambda acc, x: acc + x))
        per_char = F.when(m.rlike("[0-9]"), MIN_RATIO_PER_CHAR).otherwise(MIN_LETTERS_RATIO_PER_CHAR)
        return m.rlike("[A-Za-z]") & _let(score, lambda x: (x >= MIN_RATIO) & (x >= per_char * F.length(own)))

    judged = lambda found: F.transform(found, likely)
    found = [F.when(text.rlike(pattern), _matches(text, pattern, 3, judged)).otherwise(F.array().cast(_SPAN)) for pattern in (CANDIDATE, PART)]
    return found[0], found[1]


def _beyond(spans: Column, others: Column) -> Column:
    """What spans, sorted and disjoint, cover and others don't: one pass over both in order of their starts.

    The state is the piece of a span that is still open and how far others reach.
    """
    top = F.lit((1 << 63) - 1).cast("long")
    sided = lambda some, side: F.transform(some, lambda s: F.struct(s["start"].alias("start"), F.lit(side).alias("side"), s["end"].alias("end"), s["kind"].alias("kind")))
    last = F.array(F.struct(top.alias("start"), F.lit(1).alias("side"), top.alias("end"), F.lit(0).alias("kind")))
    none = F.array().cast(_SPAN)
    state = lambda start, end, kind, until: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), kind.cast("int").alias("kind"), until.cast("long").alias("until"))

    def step(open_: Column, row: Column) -> tuple[Column, Column]:
        begins = row["side"] == 1
        before = F.when(begins, open_["end"]).otherwise(F.least(open_["end"], row["start"]))
        emitted = F.when(before > open_["start"], _span(open_["start"], before, open_["kind"])).otherwise(none)
        cut = state(F.greatest(open_["start"], row["end"]), open_["end"], open_["kind"], F.greatest(open_["until"], row["end"]))
        return F.when(begins, state(F.greatest(row["start"], open_["until"]), row["end"], row["kind"], open_["until"])).otherwise(cut), emitted

    rows = F.array_sort(F.concat(sided(spans, 1), sided(others, 0), last))
    zero = F.lit(0)
    return F.when(F.size(spans) == 0, none).otherwise(_fold(rows, state(zero, zero, zero, zero), step, _SPAN))


def find_secrets(docs: DataFrame, samples: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """All columns of docs and ``secrets`` (renamed if taken): struct(base, spans).

    base holds the spans of the fixed patterns; spans holds these and of the method's what no base
    span covers. A span is (start, end, kind): code points, end exclusive, kind as a position in
    KINDS; both are sorted by start, then kind. Everything is a column expression over the whole
    text: no shuffle, no Python on executors.

    Null text: empty, no spans. Repeated rows: each scanned alone. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole, between = markov_spans(text, log_ratios(samples))
    base = base_spans(text)
    more = _let(whole, lambda runs: _sorted(F.concat(runs, _beyond(between, runs))))
    both = _let(base, lambda b: F.struct(b.alias("base"), _sorted(F.concat(b, _beyond(more, b))).alias("spans")))
    return docs.withColumn(fresh(docs, into)[0], both)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    size = F.length(text).cast("long")
    pair = lambda start, end: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
    kind = "array<struct<start:bigint,end:bigint>>"

    def keep(state: Column, s: Column) -> tuple[Column, Column]:
        """The state is the last run of spans; what lies between it and the next one is kept."""
        apart = s["start"] >= state["end"]
        after = F.when(apart, pair(s["start"], s["end"])).otherwise(pair(state["start"], F.greatest(state["end"], s["end"])))
        return after, F.when(apart, F.array(pair(state["end"], s["start"]))).otherwise(F.array().cast(kind))

    def cut(block: Column) -> Column:
        """A block's pieces, from the part of the text that it spans."""
        first = F.element_at(block, 1)["start"]
        part = F.substring(text, (first + 1).cast("int"), (F.element_at(block, -1)["end"] - first).cast("int"))
        return _let(F.struct(first.alias("first"), part.alias("part")), lambda v: F.transform(block, lambda p: F.substring(v["part"], (p["start"] - v["first"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))))

    kept = _fold(F.concat(spans, _span(size, size, F.lit(0))), pair(F.lit(0), F.lit(0)), keep, kind)
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.flatten(F.transform(_blocks(kept), cut)), mark))


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, labelled_samples(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    base = F.col("secrets")["base"]
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")  # noqa: E731 - a second argument of the inner one would be the index
    counts = {f"n_{kind}": of_kind(k) for k, kind in enumerate(KINDS[:3])}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secrets")["spans"]).alias("spans")
    )
