r"""Secrets in texts: three patterns, and strings that look random to a pair of Markov models.

A model of random strings and one of ordinary identifiers give each character's probability after the one before; the sum
of the logarithms of their ratios says which of the two a string comes from. Both are counted from labelled strings of the
corpus itself: what the patterns find is random, words that they don't touch are ordinary.

All of it is built-in functions over rows: no shuffle but for the models' counts, no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_text, table, written

# fixed values: the patterns of the base kinds. A run of hexadecimal digits or of what follows AKIA that is too short holds
# no other match, so their least lengths are in the patterns; an assignment may hide one, so its is asked for afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

#: Strings that the models are asked about, of 20 characters or more; an assignment on the way is passed over whole.
STRING = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
CANDIDATE = f"{ASSIGN}|({STRING})"
#: Ordinary identifiers to learn from.
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z_][A-Za-z0-9_]{7,63}+(?![A-Za-z0-9+/_-])"
#: About as many documents are learned from, chosen by hash, with so many words of each.
SAMPLE, WORDS = 20_000, 16
#: Characters that a string may have, for smoothing; codes are below CODES, and 0 stands before a string.
ALPHABET, CODES = 66, 128
#: Least sum of log-likelihood ratios: odds of e^12, 160,000 to 1, for random.
LEAST_RATIO = 12.0
#: Steps between which running sums are taken one by one.
STEP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column) -> Column:
    """The running sums of an array: within steps of STEP, and over the sums of steps, so that long arrays cost little more."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)

    def of(own: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / STEP).cast("int")), lambda k: total(F.slice(own, k * STEP + 1, STEP)))
        before = F.aggregate(steps, F.array(F.lit(0).cast("long")), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b)))
        return let(before, lambda b: F.transform(own, lambda _, i: b[F.floor(i / STEP).cast("int")] + total(F.slice(own, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP + 1))))

    return let(numbers, lambda x: F.when(F.size(x) == 0, x).otherwise(of(x)))


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Array of (start, kind, end, said): the places of a pattern's matches in code points, and what a group of it holds.

    The texts between matches, by split, and the matches themselves tell all places, as running sums of their lengths.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("said"), F.split(text, pattern, -1).alias("between"))

    def placed(x: Column) -> Column:
        steps = F.zip_with(x["whole"], F.slice(x["between"], 1, F.size(x["whole"])), lambda m, b: (F.length(m) + F.length(b)).cast("long"))
        return let(running_sums(steps), lambda ends: F.transform(x["whole"], lambda m, i: F.struct((ends[i] - F.length(m)).alias("start"), F.lit(kind).alias("kind"), ends[i].alias("end"), x["said"][i].alias("said"))))

    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,said:string>>"))


def spans(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def base_matches(docs: DataFrame) -> DataFrame:
    """docs with assign, access and hex: arrays of (start, kind, end, said) of the patterns' matches that are long enough."""
    text = F.col("text")
    return docs.withColumns({
        "assign": F.filter(matches(text, ASSIGN, 0, 2), lambda x: F.length(x["said"]) >= LEAST_VALUE),
        "access": F.when(text.contains("AKIA"), matches(text, ACCESS, 1)).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,said:string>>")),
        "hex": matches(text, HEX, 2),
    })


def labelled_strings(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(string, label) of about `sample` documents, all if there are fewer: 1 for what the patterns find, 0 for words, of
    which each document gives the WORDS first by hash."""
    share = min(1.0, sample / max(docs.count(), 1))
    # a hash from -2^63 to 2^63 - 1
    own = base_matches(docs.where(F.xxhash64("doc_id", "text") <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))))
    random = F.transform(F.concat("assign", "access", "hex"), lambda x: x["said"])
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", ASSIGN, " "), F.lit(WORD), F.lit(0))), lambda w: ~w.rlike(HEX) & ~w.rlike(ACCESS))
    chosen = F.transform(F.slice(F.sort_array(F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), 1, WORDS), lambda x: x["w"])
    marked = lambda strings, y: F.transform(strings, lambda s: F.struct(s.alias("string"), F.lit(y).alias("label")))
    return own.select(F.explode(F.concat(marked(random, 1), marked(chosen, 0))).alias("x")).select("x.*")


def codes_of(string: Column) -> Column:
    return F.transform(F.split(string, ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))


def markov_ratios(strings: DataFrame) -> DataFrame:
    """One row with ratios: for each character (as its code, plus CODES times that of the one before, 0 at the start) the
    logarithm of its probability in strings of label 1 over that in those of label 0, each count plus one."""
    codes = strings.where("string is not null and label in (0, 1)").select("label", codes_of(F.col("string")).alias("c"))
    pairs = codes.select("label", F.explode(F.transform("c", lambda x, i: x + CODES * F.when(i > 0, F.col("c")[F.greatest(i - 1, F.lit(0))]).otherwise(0))).alias("pair"))
    seen = pairs.groupBy("pair").agg(*(F.count_if(F.col("label") == y).alias(f"n{y}") for y in (0, 1)))
    grid = strings.sparkSession.range(CODES * CODES).select(F.col("id").cast("int").alias("pair"))
    counts = grid.join(seen, "pair", "left").select("pair", F.floor(F.col("pair") / CODES).cast("int").alias("before"), *(F.coalesce(f"n{y}", F.lit(0)).alias(f"n{y}") for y in (0, 1)))
    totals = counts.groupBy("before").agg(*(F.sum(f"n{y}").alias(f"t{y}") for y in (0, 1)))
    chance = lambda y: (F.col(f"n{y}") + 1) / (F.col(f"t{y}") + ALPHABET)
    ratios = counts.join(totals, "before").select("pair", F.ln(chance(1) / chance(0)).alias("ratio"))
    return ratios.agg(F.transform(F.sort_array(F.collect_list(F.struct("pair", "ratio"))), lambda x: x["ratio"]).alias("ratios"))  # CODES^2 numbers


def ratio_of(string: Column, ratios: Column) -> Column:
    """The sum of a string's log-likelihood ratios: above 0 where the model of random strings makes it likelier."""
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes_of(string), start, lambda a, c: F.struct(c.alias("before"), (a["sum"] + ratios[a["before"] * CODES + c]).alias("sum")), lambda a: a["sum"])


def secrets(docs: DataFrame, ratios: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each row of (doc_id, text).

    spans has the base spans and those of random strings as kind:start:end, by start, then by kind, in code points with
    the end excluded. A string that holds a base span, or stands in an assignment, is not named again. A null text is an
    empty one; rows are taken one by one, so missing and repeated ids, and rows, stay as they are.
    """
    text = F.col("text")
    # one row of CODES^2 numbers
    own = base_matches(keep_text(docs)).crossJoin(F.broadcast(ratios))
    found = F.filter(matches(text, CANDIDATE, 3, 3), lambda x: (F.length(x["said"]) > 0) & ~x["said"].rlike(HEX) & ~x["said"].rlike(ACCESS))
    own = own.withColumn("random", F.when(text.rlike(STRING), F.filter(found, lambda x: ratio_of(x["said"], F.col("ratios")) >= least)).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,said:string>>")))
    own = own.withColumn("base", F.sort_array(F.concat(spans(F.col("assign")), spans(F.col("access")), spans(F.col("hex")))))
    names = F.array(*map(F.lit, KINDS))
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return own.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        said(F.sort_array(F.concat("base", spans(F.col("random"))))).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )


def op13_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets(docs, written(markov_ratios(labelled_strings(keep_text(docs))), "ratios"))


QUERIES = {"op13_secret_scan": op13_secret_scan}
