"""Quality rules whose cutoffs carry a bound on how many good documents they reject.

Labelled documents are split by a hash of their id. On one half, each feature gets a ladder of ever
stricter cutoffs; a step allows one more share of good documents to fall, and takes only cutoffs that
reject far more bad documents than good ones. On the other half, the holdout, the steps of a stratum are tested in
order: step j stands if P(Bin(n, max_rejected) <= k) <= error / strata for its k rejections among n good documents, which
is to say that the exact binomial upper bound of its false-rejection rate is at most `max_rejected`. The
first step that fails ends the ladder. Testing in a fixed order costs no correction within a stratum, and
the error is shared among the strata (Bonferroni). So with probability 1 - error, in no stratum do
all rules together reject more than `max_rejected` of the good documents the base rule keeps.

A stratum (language; null counts as empty) with too few labelled documents to prove anything has no rules
beyond the base. Rules for odd input: a null text has no words and fails the base; rows are judged one by
one, so repeated ids do no harm; labels with a null id or quality count for nothing; conflicting labels of one id both
count. Labels may be absent altogether.

All is DataFrame code. Of the documents, only ids and counts are ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.llm.common import stored, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature number: (numerator, denominator) of a share in hundredths, the more the worse.
FEATURES = [("n_symbols", "word_chars"), ("n_marks", "word_chars"), ("n_upper", "word_chars"),
            ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("word_chars", "n_words * 20")]


@dataclass(frozen=True)
class Risk:
    """`steps`: shares of good documents each step of the ladder lets a feature reject on the first half;
    `lift`: how many times the good documents' share the bad documents' share must be."""

    max_rejected: float = 0.01
    error: float = 0.05
    lift: float = 10.0
    steps: tuple[float, ...] = (0.0, 0.0005, 0.001, 0.002, 0.004)


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_counts(docs: DataFrame) -> DataFrame:
    """Add the base counts, those of the features, and `base_failed`.

    A repeat is found by 64-bit hashes of eight words, put together from hashes of one, two and four.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("__words", words(text)).withColumn("n_words", F.size("__words").cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__lines", lines).withColumn("n_lines", F.size("__lines").cast("long"))
    n = F.col("n_words").cast("int")

    def doubled(hashes: str, step: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))

    df = df.withColumn("__h1", F.transform("__words", lambda w: F.xxhash64(w)))
    df = df.withColumn("__h2", doubled("__h1", 1)).withColumn("__h4", doubled("__h2", 2)).withColumn(
        "__h8", F.slice(doubled("__h4", 4), 1, F.greatest(n - 7, F.lit(0))))
    repeats = F.size(F.array_distinct("__h8")) < F.size("__h8")
    df = df.withColumn("__sorted", F.when(repeats, F.array_sort(
        F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = F.col("__sorted")

    def again(x: Column, i: Column) -> Column:
        return ((i > 0) & (F.get(near, i - 1)["h"] == x["h"])) | (F.get(near, i + 1)["h"] == x["h"])

    places = F.array_sort(F.transform(F.filter(near, lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["i"]))
    df = df.withColumn("__places", places)
    covered = F.aggregate("__places", F.struct(F.lit(-8).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(8), p - a["last"])).alias("n")),
                          lambda a: a["n"])
    df = df.withColumns({
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": _without(text, r"[#*$%&|<>]").cast("long"),
        "n_marks": _without(text, r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]").cast("long"),
        "n_upper": _without(text, r"\p{Lu}+").cast("long"),
        "n_dup_lines": (F.col("n_lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("__words", "__lines", "__h1", "__h2", "__h4", "__h8", "__sorted", "__places")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def with_shares(df: DataFrame) -> DataFrame:
    """Add `__shares`, the features in hundredths from 0 to 100, and `__stratum`."""
    shares = [F.expr(f"least(100, coalesce(try_divide(100 * {a}, {b}), 0))").cast("int") for a, b in FEATURES]
    return df.withColumn("__shares", F.array(*shares)).withColumn("__stratum", F.coalesce(F.col("lang").cast("string"), F.lit("")))


def labelled(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, shares, good, holdout) of the labelled documents the base rule keeps."""
    known = labels.select(F.col("doc_id").alias("__id"), "quality").filter("__id IS NOT NULL AND quality IN (0, 1)").distinct()
    rows = with_shares(counted).filter(~F.col("base_failed"))
    rows = rows.select("doc_id", "__stratum", "__shares").join(known, F.col("doc_id") == F.col("__id"))
    return rows.select("__stratum", "__shares", (F.col("quality") == 1).alias("good"),
                       (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) >= "8").alias("holdout"))


def ladders(rows: DataFrame, risk: Risk) -> DataFrame:
    """Per stratum, the candidate cutoffs: (stratum, ladder of (feature, step, cutoff))."""
    first = rows.filter("NOT holdout")
    bins = first.select("__stratum", "good", F.posexplode("__shares").alias("feature", "share")).groupBy(
        "__stratum", "feature", "share").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # At most 101 rows in a window: hundredths.
    all_ = Window.partitionBy("__stratum", "feature")
    down = all_.orderBy(F.col("share").desc())
    bins = bins.select("__stratum", "feature", "share", "bad", F.sum("good").over(down).alias("g"), F.sum("bad").over(down).alias("b"),
                       F.sum("good").over(all_).alias("n_good"), F.sum("bad").over(all_).alias("n_bad"))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("most")) for i, s in enumerate(risk.steps)])
    fit = bins.filter("share > 0 AND bad > 0").withColumn("s", F.explode(steps)).filter(
        (F.col("g") <= F.col("s.most") * F.col("n_good")) & (F.col("b") * F.col("n_good") >= risk.lift * F.col("g") * F.col("n_bad")))
    cutoffs = fit.groupBy("__stratum", "feature", "s.step").agg(F.min("share").alias("cutoff"))
    return cutoffs.groupBy("__stratum").agg(F.sort_array(F.collect_list(F.struct("feature", "step", "cutoff"))).alias("ladder"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), term by term; 1 where k is at least n p, which no test passes."""
    odds = F.lit(p / (1 - p))
    sums = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct(
            F.when(i == 0, a["t"]).otherwise(a["t"] + F.log((n - i + 1) / F.greatest(i, F.lit(1)) * odds)).alias("t"),
            (a["sum"] + F.exp(F.when(i == 0, a["t"]).otherwise(a["t"] + F.log((n - i + 1) / F.greatest(i, F.lit(1)) * odds)))).alias("sum")),
        lambda a: a["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(sums)


def cutoffs(counted: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The cutoffs that stand: (stratum, step, n, k, p_value, rules of (feature, cutoff)); a row for each stratum that has any."""
    rows = stored(labelled(counted, labels), "labelled")
    ladder = stored(ladders(rows, risk), "ladders")  # small, so that its size decides how it is joined
    held = rows.filter("holdout AND good").join(ladder, "__stratum")
    hit = F.filter("ladder", lambda c: F.get("__shares", c["feature"]) >= c["cutoff"])
    at = held.groupBy("__stratum", F.array_min(F.transform(hit, lambda c: c["step"])).alias("falls")).count()
    tests = at.groupBy("__stratum").agg(F.sum("count").alias("n"), *[
        F.coalesce(F.sum(F.when(F.col("falls") <= i, F.col("count"))), F.lit(0)).alias(f"k{i}") for i in range(len(risk.steps))])
    tests = tests.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    tests = tests.withColumn("test", F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.col(f"k{i}").alias("k")) for i in range(len(risk.steps))]))).select("__stratum", "n", "strata", "test.*")
    tests = tests.withColumn("p_value", binomial_tail(F.col("n"), F.col("k"), risk.max_rejected))
    tests = tests.withColumn("stands", F.min(F.col("p_value") <= risk.error / F.col("strata")).over(
        Window.partitionBy("__stratum").orderBy("step")))
    last = tests.filter("stands").groupBy("__stratum").agg(F.max_by(F.struct("step", "n", "k", "p_value"), "step").alias("t"))
    chosen = last.join(ladder, "__stratum").select("__stratum", "t.*", F.transform(
        F.filter("ladder", lambda c: c["step"] == F.col("t.step")), lambda c: F.struct(c["feature"], c["cutoff"])).alias("rules"))
    return stored(chosen, "cutoffs")


def judge(counted: DataFrame, chosen: DataFrame) -> DataFrame:
    """Add `kept`. A row a stratum, written before, `chosen` is broadcast as far as its size allows."""
    rules = chosen.select(F.col("__stratum").alias("__s"), "rules")
    df = with_shares(counted).join(rules, F.col("__stratum") == F.col("__s"), "left")
    broken = F.exists(F.coalesce("rules", F.array()), lambda r: F.get("__shares", r["feature"]) >= r["cutoff"])
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(broken, F.lit(False))).drop("__s", "__stratum", "__shares", "rules")


def quality(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(doc_id, counts, base_failed, kept), a row a document."""
    counted = stored(with_counts(docs.select("doc_id", "lang", "text")).drop("text"), "counts")
    judged = judge(counted, cutoffs(counted, labels, risk))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows that are kept, with their own columns. Counts are made twice, which costs less than to move the texts."""
    own = docs.columns
    counted = stored(with_counts(docs.select("doc_id", "lang", "text")).drop("text"), "counts")
    chosen = cutoffs(counted, labels, risk)
    packed = docs.select(F.struct(*own).alias("__doc"), "doc_id", "lang", "text")
    # A filter over a column that depends on the task stays where it is; pushed down, it would repeat the counts in itself.
    judged = judge(with_counts(packed), chosen).withColumn("__at", F.monotonically_increasing_id())
    return judged.filter("kept AND __at >= 0").select("__doc.*")
