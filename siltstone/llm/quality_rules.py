"""Quality rules whose cutoffs carry a guarantee (risk control), in DataFrame expressions only.

Every document gets a few integer measures. For each stratum (language) and rule a cutoff is chosen
from labelled documents so that, with probability 1 - delta over all strata and rules together, at most
a share alpha of the good documents of a stratum is rejected by all rules:

* n good labelled documents of a stratum, k of them beyond a cutoff: the exact (Clopper-Pearson) upper
  bound of the false rejection rate is at most a  <=>  P(Binomial(n, a) <= k) <= d.
* Multiple testing: a = alpha / rules (the rules' rejections add up) and d = delta / (rules * strata)
  (Bonferroni). Inside one stratum and rule the cutoffs are nested and are tested from the loosest to
  the strictest until one fails (fixed sequence), which needs no further correction.
* Among the cutoffs so permitted, the one with the largest (share of bad rejected - share of good
  rejected) wins, the loosest on ties; a cutoff that rejects no labelled bad document is not used.

Plan: one scan with the text computes the measures; these narrow rows are stored once. Labels join on
the narrow rows. Histograms of at most (strata * rules * 1001) rows give the cutoffs, one row a stratum.

Defined cases: null or empty text has no words (base rules fail it); a null stratum is a stratum of its
own; a stratum with too few labels gets no cutoff and keeps what passes the base rules; null labels are
ignored, a document labelled twice counts once, as bad if any label says so; repeated rows give repeated
rows; an empty table gives an empty result; columns other than those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.shared import let, only_columns, stored, words

ALPHA, DELTA = 0.05, 0.1
#: Measures are scaled to integers from 0 to STEPS; a rule rejects documents above its cutoff.
STEPS = 1000
RULES = ("symbols", "dup_lines", "repeats", "bangs", "pipes", "capitals")


def _duplicate_positions(grams: Column) -> Column:
    """Ascending positions of the elements that occur twice or more in an array of hashes."""
    tagged = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def find(s):
        same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])

    return F.sort_array(let(tagged, find))


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """Number of words inside a window of `width` words that occurs twice or more among tokens."""
    starts = lambda w: F.when(F.size(w) > width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
    grams = let(tokens, lambda w: F.transform(starts(w), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))
    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(width), x - a["last"])).cast("long").alias("n"), x.cast("int").alias("last")),
        lambda a: a["n"],
    )
    return let(_duplicate_positions(grams), covered)


def duplicate_lines(text: Column) -> Column:
    """Number of \\n-split lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _count_of(text: Column, characters: str) -> Column:
    """Number of characters of text that are among characters."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum, the base counts, and one integer from 0 to STEPS for each rule."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = only_columns(df, id_col, text_col, stratum_col).toDF("doc_id", "text", "stratum")
    out = out.select("doc_id", "stratum", "text", words(F.col("text")).alias("tokens"))
    out = out.select(
        "doc_id",
        "stratum",
        F.size("tokens").cast("long").alias("n_words"),
        F.aggregate("tokens", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        _count_of(text, "#*$%&|<>").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(F.col("tokens")).alias("n_repeat_words"),
        F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"),
        _count_of(text, "!").alias("n_bangs"),
        _count_of(text, "|").alias("n_pipes"),
        _count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
    )
    scaled = lambda n, of: F.least(F.lit(STEPS), F.floor(STEPS * F.col(n) / F.greatest(F.lit(1), F.col(of)))).cast("int")
    return out.select(
        "*",
        scaled("n_symbols", "word_chars").alias("symbols"),
        scaled("n_dup_lines", "n_lines").alias("dup_lines"),
        scaled("n_repeat_words", "n_words").alias("repeats"),
        scaled("n_bangs", "word_chars").alias("bangs"),
        scaled("n_pipes", "word_chars").alias("pipes"),
        scaled("n_capitals", "word_chars").alias("capitals"),
    ).drop("n_lines", "n_bangs", "n_pipes", "n_capitals")


def allowed_rejections(n: Column, rate: float, risk: Column) -> Column:
    """Largest k with P(Binomial(n, rate) <= k) <= risk, or -1: the exact test. Sums the probabilities from k = 0
    by their ratio, in logarithms; no k above n * rate can pass, which bounds the sum."""
    odds = float(rate / (1.0 - rate))
    start = F.struct(
        (n * float(_log1m(rate))).alias("logp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k")
    )

    def step(a, i):
        cdf = a["cdf"] + F.exp(a["logp"])
        nxt = a["logp"] + F.log((n - i) / (i + 1) * F.lit(odds))
        return F.struct(
            F.coalesce(nxt, F.lit(-1e308)).alias("logp"), cdf.alias("cdf"), F.when(cdf <= risk, i.cast("long")).otherwise(a["k"]).alias("k")
        )

    return F.aggregate(F.sequence(F.lit(0), F.floor(n * rate).cast("int")), start, step, lambda a: a["k"])


def _log1m(rate: float) -> float:
    import math

    return math.log1p(-rate)


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: tuple[str, ...] = RULES) -> DataFrame:
    """stratum, rule, cutoff: from rows (stratum, good boolean, one integer column a rule). A rule without a
    cutoff permitted and useful in a stratum has no row."""
    long = labelled.select(
        "stratum", "good", F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in rules]), F.array(*[F.col(r) for r in rules]))).alias("rule", "value")
    )
    bins = long.groupBy("stratum", "rule", "value").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    whole = Window.partitionBy("stratum", "rule")
    above = whole.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    tails = bins.select(
        "stratum",
        "rule",
        F.col("value").alias("cutoff"),
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("k"),
        F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("caught"),
        F.sum("good").over(whole).alias("n_good"),
        F.sum("bad").over(whole).alias("n_bad"),
    )
    each = tails.groupBy("stratum", "rule").agg(F.max("n_good").alias("n"))
    # Every stratum has one row a rule, so a rule's rows count the strata.
    limits = each.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy("rule"))).select(
        F.col("stratum").alias("s"),
        F.col("rule").alias("r"),
        allowed_rejections(F.col("n"), alpha / len(rules), F.lit(delta / len(rules)) / F.greatest(F.lit(1), F.col("strata"))).alias("allowed"),
    )
    passed = tails.join(limits, tails["stratum"].eqNullSafe(limits["s"]) & (tails["rule"] == limits["r"]))
    gain = F.col("caught") / F.greatest(F.lit(1), F.col("n_bad")) - F.col("k") / F.greatest(F.lit(1), F.col("n_good"))
    passed = passed.where((F.col("k") <= F.col("allowed")) & (F.col("caught") > 0) & (gain > 0))
    return passed.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain.alias("g"), F.col("cutoff").alias("c"))).alias("cutoff"))


def quality_rules(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """All documents with their measures, `base_failed`, `rejected_by` (array of rules) and `kept`."""
    rows = stored(measures(documents, id_col, text_col, stratum_col), "quality")
    marks = only_columns(labels, id_col, label_col).toDF("label_id", "label").where("label IS NOT NULL AND label_id IS NOT NULL")
    marks = marks.groupBy("label_id").agg((F.min("label") > 0).alias("good"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    labelled = rows.where(~base_failed).join(marks, F.col("doc_id") == F.col("label_id")).select("stratum", "good", *RULES)
    table = cutoffs(labelled, alpha, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    # One row a stratum; no row of documents is multiplied. Spark picks the join by the size it measures.
    out = rows.join(table.withColumnRenamed("stratum", "s"), rows["stratum"].eqNullSafe(F.col("s")), "left")
    reject = [F.when(F.col(r) > F.element_at("cutoffs", F.lit(r)), F.lit(r)) for r in RULES]
    out = out.withColumn("base_failed", base_failed).withColumn("rejected_by", F.filter(F.array(*reject), lambda x: x.isNotNull()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("s", "cutoffs")
