"""Quality rules whose cutoffs carry a risk guarantee.

A rule rejects a document whose measure exceeds a cutoff. For each stratum and
rule, labelled good documents test the cutoffs from the most lenient down: a
cutoff holds if the exact binomial chance of so few false rejections, were the
true rate ``alpha``, is at most ``delta`` divided by the number of strata and
rules (Bonferroni; within a rule, testing in fixed order stops at the first
failure, so no further correction is due). With chance ``1 - delta`` every
cutoff that holds rejects at most ``alpha`` of the good documents of its
stratum. Of those the one that separates best is used; a stratum with too few
labels for any cutoff has none, and the rule rejects nothing there.

Everything is a DataFrame expression; the binomial sum uses the saddle-point
form of its largest term and the ratio of neighbouring terms, so it is as exact
for a billion labels as for ten.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.llm.common import BLANKS, join_rows, join_small, stage, text_of, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

#: Measure and its cutoffs from lenient to strict.
RULES: dict[str, tuple[str, Sequence[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "bangs": ("n_bangs / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
}


def measure(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_bangs``.

    A null text has none of anything. Columns of these names are replaced.
    ``window`` is a power of two times four.
    """
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    df = docs.withColumns({
        "_words": words_of(t),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
        "n_bangs": (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long"),
        "_lines": lines,
    })
    # hashes of windows of four words, then of twice as many, up to the window
    four = F.transform("_words", lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in (1, 2, 3)]))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_hashes": four,
    })
    reach = 4
    while reach < window:
        step = reach
        df = df.withColumn("_hashes", F.transform("_hashes", lambda h, i: F.xxhash64(h, F.get("_hashes", i + step))))
        reach *= 2
    df = df.withColumn("_windows", F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (window - 1), F.lit(0))))
    # windows sorted with their places, only where some window comes twice
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    df = df.withColumn("_sorted", F.when(repeats, F.array_sort(placed)))
    twice = F.filter(
        "_sorted",
        lambda x, k: (F.get(F.col("_sorted"), k - 1)["h"] == x["h"]) | (F.get(F.col("_sorted"), k + 1)["h"] == x["h"]),
    )
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_places", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("_places", k + 1) - p, F.lit(window)))),
        F.lit(0), lambda total, x: total + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_words", "_lines", "_hashes", "_windows", "_sorted", "_places"
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _stirling_error(n: Column) -> Column:
    """ln n! minus Stirling's formula; a table by rule for n under 16, the series beyond."""
    small = [0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]
    table = F.array(*[F.lit(x) for x in small])
    m = n * n
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m) / m) / m) / n
    return F.when(n < 16, F.element_at(table, F.least(n, F.lit(15.0)).cast("int") + 1)).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    return x * F.log(x / mean) + mean - x


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """Chance of at most ``k`` of ``n`` at ``rate``; 1 where ``k`` is at the mean or above (no evidence).

    The sum runs down from its largest term until terms are below 1e-30 of it.
    """
    k, n, q = k.cast("double"), n.cast("double"), 1 - rate
    rest = n - k
    inner = F.exp(
        _stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - _deviance(k, n * rate) - _deviance(rest, n * q)
    ) * F.sqrt(n / (2 * math.pi * k * rest))
    largest = F.when(k == 0, F.exp(n * math.log(q))).otherwise(inner)
    terms = F.least(k, F.ceil(60 + 12 * F.sqrt(n * rate * q))).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def lower(acc: Column, j: Column) -> Column:
        i = k - j + 1
        term = acc["term"] * i / (n - i + 1) * (q / rate)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, lower, lambda acc: acc["sum"])
    return F.when((n <= 0) | (k >= n * rate), F.lit(1.0)).otherwise(F.least(F.lit(1.0), largest * total))


def cutoffs(
    labelled: DataFrame, stratum: str, good: str, rules: Mapping[str, tuple[str, Sequence[float]]], alpha: float, delta: float
) -> DataFrame:
    """``stratum, rule, cutoff, good, false_rejected, bad_rejected, p_value`` of the chosen cutoffs.

    ``labelled`` carries the measures, the stratum (null is one of its own) and
    ``good`` (1 good, 0 bad; null rows are left out). Rows are counted per
    stratum, rule and interval of cutoffs before anything is shuffled.
    """
    passed = [
        F.struct(F.lit(name).alias("rule"), reduce(lambda a, b: a + b, [(F.expr(expr) > c).cast("int") for c in grid]).alias("level"))
        for name, (expr, grid) in rules.items()
    ]
    counts = labelled.where(F.col(good).isNotNull()).select(
        F.col(stratum).alias("stratum"), F.col(good).alias("good"), F.explode(F.array(*passed)).alias("p")
    ).groupBy("stratum", "p.rule", "p.level").agg(
        F.count_if(F.col("good") == 1).alias("n_good"), F.count_if(F.col("good") == 0).alias("n_bad")
    )
    # a level is how many cutoffs a value exceeds, the strictest first; a cutoff rejects its own level and those above
    # every cutoff of every stratum, also where no value lies between two
    grid = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(len(cs) - i).alias("level"), F.lit(float(c)).alias("cutoff"))
        for name, (_, cs) in rules.items() for i, c in enumerate(cs)
    ])
    strata = counts.select("stratum").distinct()
    all_levels = strata.select("stratum", F.explode(grid).alias("g")).select("stratum", "g.rule", "g.level", "g.cutoff").unionByName(
        strata.select("stratum", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule"), F.lit(0).alias("level"), F.lit(None).cast("double").alias("cutoff"))
    )
    tallied = all_levels.select(*all_levels.columns, F.lit(0).alias("n_good"), F.lit(0).alias("n_bad")).unionByName(
        counts.select("stratum", "rule", "level", F.lit(None).cast("double").alias("cutoff"), "n_good", "n_bad")
    ).groupBy("stratum", "rule", "level").agg(F.max("cutoff").alias("cutoff"), F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad"))
    own = W.partitionBy("stratum", "rule")
    rejected = own.orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, 0)
    tests = strata.agg(F.count(F.lit(1)).alias("_strata"))
    tallied = tallied.select(
        "stratum", "rule", "level", "cutoff", F.sum("n_good").over(own).alias("good"), F.sum("n_bad").over(own).alias("bad"),
        F.sum("n_good").over(rejected).alias("false_rejected"), F.sum("n_bad").over(rejected).alias("bad_rejected"),
    ).where("level > 0").crossJoin(F.broadcast(tests))  # one row
    tallied = tallied.withColumn("p_value", binomial_tail(F.col("false_rejected"), F.col("good"), alpha))
    held = F.col("p_value") <= delta / (F.col("_strata") * len(rules))
    so_far = own.orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, 0)
    gain = F.coalesce(F.try_divide("bad_rejected", "bad"), F.lit(0.0)) - F.coalesce(F.try_divide("false_rejected", "good"), F.lit(0.0))
    best = tallied.withColumn("_holds", F.min(held.cast("int")).over(so_far)).where("_holds = 1").withColumn("_gain", gain).where("_gain > 0")
    pick = F.max_by(
        F.struct("cutoff", "good", "false_rejected", "bad_rejected", "p_value"), F.struct("_gain", F.col("level").alias("lenient"))
    )
    return best.groupBy("stratum", "rule").agg(pick.alias("c")).select("stratum", "rule", "c.*")


def judge(
    measured: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", label: str = "quality",
    rules: Mapping[str, tuple[str, Sequence[float]]] = RULES, alpha: float = 0.005, delta: float = 0.05,
    base: Column | None = None,
) -> DataFrame:
    """Add ``base_failed``, ``rules_failed`` (names) and ``kept`` to measured documents.

    ``measured`` comes from :func:`measure`, staged or cheap to read twice. Labels
    with a null id or value are left out; of several labels of a document the
    lowest counts; repeated documents count each. Without labels, or where they
    are too few, only the base rule rejects. A null stratum is a stratum. An empty
    table gives no row. Each rule rejects at most ``alpha`` of a stratum's good
    documents, all rules of a stratum together so ``alpha`` times their number,
    with chance ``1 - delta``.
    """
    failed = base_failed() if base is None else base
    of_doc = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_label_id")).agg(F.min(label).alias("_good"))
    # the base rule comes first: the others are set on what it leaves
    needed = sorted({c for c in measured.columns if any(c in expr for expr, _ in rules.values())})
    left = measured.where(~failed).select(F.col(doc_id).alias("_doc_id"), F.col(stratum).alias("_stratum"), *needed)
    labelled = join_rows(left, of_doc, F.col("_doc_id") == F.col("_label_id"))
    found = stage(cutoffs(labelled, "_stratum", "_good", rules, alpha, delta), "cutoffs")
    limits = found.groupBy(F.col("stratum").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_limits"))
    judged = join_small(measured, limits, [(stratum, "_s")])
    broken = [F.when(F.expr(expr) > F.element_at("_limits", F.lit(name)), F.lit(name)) for name, (expr, _) in rules.items()]
    return judged.withColumns({
        "base_failed": failed, "rules_failed": F.array_compact(F.array(*broken)),
    }).withColumn("kept", ~F.col("base_failed") & (F.size("rules_failed") == 0)).drop("_limits")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang", **kw) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their columns."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in at.items()])
    known = labels.select(F.col(doc_id).alias(at[doc_id]), F.col(kw.get("label", "quality")).alias("quality"))
    kw.pop("label", None)
    judged = judge(stage(measure(plain, at[text]), "measured"), known, at[stratum], at[doc_id], **kw)
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in at.items()])
