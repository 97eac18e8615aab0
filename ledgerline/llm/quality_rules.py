"""Quality rules with risk-controlled cutoffs, DataFrame expressions only.

Each rule is a signal of the text and a fixed grid of cutoffs, loosest first. A
text is rejected if a signal reaches the cutoff chosen for its stratum (the
language; null is a stratum of its own). A cutoff is admitted if the exact
binomial test on labelled good texts shows, at level ``DELTA / (strata *
rules)``, that it rejects less than ``ALPHA / rules`` of the good texts of the
stratum; the strictest admitted cutoff is used. Within a rule the grid is a
fixed sequence of nested rejections (testing stops at the first failure), so
only the rules and strata need the Bonferroni correction. With probability
1 - DELTA the false rejections of every stratum stay below ALPHA. Strata with
too few labelled good texts admit nothing and reject nothing.

Words are runs of characters other than space and tab..CR. Null texts have no
words and fail the base rule. Repeated rows and rows with a null id are
measured like any other; a label of an id counts once per row with that id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import save

ALPHA, DELTA = 0.02, 0.05
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: rule -> (signal expression over the measured columns, cutoffs from loose to strict)
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01]),
    "long_words": ("word_chars / greatest(n_words, 1)", [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.0]),
    "short_words": ("n_words / greatest(word_chars, 1)", [0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25]),
}


def measure(df: DataFrame, id_col="doc_id", text_col="text", stratum_col: str | None = "lang") -> DataFrame:
    """id, stratum and the counts of every text.

    ``n_repeat_words``: 8-word windows are compared by 64-bit hash inside one
    text; a position is counted if a window that occurs twice covers it.
    Texts whose window hashes are all distinct (most) skip the sort.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    text = df.select(F.col(id_col).alias("_id"), stratum.alias("stratum"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    split = text.select(
        "_id", "stratum",
        F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), "").alias("_words"),
        F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("_lines"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"))
    counted = split.select(
        "_id", "stratum", "n_symbols", "word_chars",
        F.size("_words").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"if(size(_words) > {WINDOW}, transform(sequence(1, size(_words) - {WINDOW - 1}), "
               f"i -> xxhash64(slice(_words, i, {WINDOW}))), cast(array() as array<bigint>))").alias("_h"))
    doubled = counted.select(
        "_id", "stratum", "n_symbols", "word_chars", "n_words", "n_lines", "n_dup_lines",
        F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, i) -> "
               "named_struct('h', h, 'i', i))), null)").alias("_s"))
    # a window is repeated if a neighbour in hash order has its hash
    repeated = doubled.withColumn("_p", F.expr(
        "sort_array(filter(zip_with(_s, zip_with(concat(array(null), _s.h), concat(slice(_s.h, 2, size(_s)), array(null)), "
        "(a, b) -> named_struct('a', a, 'b', b)), (s, n) -> if(s.h <=> n.a or s.h <=> n.b, s.i, null)), p -> p is not null))"))
    covered = F.expr(
        f"coalesce(aggregate(zip_with(_p, concat(slice(_p, 2, size(_p)), array(2147483647)), "
        f"(p, q) -> least({WINDOW}, q - p)), 0, (a, x) -> a + x), 0)")
    return repeated.select(F.col("_id").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_lines",
                           "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def base_failed(words="n_words", repeats="n_repeat_words"):
    return (F.col(words) < MIN_WORDS) | (100 * F.col(repeats) > MAX_REPEAT_PERCENT * F.col(words))


def allowed_rejections(n, alpha: float, level):
    """Largest k with P(Binomial(n, alpha) <= k) <= level, -1 if none: an
    expression over columns or SQL texts ``n`` and ``level``. Terms are summed
    from log space, where each follows from the one before."""
    return F.expr(f"""aggregate(sequence(0, cast(ceil({n} * {alpha!r}D) as int)),
        named_struct('term', {n} * ln(1 - {alpha!r}D), 'sum', 0D, 'k', -1),
        (s, k) -> named_struct(
            'term', s.term + ln(greatest({n} - k, 0.5D)) - ln(k + 1D) + ln({alpha!r}D / (1 - {alpha!r}D)),
            'sum', s.sum + if(k <= {n}, exp(s.term), 0D),
            'k', if(s.sum + if(k <= {n}, exp(s.term), 0D) <= {level} and s.k = k - 1, k, s.k)),
        s -> s.k)""")


def calibrate(measured: DataFrame, good_ids: DataFrame, id_col="doc_id", alpha=ALPHA, delta=DELTA) -> DataFrame:
    """stratum, n_good, allowed and one ``cut_<rule>`` column (null: none
    admitted) per rule, from the measured texts whose id is in ``good_ids``
    and which pass the base rule. One row per stratum."""
    good = measured.join(good_ids.select(F.col(id_col)), id_col).where(~base_failed())
    counts = [F.sum(F.when(F.expr(signal) >= F.lit(float(cut)), 1).otherwise(0)).alias(f"_{rule}_{k}")
              for rule, (signal, cuts) in RULES.items() for k, cut in enumerate(cuts)]
    per = good.groupBy("stratum").agg(F.count("*").alias("n_good"), *counts)
    tested = per.withColumn("_strata", F.count("*").over(W.partitionBy(F.lit(1))))   # a row per stratum
    level = f"({delta!r}D / (_strata * {len(RULES)}))"
    tested = tested.withColumn("allowed", allowed_rejections("n_good", alpha / len(RULES), level))
    chosen = []
    for rule, (_, cuts) in RULES.items():
        pick = F.lit(None).cast("double")
        for k, cut in enumerate(cuts):                       # nested: the last one admitted is the strictest
            pick = F.when(F.col(f"_{rule}_{k}") <= F.col("allowed"), F.lit(float(cut))).otherwise(pick)
        chosen.append(pick.alias(f"cut_{rule}"))
    return tested.select("stratum", "n_good", "allowed", *chosen)


def judge(measured: DataFrame, cutoffs: DataFrame, id_col="doc_id") -> DataFrame:
    """The measured rows with ``base_failed`` and ``kept``. ``cutoffs`` has a
    row per stratum; strata without one reject nothing."""
    rejected = F.lit(False)
    for rule, (signal, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(signal) >= F.col(f"cut_{rule}"), F.lit(False))
    return (measured.join(cutoffs, "stratum", "left")
            .select(id_col, "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept")))


def apply_rules(df: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", stratum_col: str | None = "lang",
                good="quality = 1") -> DataFrame:
    """Measure, calibrate on the labelled good texts, judge every text."""
    measured = save(measure(df, id_col, text_col, stratum_col), "quality-measured")
    cutoffs = save(calibrate(measured, labels.where(good), id_col), "quality-cutoffs")
    return judge(measured, cutoffs, id_col)
