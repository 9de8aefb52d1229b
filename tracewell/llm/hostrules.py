"""Quality rules of documents, and verdicts on their hosts by shrunken failure rates.

All expressions are Spark's own; a text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch

SPLIT = r"[\x20\x09-\x0D]+"
#: Failures of a document, by rule. Only the first two are base rules, which reject it alone.
RULES = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
BASE_RULES = ("short", "repeated")
#: Documents that the prior weighs at most, however alike the hosts are; beyond them a host's own decide.
MOST_PRIOR = 50.0


def measures(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to docs with text.

    Repeated 3-word windows: sorted by hash and place, equal ones are neighbours; in order of
    place each then covers three words, less what the one before covers.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPLIT), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_words": words, "_lines": lines, "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    n = F.size("_words")
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(places, lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_grams": grams,
    })
    some = F.size(F.array_distinct("_grams")) < F.size("_grams")
    ordered = F.array_sort(F.transform("_grams", lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i"))))
    out = out.withColumn("_sorted", F.when(some, ordered))
    s, last = F.col("_sorted"), F.size("_sorted") - 1
    equal = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    twice = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & equal(j, j - 1)) | ((j < last) & equal(j, j + 1)))
    out = out.withColumn("_at", F.when(some, F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))))
    covers = F.transform("_at", lambda p, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), p - F.get("_at", j - 1))))
    covered = F.aggregate(covers, F.lit(0), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_words", "_lines", "_grams", "_sorted", "_at")


def verdict(rule: str, least: float, times: float, deviations: float) -> Column:
    """Whether a host's shrunken rate of ``rule`` is over the bar that the other hosts set.

    The beta prior comes from the moments of the others, weighted by documents: with mean m
    and the variance v that is left beyond sampling, a + b = m (1 - m) / v - 1. The rate is
    (failures + a) / (documents + a + b); the bar is the largest of ``least``, ``times`` m,
    and m plus ``deviations`` standard deviations of the prior. A host alone has no bar.
    Sums over all hosts stand in _n, _hosts, _k_<rule> and _q_<rule> (failures squared by documents).
    """
    n, k = F.col("_n") - F.col("n"), F.col(f"_k_{rule}") - F.col(rule)
    m = F.try_divide(k, n)
    spread = F.try_divide(F.col(f"_q_{rule}") - F.try_divide(F.col(rule) * F.col(rule), F.col("n")), n) - m * m
    beyond = spread - m * (1 - m) * F.try_divide(F.col("_hosts") - 1, n)
    strength = F.when(beyond > 0, F.least(F.lit(MOST_PRIOR), F.greatest(F.lit(1.0), F.try_divide(m * (1 - m), beyond) - 1))).otherwise(F.lit(MOST_PRIOR))
    rate = (F.col(rule) + m * strength) / (F.col("n") + strength)
    bar = F.greatest(F.lit(least), times * m, m + deviations * F.sqrt(m * (1 - m) / (strength + 1)))
    return F.coalesce(rate > bar, F.lit(False))


def host_rules(docs: DataFrame, host: str = "source", least: float = 0.2, times: float = 2.0, deviations: float = 3.0) -> DataFrame:
    """Measures and verdict of each row of docs (doc_id, text and the column ``host``).

    A host is rejected if for any rule its shrunken failure rate is over a bar (``verdict``)
    that the other hosts' rates set. Returns doc_id, host, the measures, base_failed,
    host_rejected and kept (neither of the two).

    A null or empty text has no words and fails. A null host is a host like others. Repeated
    rows and rows without an id are judged each by itself. An empty table gives an empty
    result. Windows of three words count as equal if their 64-bit hashes are. A text's words
    are arrays of its row, so a text must stay well below the 2 GB that a row may have.
    """
    scratch = Scratch(docs.sparkSession)
    base = measures(docs.select("doc_id", F.col(host).cast("string").alias("host"), "text")).drop("text")
    base = scratch.table(base.withColumns({f"_{k}": F.expr(v) for k, v in RULES.items()}))
    counts = base.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"_{k}").cast("double")).alias(k) for k in RULES))
    counts = scratch.table(counts)
    squares = (F.sum(F.col(k) * F.col(k) / F.col("n")).alias(f"_q_{k}") for k in RULES)
    total = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_hosts"), *(F.sum(k).alias(f"_k_{k}") for k in RULES), *squares).first()
    judged = counts.withColumns({k: F.lit(v) for k, v in total.asDict().items()})
    rejected = F.lit(False)
    for k in RULES:
        rejected = rejected | verdict(k, least, times, deviations)
    verdicts = judged.select(F.col("host").alias("_host"), rejected.alias("host_rejected"))
    out = base.join(verdicts, F.col("host").eqNullSafe(F.col("_host")))
    failed = F.greatest(*(F.col(f"_{k}") for k in BASE_RULES))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")
