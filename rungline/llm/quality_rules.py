"""Operator 8, quality rules with risk-controlled thresholds (DataFrame and SQL functions only).

Each rule rejects documents whose measure lies above a cutoff. Every stratum has a path of settings of all rules together, from the
loosest to the tightest, made from one half of its labelled good documents that pass the base rules: above their largest measures by ever
less, then at ever lower quantiles. The other half is the holdout. Along the path settings are tested in a fixed sequence: with k of n
holdout documents rejected by any rule, a setting is certified if P(Binomial(n, max_false) <= k) is at most error / strata, the exact
one-sided bound with Bonferroni's correction for the strata, and the first setting that isn't ends the sequence (which is why its steps
need no correction). So with probability 1 - error the rules together reject at most max_false of the good documents of any stratum. The
tightest certified setting holds; without one, as where the holdout is too small for any bound, a stratum has the base rules only.

Null or empty text has no words (base_failed). A null stratum is a stratum of its own. Repeated and null doc_ids keep their rows; a label
counts for each row of its doc_id. Very long texts count whole; an empty table gives no rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mean_word")
#: The path: multiples of the largest measure in the first half, then quantiles there.
WIDER = (3.0, 2.0, 1.5, 1.25, 1.1, 1.0)
QUANTILES = (0.9995, 0.999, 0.998, 0.997, 0.996, 0.995, 0.994, 0.993, 0.992, 0.991, 0.99)
STEPS = len(WIDER) + len(QUANTILES)


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The base measures of every whole text beside the columns `keep`."""
    t = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    t = t.withColumn("__s", F.expr(r"trim(BOTH ' \t\n\u000b\u000c\r' FROM __t)"))
    t = t.withColumn("__w", F.expr(r"CASE WHEN __s = '' THEN cast(array() AS array<string>) ELSE split(__s, '[\\x20\\x09-\\x0D]+') END"))
    t = t.withColumn("__lines", F.expr(r"filter(split(__t, '\n'), l -> trim(BOTH ' \t\n\u000b\u000c\r' FROM l) <> '')"))
    # windows as 'a b c place', sorted, so that equal windows are neighbours; a word holds no space
    t = t.withColumn("__g", F.expr("CASE WHEN size(__w) < 3 THEN cast(array() AS array<string>) ELSE array_sort(transform(sequence(0, size(__w) - 3), i -> concat_ws(' ', __w[i], __w[i + 1], __w[i + 2], i))) END"))
    same = "substring_index(a, ' ', 3) = substring_index(b, ' ', 3)"
    place = "cast(substring_index({0}, ' ', -1) AS int) + {1}"
    six = ", ".join(place.format(x, k) for x in "ab" for k in range(3))
    t = t.withColumn("__r", F.expr(f"size(array_distinct(flatten(filter(zip_with(slice(__g, 1, greatest(size(__g) - 1, 0)), slice(__g, 2, greatest(size(__g) - 1, 0)), (a, b) -> CASE WHEN {same} THEN array({six}) END), x -> x IS NOT NULL))))"))
    return t.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.expr(r"cast(size(split(__t, '[#*$%&|<>]', -1)) - 1 AS long)").alias("n_symbols"),
        F.expr("cast(size(__lines) - size(array_distinct(__lines)) AS long)").alias("n_dup_lines"),
        F.col("__r").cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.expr("cast(size(split(__t, '[A-Z]', -1)) - 1 AS long)").alias("n_upper"),
    )


def _shares(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "mean_word": F.col("word_chars") / words,
    })


def most_allowed(n: int, max_false: float, error: float) -> int:
    """The largest k with P(Binomial(n, max_false) <= k) <= error, or -1. The tail below k is summed downward until it adds nothing."""
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(max_false) + (n - k) * math.log1p(-max_false)

    def tail(k: int) -> float:
        total, term = 0.0, math.exp(log(k))
        while k >= 0 and term > total * 1e-17:
            total += term
            term *= k * (1 - max_false) / ((n - k + 1) * max_false)
            k -= 1
        return total

    low, high = -1, int(n * max_false)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if tail(mid) <= error else (low, mid - 1)
    return low


def paths(good: DataFrame, stratum: str) -> DataFrame:
    """For each stratum of the first half: __s, and for each rule its cutoffs from the loosest to the tightest."""
    agg = []
    for r in RULES:
        wide = [F.max(r) * w + F.lit(0.01 * (w > 1)) for w in WIDER]
        fine = F.percentile_approx(r, list(QUANTILES), 10_000)
        agg.append(F.concat(F.array(*wide), fine).alias(f"path_{r}"))
    return good.groupBy(F.col(stratum).alias("__s")).agg(*agg)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, max_false: float, error: float, most_strata: int = 10_000) -> DataFrame:
    """__s and a cutoff of each rule, for each stratum with a certified setting. At most most_strata strata, of STEPS rows each, come to the driver."""
    if measured.select(stratum).distinct().limit(most_strata + 1).count() > most_strata:
        raise ValueError(f"more than {most_strata} strata in {stratum}")
    good = measured.join(labels.where("quality = 1").select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id") == F.col("__id"), "left_semi").where(~F.col("base_failed"))
    half = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("|half")).cast("binary")) % 2
    path = written(paths(good.where(half == 0), stratum), "paths")  # percentiles may differ when made again: the setting tested is the one used
    held = good.where(half == 1).join(path, F.col(stratum).eqNullSafe(F.col("__s")))
    # the first step of the path that rejects a document by any rule
    first = F.least(*[F.size(F.filter(f"path_{r}", lambda c: c >= F.col(r))) for r in RULES])  # noqa: B023
    counts = held.groupBy("__s", first.alias("step")).agg(F.count("*").alias("n")).collect()
    steps: dict = {}
    for r in counts:
        steps.setdefault(r["__s"], [0] * (STEPS + 1))[r.step] = r.n
    chosen = []
    for s, n in steps.items():
        most, rejected, last = most_allowed(sum(n), max_false, error / len(steps)), 0, None
        for k in range(STEPS):
            rejected += n[k]
            if rejected > most:
                break
            last = k
        if last is not None:
            chosen.append((s, last))
    kind = measured.schema[stratum].dataType.simpleString()
    steps_ = measured.sparkSession.createDataFrame(chosen, f"__t {kind}, __k int")
    return path.join(F.broadcast(steps_), F.col("__s").eqNullSafe(F.col("__t"))).select("__s", *[F.get(f"path_{r}", F.col("__k")).alias(f"cut_{r}") for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for each row."""
    measured = _shares(written(measures(docs, ["doc_id", stratum]), "measures"))
    cuts = written(cutoffs(measured, labels, stratum, max_false, error), "cutoffs")  # a row for each of at most most_strata strata
    both = measured.join(F.broadcast(cuts), F.col(stratum).eqNullSafe(F.col("__s")), "left")
    rejected = F.greatest(*[F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES])
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
