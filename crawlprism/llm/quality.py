"""Quality rules by host: page rules, failure rates per host shrunk by an empirical beta prior.

Every document gets the base measures of its text and a verdict of the page rules. Failures are
counted per host; the prior Beta(a, b) is fitted to the hosts' rates by moments, and shrinks a host's
rate to r = (a + failures) / (a + b + documents). A host is rejected if even the lower bound of that
rate, r less `BOUND` standard deviations of the posterior, is above `max_host_rate`: a few bad pages of
a small host do not condemn its good ones, and a large host is judged by its own rate. A document is
kept if it passes the page rules and its host is not rejected.

Defined cases: a null or empty text has no words and fails. Null hosts are one host. Without
documents there are no hosts and no rows; with one host, or hosts that all have the same rate, the
prior is as strong as `strongest_prior` documents. Repeated rows count each. Other columns are
dropped by `base_measures` and carried by `judge`, whose own columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlprism.llm.common import BLANK, WORD, words, stored

SYMBOLS = r"#*$%&|<>"
RUN = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_HOST_RATE = 0.5
STRONGEST_PRIOR = 1000.0
BOUND = 1.645
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x + y)


def base_measures(docs: DataFrame, *, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, the five measures (long) and `base_failed`, in one pass without a shuffle."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    read = docs.select(
        *[F.col(c).alias(f"__{c}") for c in carry],
        F.length(F.regexp_replace(text, BLANK + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("hashes"),
    )
    starts = F.sequence(F.lit(0), F.size("hashes") - RUN)
    runs = F.when(
        F.size("hashes") >= RUN,
        F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(RUN)])),
    )
    keyed = [F.col(f"__{c}") for c in carry]
    counted = read.select(
        *keyed, "word_chars", "n_symbols",
        F.size("hashes").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        runs.alias("runs"),
    )
    # Only texts with a repeated run pay for sorting their runs.
    repeated = F.col("runs").isNotNull() & (F.size(F.array_distinct("runs")) < F.size("runs"))
    placed = F.when(repeated, F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = counted.select(*keyed, *[m for m in MEASURES if m != "n_repeat_words"], placed.alias("placed"))
    nothing = F.lit(None).cast("struct<h:bigint,i:int>")
    before = F.concat(F.array(nothing), F.slice("placed", 1, F.size("placed") - 1))
    after = F.concat(F.slice("placed", 2, F.size("placed") - 1), F.array(nothing))
    beside = F.zip_with(before, after, lambda b, a: F.struct(b.h.alias("b"), a.h.alias("a")))
    twice = F.zip_with(
        "placed", beside, lambda p, s: F.when(p.h.eqNullSafe(s.b) | p.h.eqNullSafe(s.a), p.i)
    )
    found = ordered.select(
        *keyed, *[m for m in MEASURES if m != "n_repeat_words"],
        F.when(F.col("placed").isNotNull(), F.sort_array(F.array_compact(twice))).alias("found"),
    )
    gaps = F.zip_with(
        F.slice("found", 1, F.size("found") - 1), F.slice("found", 2, F.size("found") - 1),
        lambda x, y: F.least(y - x, F.lit(RUN)).cast("long"),
    )
    covered = F.when(F.col("found").isNull(), F.lit(0).cast("long")).otherwise(_total(gaps) + RUN)
    measured = found.select(
        *[F.col(f"__{c}").alias(c) for c in carry],
        *[F.col(m) if m != "n_repeat_words" else covered.alias(m) for m in MEASURES],
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, *, host_column: str = "source", max_host_rate: float = MAX_HOST_RATE,
                  strongest_prior: float = STRONGEST_PRIOR) -> DataFrame:
    """One row per host: host, n_docs, n_failed, host_rate (shrunk), host_rejected.

    Moments over hosts, weighted by their documents: mean m and variance v of the rates, v reduced by
    the sampling variance m (1 - m) * hosts / documents; the prior's weight is m (1 - m) / v - 1.
    """
    hosts = measured.groupBy(F.col(host_column).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    hosts = stored(hosts, "host_counts")
    moments = hosts.agg(
        F.sum("n_docs").alias("docs"),
        F.count(F.lit(1)).alias("hosts"),
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        (F.sum(F.col("n_docs") * rate * rate) / F.sum("n_docs")).alias("square"),
    ).first()
    mean, weight = beta_prior(moments.docs, moments.hosts, moments.mean, moments.square, strongest_prior)
    shrunk = (F.lit(mean) * F.lit(weight) + F.col("n_failed")) / (F.lit(weight) + F.col("n_docs"))
    rated = hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"))
    rate, total = F.col("host_rate"), F.lit(weight) + F.col("n_docs")
    low = rate - BOUND * F.sqrt(rate * (1 - rate) / (total + 1))
    return rated.withColumn("host_rejected", low > max_host_rate)


def beta_prior(docs: int | None, hosts: int, mean: float | None, square: float | None, strongest: float):
    """Mean and weight (a + b) of the prior that fits the hosts' rates by moments."""
    if not docs:
        return 0.0, strongest
    spread = mean * (1 - mean)
    variance = square - mean * mean - spread * hosts / docs
    if variance * strongest <= spread:
        return mean, strongest
    return mean, max(spread / variance - 1, 1.0)


def judge(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
          max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per document: id, host, measures, base_failed, host_rate and kept. The measures are written once
    and read for the host table and for the verdicts; texts are never shuffled."""
    measured = stored(
        base_measures(docs, text_column=text_column, carry=(id_column, host_column)), "measures"
    )
    hosts = stored(host_verdicts(measured, host_column=host_column, max_host_rate=max_host_rate), "hosts")
    verdict = hosts.select(F.struct("host", "host_rate", "host_rejected").alias("__host"))
    return measured.join(verdict, measured[host_column].eqNullSafe(F.col("__host.host"))).select(
        *measured.columns,
        F.col("__host.host_rate").alias("host_rate"),
        (~F.col("base_failed") & ~F.col("__host.host_rejected")).alias("kept"),
    )


def keep_good(docs: DataFrame, *, text_column: str = "text", host_column: str = "source",
              max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that `judge` keeps, with their own columns.

    One pass measures the texts and writes the documents that pass the page rules; of the others only
    the host is written, for the host table.
    """
    whole = F.struct(*docs.columns)
    flagged = base_measures(
        docs.select(whole.alias("row"), F.col(text_column).alias("__text"), F.col(host_column).alias("host")),
        text_column="__text", carry=("row", "host"),
    )
    passed = stored(
        flagged.select("host", "base_failed", F.when(~F.col("base_failed"), F.col("row")).alias("row")), "passed"
    )
    hosts = stored(host_verdicts(passed, host_column="host", max_host_rate=max_host_rate), "hosts")
    bad = hosts.where("host_rejected").select(F.col("host").alias("bad"))
    good = passed.where(~F.col("base_failed"))
    return good.join(bad, good["host"].eqNullSafe(bad["bad"]), "left_anti").select("row.*")
