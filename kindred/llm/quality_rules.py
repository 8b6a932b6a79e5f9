"""Quality rules at host level, in DataFrame functions only.

Each document gets its rule counts from its whole text.  Failures are counted
by host (a column; ``domain`` makes one of a URL), every host's failure rate is shrunk
towards an empirical beta prior fitted to all hosts, and a host whose shrunk
rate stays above the threshold takes its documents with it.

Defined cases: a null or empty text has no words and fails the base rule; a
null host is a host of its own, which is never rejected; a host of fewer than
``least_docs`` documents isn't either, whatever its rate; repeated rows count
each time; an empty table gives no rows; other columns are carried through, and
those whose names start with ``__qr_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.runtime import ROW_KEY, without, written

WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WIDTH = 5
#: Most hosts that are broadcast; beyond it the verdicts are joined by a shuffle that Spark may split.
MOST_BROADCAST = 50_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words covered by windows of WIDTH words that occur twice or more in the text."""
    n = F.size(words)

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.filter(s, lambda x, i: (x["g"] == F.get(s, i - 1)["g"]).eqNullSafe(True) | (x["g"] == F.get(s, i + 1)["g"]).eqNullSafe(True)),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(-WIDTH).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WIDTH), x - a["last"])).cast("long").alias("n")),
            lambda a: a["n"],
        )

    grams = F.transform(F.sequence(F.lit(1), n - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(words, i, WIDTH)))
    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))
    return F.when(n <= WIDTH, F.lit(0).cast("long")).otherwise(some)


def measures(text: Column) -> Column:
    """A struct of COUNTS of a text that isn't null."""
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\f\r", "    "))) > 0),
        lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    )
    return let(
        F.array_remove(F.split(text, WORD_GAP), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines.alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def base_failed(m) -> Column:
    """Whether a text has under ten words, or over 20 percent of them in repeated windows."""
    return (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))


#: Rules whose failures are counted by host, as functions of a text's counts by name.
RULES = {
    "base": base_failed,
    "symbols": lambda m: 10 * m("n_symbols") > m("word_chars"),
    "lines": lambda m: (m("n_dup_lines") >= 3) & (5 * m("n_dup_lines") > m("n_words")),
}


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of COUNTS and ``base_failed``, each from the whole text."""
    out = docs.withColumn("__qr_w", measures(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumns({c: F.col(f"__qr_w.{c}") for c in COUNTS}).drop("__qr_w")
    return out.withColumn("base_failed", base_failed(F.col))


def domain(url: Column) -> Column:
    """The host of a URL, in lower case and without a leading ``www.``; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www[.]", "")


def host_rates(counted: DataFrame, host: str = "source", fails: dict[str, Column] | None = None) -> DataFrame:
    """A row for each host: its documents ``n``, failures of each rule, and shrunk rates ``<rule>_rate``.

    ``fails`` are conditions on a row of ``counted``, by default RULES of its counts.

    The prior of a rule is Beta(m*s, (1-m)*s): m is the rate over all
    documents, and s comes from the variance of the hosts' rates less the part
    that sampling explains (method of moments), held in 1 .. 1e6.
    """
    fails = fails or {k: rule(F.col) for k, rule in RULES.items()}
    by_host = written(
        counted.groupBy(F.col(host).alias("__qr_host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in fails.items()]),
        "host-failures",
    )
    moments = [F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("docs"), F.avg(1.0 / F.col("n")).alias("inv")]
    for k in RULES:
        moments += [F.sum(k).alias(f"{k}_f"), F.var_pop(F.col(k) / F.col("n")).alias(f"{k}_v")]
    at = by_host.agg(*moments).first()
    for k in RULES:
        m = (at[f"{k}_f"] or 0) / at["docs"] if at["docs"] else 0.0
        spread = m * (1 - m)
        between = max((at[f"{k}_v"] or 0.0) - spread * (at["inv"] or 0.0), 1e-12)
        s = min(max(spread / between - 1, 1.0), 1e6)
        by_host = by_host.withColumn(f"{k}_rate", (F.col(k) + m * s) / (F.col("n") + s))
    return by_host


def rejected_hosts(counted: DataFrame, host: str, threshold: float, least_docs: int, fails: dict[str, Column] | None = None) -> DataFrame:
    """(__qr_host) of the hosts that the rules reject, to be broadcast up to MOST_BROADCAST of them."""
    rates = host_rates(counted, host, fails)
    bad = F.lit(False)
    for k in RULES:
        bad = bad | (F.col(f"{k}_rate") > threshold)
    rejected = written(rates.filter(bad & (F.col("n") >= least_docs) & F.col("__qr_host").isNotNull()).select("__qr_host"), "rejected-hosts")
    return F.broadcast(rejected) if rejected.count() <= MOST_BROADCAST else rejected


def quality_rules(docs: DataFrame, host: str = "source", text_col: str = "text", threshold: float = 0.5, least_docs: int = 20) -> DataFrame:
    """The columns of ``docs`` but its text, with rule counts, ``base_failed``, ``host_rejected`` and ``kept``.

    The counts are written once, without the texts, and read for both the
    host rates and the result; ``ROW_KEY`` (a hash of the text) stays, to tell rows of
    one id apart.  A host is rejected if it has
    ``least_docs`` documents or more and the shrunk rate of any rule is above
    ``threshold``.  Only rejected hosts are joined back: broadcast up to
    MOST_BROADCAST of them, else shuffled.
    """
    counted = rule_counts(docs, text_col).withColumn(ROW_KEY, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    counted = written(counted.drop(text_col), "rule-counts")
    side = rejected_hosts(counted, host, threshold, least_docs)
    out = counted.join(side, counted[host] == side["__qr_host"], "left")
    out = out.withColumn("host_rejected", F.col("__qr_host").isNotNull()).drop("__qr_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep(docs: DataFrame, host: str = "source", text_col: str = "text", threshold: float = 0.5, least_docs: int = 20, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The rules run once: ids, hashes of texts and the rules they fail are
    written, without texts, and ``docs`` are filtered by them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = let(measures(text), lambda m: F.struct(*[rule(lambda c, m=m: m[c]).alias(k) for k, rule in RULES.items()]))
    slim = docs.select(F.col(id_col), F.col(host).alias("__qr_source"), F.xxhash64(text).alias(ROW_KEY), marks.alias("__qr_fails"))
    slim = written(slim, "rule-failures")
    side = rejected_hosts(slim, "__qr_source", threshold, least_docs, {k: F.col(f"__qr_fails.{k}") for k in RULES})
    good = docs.join(side, docs[host] == side["__qr_host"], "left_anti")
    return without(good, slim.filter("__qr_fails.base").select(id_col, ROW_KEY), id_col, text_col)
