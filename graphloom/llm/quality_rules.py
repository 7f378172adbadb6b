"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets rule counts from its whole text.  Hosts (the ``source`` column)
collect how many of their documents fail a rule.  A beta prior is fitted to all hosts: its mean is
the rate of all documents, its spread what the hosts' rates vary beyond the chance of
their sample.  A host's rate is shrunk towards it, and the host takes its documents with it if the
rate is, with a margin for what its number of documents leaves open, above the limit.
The limit is relative to the prior: odds of failure ``MAX_ODDS_RATIO`` times those of all documents.

Defined cases: a null text has no words and fails; a null host is a host of its
own; repeated rows each count and each get a result; a rate exactly at the limit passes; where all
documents fail or none does, no host is worse than the others; an empty
table gives an empty result; long texts are measured whole; columns other than those named are ignored, so
clashing names do no harm (``filter_documents`` carries them through untouched).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import small, table

# Fixed values of the contract.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Parameters of the further rules and of the host verdict.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MAX_ODDS_RATIO = 3.0
#: Standard deviations of the shrunk rate that it must be above the limit.
MARGIN = 2.0
MIN_STRENGTH, MAX_STRENGTH = 2.0, 10_000.0


def words_of(text: Column) -> Column:
    """The words of a text, split at ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def _window_hashes(hashes: Column) -> Column:
    """A 64-bit hash of each run of WINDOW words, from the hashes of the words."""
    n = F.size(hashes)
    return F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words inside windows found twice or more.

    Distinct hashes prove that no window repeats, which settles most documents.  The others
    compare the windows' words themselves: sorted with their positions, equal neighbours repeat.
    """
    n = F.size(windows)
    keyed = F.sort_array(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")),
        )
    )
    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(_covered(_repeated_starts(keyed)))


def _repeated_starts(keyed: Column) -> Column:
    def pick(s: Column) -> Column:
        n = F.size(s)
        return F.sort_array(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), n - 1),
                    lambda j: F.coalesce(F.get(s, j)["w"] == F.get(s, j - 1)["w"], F.lit(False))
                    | F.coalesce(F.get(s, j)["w"] == F.get(s, j + 1)["w"], F.lit(False)),
                ),
                lambda j: F.get(s, j)["i"],
            )
        )

    return _let(keyed, pick)


def _covered(starts: Column) -> Column:
    """Words covered by windows at these sorted starts."""

    def count(p: Column) -> Column:
        return F.when(F.size(p) == 0, 0).otherwise(
            F.aggregate(
                F.sequence(F.lit(1), F.size(p)),
                F.lit(0),
                lambda a, j: a + F.coalesce(F.least(F.lit(WINDOW), F.get(p, j) - F.get(p, j - 1)), F.lit(WINDOW)),
            )
        )

    return _let(starts, count)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: the element of a one-element array is bound in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _counts(text: Column) -> Column:
    """A struct of all counts of a text, as one expression: a filter on a field, pushed below it, repeats no step per element."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def from_words(w: Column) -> Column:
        return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _let(_window_hashes(h), lambda win: _result(w, win)))

    def _result(w: Column, win: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, win).cast("long").alias("n_repeat_words"))

    return F.struct(
        _let(words_of(t), from_words).alias("words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.size(F.split(t, SYMBOL)) - 1).cast("long").alias("n_symbols"),
        _let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
            ),
        ).alias("lines"),
    )


def _counted(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    m = docs.select(*keep, _counts(F.col(text)).alias("_m"))
    return m.select(
        *[c for c in m.columns if c != "_m"],
        "_m.words.n_words",
        "_m.word_chars",
        "_m.n_symbols",
        "_m.lines.n_dup_lines",
        "_m.lines.n_lines",
        "_m.words.n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failed() -> Column:
    """A document fails a rule: the base, too many symbols, or too many repeated lines."""
    return (
        base_failed()
        | (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    )


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed, rule_failed of each row."""
    out = _counted(docs, text, [F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host")])
    return out.select("*", base_failed().alias("base_failed"), rule_failed().alias("rule_failed"))


def host_verdicts(measured: DataFrame, max_odds_ratio: float = MAX_ODDS_RATIO) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, deviation, max_rate, host_ok.

    The prior's variance is that between hosts, weighted by their documents, less what rates of samples
    of their size vary by chance; its strength (documents that it counts for) follows from it, the
    greatest one where nothing is left.
    """
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed")
    )
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(
        F.count(F.lit(1)).cast("double").alias("hosts"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff")
    )
    mean, chance = F.col("f") / F.col("n"), F.col("f") / F.col("n") * (1 - F.col("f") / F.col("n"))
    between = F.col("ff") - F.col("f") * F.col("f") / F.col("n") - (F.col("hosts") - 1) * chance
    room = F.col("n") - F.col("nn") / F.col("n")
    strength = F.when((between > 0) & (room > 0), chance * room / between - 1).otherwise(MAX_STRENGTH)
    prior = sums.select(
        mean.alias("mean"),
        F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), strength)).alias("strength"),
        (max_odds_ratio * mean / (1 + (max_odds_ratio - 1) * mean)).alias("max_rate"),
    )
    weight = F.col("n_docs") + F.col("strength")
    # the prior is one row by construction
    shrunk = hosts.crossJoin(F.broadcast(prior)).withColumn("shrunk_rate", (F.col("n_failed") + F.col("mean") * F.col("strength")) / weight)
    judged = shrunk.withColumn("deviation", F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (weight + 1)))
    ok = F.col("shrunk_rate") - MARGIN * F.col("deviation") <= F.col("max_rate")
    return judged.select("host", "n_docs", "n_failed", "shrunk_rate", "deviation", "max_rate", ok.alias("host_ok"))


def judge(measured: DataFrame, max_odds_ratio: float = MAX_ODDS_RATIO) -> DataFrame:
    """measured with shrunk_rate of its host and kept: not base_failed, and its host passes.

    measured is read twice; pass a written table.  Hosts are broadcast up to a checked number and
    otherwise joined by a shuffle of these short rows, where a hot host is split as a skewed key.
    """
    verdicts = small(host_verdicts(measured, max_odds_ratio).select(F.col("host").alias("_host"), "shrunk_rate", "host_ok"))
    joined = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["_host"]), "left")
    return joined.select(*measured.columns, "shrunk_rate", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of docs: measure's columns, shrunk_rate and kept."""
    return judge(table(measure(docs, doc_id, text, host), "quality-rules"))


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", max_odds_ratio: float = MAX_ODDS_RATIO) -> DataFrame:
    """The rows of docs that are kept, all their columns unchanged.

    Texts are measured once, as the rows that pass the base rules are written; hosts are judged by the short
    columns of that table, and its rows are read again without those of bad hosts.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    counted = _counted(row, f"row.`{text}`", [F.col("row"), F.col(f"row.`{host}`").cast("string").alias("host")])
    ruled = counted.select("host", rule_failed().alias("rule_failed"), F.when(~base_failed(), F.col("row")).alias("row"))
    ruled = table(ruled, "quality-ruled")
    bad = small(host_verdicts(ruled, max_odds_ratio).where(~F.col("host_ok")).select(F.col("host").alias("_host")))
    passed = ruled.where(F.col("row").isNotNull())
    return passed.join(bad, passed["host"].eqNullSafe(bad["_host"]), "left_anti").select("row.*")
