"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of an item is ten consecutive words (all its words, if fewer).  For windows of L
words, k-grams of words are hashed and every run of L - k + 1 hashes keeps its minimum, so two
equal windows always share a kept hash: no shared span is missed.  Kept hashes of the
documents meet those of the items; where they agree, the hit is extended to the windows that
chose that hash, and their words are compared.

The item side is broadcast up to a checked number of rows; beyond it the same join shuffles
short spans of words around each kept hash, never whole texts.

Defined cases: a null or empty text has no words and no hits; an item without words has no
window; an item with a null id hits words but is not listed; equal item ids are one item;
repeated document rows each get the result; ties between equal hashes keep one span that
covers them all; empty tables give empty or clean results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import row_key, small, table

# Fixed values of the contract.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10

#: Words in a hashed k-gram (fewer in shorter windows).
GRAM = 5
RUNS = "array<struct<length:int,fp:bigint,first:int,last:int>>"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z alone."""
    t = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _grams(hashes: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def _minima(grams: Column, width: int) -> Column:
    """The least hash of every run of width grams: one for each window."""

    def least(i: Column) -> Column:
        found = [F.get(grams, i + j) for j in range(width)]
        return F.least(*found) if width > 1 else found[0]

    return F.transform(F.sequence(F.lit(0), F.size(grams) - width), least)


def _runs(minima: Column) -> Column:
    """(fp, first, last): windows first..last in a row chose the hash fp."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(minima) - 1), lambda j: F.coalesce(F.get(minima, j) != F.get(minima, j - 1), F.lit(True))
    )
    return _let(
        starts,
        lambda s: F.transform(
            s,
            lambda at, i: F.struct(
                F.get(minima, at).alias("fp"),
                at.alias("first"),
                (F.coalesce(F.get(s, i + 1), F.size(minima)) - 1).alias("last"),
            ),
        ),
    )


def fingerprints(words: Column, lengths: Sequence[int]) -> Column:
    """(length, fp, first, last) of the runs of a text, for windows of each of the lengths; the words are hashed once."""

    def of_length(hashes: Column, length: int) -> Column:
        k = min(GRAM, length)
        runs = _let(_grams(hashes, k), lambda g: _let(_minima(g, length - k + 1), _runs))
        named = F.transform(runs, lambda r: F.struct(F.lit(length).alias("length"), r["fp"].alias("fp"), r["first"].alias("first"), r["last"].alias("last")))
        return F.when(F.size(hashes) >= length, named).otherwise(F.array().cast(RUNS))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.flatten(F.array(*[of_length(h, n) for n in lengths])))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, length and window (its words, joined by spaces), distinct."""
    split = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("words"))
    n = F.size("words")
    length = F.least(F.lit(WINDOW), n)
    windows = F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.array_join(F.slice("words", i, length), " "))
    return (
        split.where(n > 0)
        .select("item_id", length.alias("length"), F.explode(windows).alias("window"))
        .distinct()
    )


def find_hits(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, length, start and window of every occurrence of an item's window in a document."""
    distinct = windows.select("length", "window").distinct()
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # ten values at most
    source = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), words_of(F.col(text)).alias("words"))
    if not lengths:
        empty = source.where(F.lit(False))
        return empty.select("doc_id", "key", F.lit(0).alias("length"), F.lit(0).alias("start"), F.lit("").alias("window"))
    # an item's window has one run of its own length; that of a shorter length in it is another window's concern
    own = distinct.select("length", F.explode_outer(fingerprints(F.split("window", " "), lengths)).alias("run"))
    kept = own.where(F.col("run.length") == F.col("length")).select("length", F.col("run.fp").alias("fp")).distinct()
    spans = source.select("doc_id", "key", "words", F.explode_outer(fingerprints(F.col("words"), lengths)).alias("run")).select(
        "doc_id",
        "key",
        F.col("run.length").alias("length"),
        F.col("run.fp").alias("fp"),
        F.col("run.first").alias("first"),
        F.slice("words", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + F.col("run.length")).alias("span"),
    )
    near = spans.join(small(kept), ["length", "fp"])
    each = near.select(
        "doc_id",
        "key",
        "length",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("span") - F.col("length") + 1),
                lambda i: F.struct(
                    (F.col("first") + i - 1).alias("start"), F.array_join(F.slice("span", i, F.col("length")), " ").alias("window")
                ),
            )
        ).alias("w"),
    ).select("doc_id", "key", "length", F.col("w.start").alias("start"), F.col("w.window").alias("window"))
    return each.join(small(distinct), ["length", "window"]).select("doc_id", "key", "length", "start", "window").distinct()


def covered_words(hits: DataFrame) -> DataFrame:
    """doc_id, key and n_hit: the words inside any hit."""
    before = Window.partitionBy("doc_id", "key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    seen = hits.select("doc_id", "key", "start", end.alias("end"), F.coalesce(F.max(end).over(before), F.lit(0)).alias("seen"))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))
    return seen.groupBy("doc_id", "key").agg(F.sum(new).cast("long").alias("n_hit"))


def score_documents(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    windows = table(item_windows(items, item_id, item_text), "item-windows")
    hits = table(find_hits(docs, windows, doc_id, text), "item-hits")
    named = hits.select("doc_id", "key", "length", "window").distinct()
    listed = (
        named.join(small(windows.where(F.col("item_id").isNotNull())), ["length", "window"])
        .select("doc_id", "key", "item_id")
        .distinct()
        .groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )
    summary = covered_words(hits).alias("c").join(
        listed.alias("l"), F.col("c.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("c.key") == F.col("l.key")), "left"
    ).select("c.doc_id", "c.key", "n_hit", "items")
    counts = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    both = counts.alias("d").join(
        summary.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key") == F.col("s.key")), "left"
    )
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        "d.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def filter_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a hit, all their columns unchanged.

    The ids of contaminated rows are broadcast up to a checked number; beyond it both sides are shuffled.
    """
    windows = table(item_windows(items, item_id, item_text), "item-windows")
    hits = table(find_hits(docs, windows, doc_id, text).select("doc_id", "key").distinct(), "item-hits")
    bad = small(hits.select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("_id"), row_key(doc_id, text).alias("_key"))
    return row.join(bad, F.col("_id").eqNullSafe(F.col("_bad_id")) & (F.col("_key") == F.col("_bad_key")), "left_anti").select("row.*")
