"""Substring dedup with difference-cover anchors.

A window is 13 consecutive words.  Positions whose remainder modulo 7 lies in {1, 2, 4} are
anchors: any two positions differ by a shift that brings both onto anchors within seven words,
so two equal windows always share an aligned anchor of seven words.  The work is two rounds.

1. Anchors (three of seven positions) are hashed and meet by hash; those in two or more
   documents go back to their documents.
2. A document extends from these anchors: only windows around one are hashed (96 bits), meet
   by hash, and each goes back to every document but the least with that window.

Texts are dealt out once by document id and that exchange serves all three passes.  Within an
Arrow batch equal hashes are resolved on the spot and only the least document's row travels
under the hash; the rest travel under a spread key.  So a passage that a third of all
documents hold sends one row a batch to its task, not one a document.  Later exact copies of
a text never enter the rounds: all their windows are in the first copy.

Defined cases: a null or empty text has no words; texts of fewer than 13 words lose none; a
null id is neither smaller nor larger than another, so its rows lose nothing, cause no
removal and are never dealt out; equal ids are not smaller, so rows that share one leave each other whole; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import input_partitions, table
from graphloom.llm.wordhash import gram_hashes, hash_words, split_words

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
#: Words of an anchor: shift and anchor together stay within a window.
ANCHOR = WINDOW - PERIOD + 1
#: Bits of an anchor's hash that travel; a chance match only costs a comparison in the second round.
ANCHOR_BITS = 48

#: Kinds of travelling rows: a hash to be compared, or an answer already known.
ASK, TELL = 0, 1
_ROWS = "route long, kind int, low int, doc_id long"


def _anchor_mask(n: int) -> np.ndarray:
    return np.isin(np.arange(n) % PERIOD, COVER)


def _anchors(hashes: np.ndarray) -> np.ndarray:
    grams = gram_hashes(hashes, ANCHOR)
    return grams >> np.uint64(64 - ANCHOR_BITS)


def _windows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window: 64 bits and 32 bits."""
    other = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return gram_hashes(hashes, WINDOW), (gram_hashes(other, WINDOW) >> np.uint64(32)).astype("u4")


def _near(shared: np.ndarray, n: int) -> np.ndarray:
    """Which of n windows hold one of the shared anchor positions: those starting up to six words before it."""
    marks = np.zeros(n + PERIOD + 1, "i4")
    np.add.at(marks, np.maximum(shared - PERIOD + 1, 0), 1)
    np.add.at(marks, np.minimum(shared + 1, n + PERIOD), -1)
    return np.cumsum(marks[:n]) > 0


def _resolve(high: np.ndarray, low: np.ndarray, doc: np.ndarray, tell_first: bool) -> pa.RecordBatch:
    """The rows to send for one batch: per hash one ASK with its least document, and TELLs for what is known here."""
    order = np.lexsort((doc, low, high))
    high, low, doc = high[order], low[order], doc[order]
    start = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])][: len(high)]
    fresh = start | np.r_[True, doc[1:] != doc[:-1]][: len(high)]
    high, low, doc, start = high[fresh], low[fresh], doc[fresh], start[fresh]
    told = ~start
    if tell_first:
        told |= np.r_[~start[1:], False][: len(start)] & start
    def rows(chosen: np.ndarray, kind: int) -> pa.RecordBatch:
        own = np.flatnonzero(chosen)
        own = own[np.argsort(doc[own], kind="stable")]  # a document's rows stand together, so its id compresses away
        columns = (high[own].view("i8"), np.full(len(own), kind, "i4"), low[own].view("i4"), doc[own])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["route", "kind", "low", "doc_id"])

    return pa.concat_batches([rows(start, ASK), rows(told, TELL)])


def _meet(rows: DataFrame, partitions: int, tell_first: bool) -> DataFrame:
    """doc_id and hash of every answer: rows meet by hash, in order, one pass over each partition."""
    spread = F.when(F.col("kind") == ASK, F.xxhash64("route", "low")).otherwise(F.xxhash64("doc_id", "route"))
    dealt = rows.repartition(partitions, spread).sortWithinPartitions("kind", "route", "low", "doc_id")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # hash and least document of the run that may go on
        first_told = False
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, high, low, doc = (batch.column(c).to_numpy() for c in ("kind", "route", "low", "doc_id"))
            told = kind == TELL
            ask = np.flatnonzero(~told)
            extra_doc, extra_hash = [], []
            if len(ask):
                h, w, d = high[ask], low[ask], doc[ask]
                start = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
                at = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
                least = d[at]
                goes_on = last is not None and last[:2] == (h[0], w[0])
                if goes_on:
                    least[at == 0] = last[2]
                later = d > least
                told[ask[later]] = True
                if tell_first:
                    if goes_on and not first_told and later[at == 0].any():
                        extra_doc, extra_hash = [last[2]], [last[0]]
                        first_told = True
                    own = np.flatnonzero(start)
                    shared = np.zeros(len(h), bool)
                    shared[at[later]] = True
                    known = own[shared[own]]
                    if goes_on:
                        known = known[known != 0]
                    told[ask[known]] = True
                end = at[-1]
                same_run = goes_on and end == 0
                first_told = first_told if same_run else bool(tell_first and later[end:].any())
                last = (h[-1], w[-1], least[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[doc[told], np.array(extra_doc, "i8")]), pa.array(np.r_[high[told], np.array(extra_hash, "i8")])], ["doc_id", "hash"]
            )

    return dealt.select("route", "kind", "low", "doc_id").mapInArrow(answer, "doc_id long, hash long")


def _by_document(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("doc_id").agg(F.collect_list("hash").alias(name)).select(F.col("doc_id").alias("_to"), name)


def _send(batches: Iterator[pa.RecordBatch], hashed, tell_first: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        high, low, doc = [np.empty(0, "u8")], [np.empty(0, "u4")], [np.empty(0, "i8")]
        for row in hashed(batch):
            high.append(row[1])
            low.append(row[2])
            doc.append(np.full(len(row[1]), row[0], "i8"))
        yield _resolve(np.concatenate(high), np.concatenate(low), np.concatenate(doc), tell_first)


def _numpy(values, dtype: str) -> np.ndarray:
    return np.empty(0, dtype) if values is None else values.values.to_numpy().view(dtype)


def later_copies(docs: DataFrame, doc_id: str, text: str, partitions: int) -> DataFrame:
    """doc_id and hash of rows whose text also belongs to a smaller id: texts meet by 96 bits of hash as windows do."""
    thin = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("high"), F.hash(text).alias("low")
    )

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, high, low = (batch.column(c).to_numpy() for c in ("doc_id", "high", "low"))
            yield _resolve(high.view("u8"), low.view("u4"), doc, False)

    return _meet(thin.mapInArrow(texts, _ROWS), partitions, False)


def dedup_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row of docs."""
    parts = input_partitions(docs)
    nameless = docs.where(F.col(doc_id).isNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.where(F.col(doc_id).isNotNull())
    copies = table(_by_document(later_copies(docs, doc_id, text, parts), "copy_of"), "substring-copies")
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartition(parts, "doc_id")
    texts = dealt.join(copies.hint("shuffle_hash"), F.col("doc_id") == F.col("_to"), "left").select(
        "doc_id", "text", F.coalesce(F.array_contains("copy_of", F.xxhash64("text")), F.lit(False)).alias("is_copy")
    )

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(batch: pa.RecordBatch):
            for d, t, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "is_copy")), strict=True):
                if d is not None and not copy:
                    found = _anchors(hash_words(split_words(t)))
                    found = np.unique(found[_anchor_mask(len(found))])
                    yield d, found, np.zeros(len(found), "u4")

        return _send(batches, hashed, True)

    shared = _meet(texts.mapInArrow(anchors, _ROWS), parts, True)
    # a left join: an inner one would ask the scan for non-null ids, and the texts would be dealt out a second time
    extended = texts.join(_by_document(shared, "shared").hint("shuffle_hash"), F.col("doc_id") == F.col("_to"), "left").select("doc_id", "text", "shared")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(batch: pa.RecordBatch):
            for i in np.flatnonzero(batch.column("shared").is_valid().to_numpy(zero_copy_only=False)).tolist():
                d = batch.column("doc_id")[i].as_py()
                words = hash_words(split_words(batch.column("text")[i].as_py()))
                high, low = _windows(words)
                if not len(high):
                    continue
                found = _anchors(words)
                at = np.flatnonzero(_anchor_mask(len(found)) & np.isin(found, _numpy(batch.column("shared")[i], "u8")))
                near = _near(at, len(high))
                if near.any():
                    yield d, high[near], low[near]

        return _send(batches, hashed, False)

    repeated = _meet(extended.mapInArrow(windows, _ROWS), parts, False)
    answered = texts.join(_by_document(repeated, "repeated").hint("shuffle_hash"), F.col("doc_id") == F.col("_to"), "left").select(
        "doc_id", "text", "is_copy", "repeated"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            answers = batch.column("repeated")
            for i, (t, copy) in enumerate(zip(batch.column("text").to_pylist(), batch.column("is_copy").to_pylist(), strict=True)):
                words = split_words(t)
                gone = np.zeros(len(words), bool)
                known = answers[i] if answers[i].is_valid else None
                if copy and len(words) >= WINDOW:
                    gone[:] = True
                elif known is not None and len(words) >= WINDOW:
                    starts = np.flatnonzero(np.isin(gram_hashes(hash_words(words), WINDOW), _numpy(known, "u8")))
                    for k in range(WINDOW):
                        gone[starts + k] = True
                n.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, "int64"), pa.array(removed, "int64"), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    nothing = [F.lit(False).alias("is_copy"), F.lit(None).cast("array<long>").alias("repeated")]
    shape = "doc_id long, n_words long, n_removed long, kept string"
    return answered.mapInArrow(cut, shape).unionByName(nameless.select("doc_id", "text", *nothing).mapInArrow(cut, shape))
