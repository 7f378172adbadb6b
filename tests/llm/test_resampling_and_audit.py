"""Brute-force versions of suffix dedup, importance resampling and the filter audit."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import filter_audit, importance, mixing, suffix_dedup
from graphloom.llm.queries import QUERIES

from .helpers import bench_words, documents, odd_documents, sentence, words

LABELS = "doc_id long, quality int, toxic int"


# ---- suffix dedup


def windows(text):
    b = (text or "").encode()
    return b, [b[i : i + 400] for i in range(len(b) - 399)]


def without_repeats(texts):
    """(bytes, removed, spans, kept) of each text, comparing all windows."""
    seen = Counter(w for t in texts for w in windows(t)[1])
    out = []
    for t in texts:
        b, ws = windows(t)
        gone = np.zeros(len(b) + 1, bool)
        for i, w in enumerate(ws):
            if seen[w] > 1:
                gone[i : i + 400] = True
        kept = bytes(x for x, g in zip(b, gone.tolist()) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), kept))
    return out


def byte_texts(seed):
    r = random.Random(seed)

    def junk(n, letters="abcdefghij klmnopé"):
        return "".join(r.choices(letters, k=n))

    passages = [junk(n) for n in (380, 399, 400, 401, 450, 700, 1500)]
    texts = [junk(r.randint(0, 900)) + r.choice(passages) + junk(r.randint(0, 60)) for _ in range(60)]
    texts += [junk(300) + p + junk(200) + p for p in passages]  # twice in one text
    texts += ["ab" * 600, "x" * 2000, "x" * 399, "line of text here\n" * 80, junk(40, "ab") * 40]
    texts += [texts[0]] * 3 + [texts[1][:-5] + "other"] + ["", None, "short", junk(5000, "ab")]
    return texts


def test_suffix_dedup_equals_brute_force(spark):
    rows = [(i if i % 9 else None, t, "en", "s", 1) for i, t in enumerate(byte_texts(1))] + odd_documents()
    out = suffix_dedup.dedup_documents(documents(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2], r[3], bytes(r[4])) for r in out.collect())
    expected = without_repeats([r[1] for r in rows])
    assert got == sorted(((r[0] is None, r[0] or 0), *e) for r, e in zip(rows, expected, strict=True))
    assert suffix_dedup.dedup_documents(documents(spark, [])).count() == 0


def test_suffix_dedup_spreads_heavy_hashes(spark, monkeypatch):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(byte_texts(2))]
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", 1000)
    out = suffix_dedup.dedup_documents(documents(spark, rows).repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out) == [
        (r[0], *e) for r, e in zip(rows, without_repeats([r[1] for r in rows]), strict=True)
    ]


@pytest.mark.parametrize("seed", range(12))
def test_corpus_order_finds_all_repeats(seed):
    r = random.Random(seed)
    pieces = [bytes(r.choices(b"ab" if seed % 2 else b"abcdefgh ij", k=r.randint(1, 900))) for _ in range(5)]
    mixed = [b"".join(r.choices(pieces, k=r.randint(1, 4)))[r.choice((0, 0, 17)) :] for _ in range(12)]  # some begin in the middle, some with a trigger
    texts = list(dict.fromkeys([t.encode() for t in byte_texts(seed) if t] + mixed))
    texts = [t for t in texts if len(t) >= 400]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for t, hit in zip(texts, suffix_dedup.repeated(texts), strict=True):
        assert hit.tolist() == [seen[t[i : i + 400]] > 1 for i in range(len(t) - 399)]


# ---- importance resampling


def features(text):
    w = bench_words(text)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def resampled(rows, items):
    """(doc_id, n_features, weight, score) of each row, and the drawn ones' (score, doc_id) in order."""
    own, target = Counter(), Counter()
    for _, t in rows:
        own.update(zlib.crc32(f.encode()) % 10000 for f in features(t)[1])
    for t in items:
        target.update(zlib.crc32(f.encode()) % 10000 for f in features(t)[1])
    all_own, all_target = sum(own.values()), sum(target.values())
    out, long_enough = [], []
    for d, t in rows:
        w, fs = features(t)
        gains = [
            math.floor(1000 * math.log((target[b] + 1) * (all_own + 10000) / ((own[b] + 1) * (all_target + 10000))))
            for b in (zlib.crc32(f.encode()) % 10000 for f in fs)
        ]
        weight = sum(gains) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, len(fs), weight, score))
        if len(w) >= 20:
            long_enough.append((-score, d is not None, d or 0))
    return out, sorted(long_enough)[: 25 * len(long_enough) // 100]


def test_importance_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"Word{i}" for i in range(400)] + ["été", "x-y", "don't"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 120))), "en", "s", 1) for i in range(150)] + odd_documents()
    items = [(1, " ".join(vocabulary[:80])), (2, None), (3, sentence(0, 60, "base"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = importance.resample(documents(spark, rows).repartition(5), bench).collect()
    expected, drawn = resampled([(x[0], x[1]) for x in rows], [t for _, t in items])
    none_first = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((x["doc_id"], x["n_features"], x["weight"], x["score"]) for x in out), key=none_first) == sorted(expected, key=none_first)
    got = sorted((x["rank"], -x["score"], x["doc_id"] is not None, x["doc_id"] or 0) for x in out if x["rank"] is not None)
    assert got == [(i, *x) for i, x in enumerate(drawn, 1)]


def test_importance_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(documents(spark, []), bench).count() == 0
    out = importance.resample(documents(spark), bench).collect()
    assert len(out) == len(odd_documents()) and {x["n_features"] for x in out if x["doc_id"] in (5, 6)} == {0}


def test_pairs_go_on_from_the_first_word():
    found = importance.feature_buckets([b"a", b"bc", b"def"], 10_000).tolist()
    assert found == [zlib.crc32(x) % 10_000 for x in (b"a", b"bc", b"def", b"a bc", b"bc def")]


# ---- filter audit


def masks(rows):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, p in rows:
        t = t or ""
        w = words(t)
        copy = d is not None and least[t] < d
        upper = sum("A" <= c <= "Z" for c in t)
        yield d, p or "", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * upper > 5 * len(t), any(c in "#$%&*|" for c in t), copy)


def audited(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    marked = list(masks(rows))
    out, totals = [], defaultdict(int)
    for part in {p for _, p, _ in marked}:
        own = [(d, m) for d, p, m in marked if p == part]
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fails = [x for x in own if x[1][f]]
                unique = [x for x in fails if sum(x[1]) == 1]
                totals[part, f] += len(gone)
                lost = [sum(d in s for d, _ in gone if d is not None) for s in (good, toxic)]
                out.append(((part, f), (part, "".join("ABCDE"[i] for i in order), step, len(left), len(gone), len(fails) - len(gone), len(unique), *lost)))
    return sorted((*row, totals[key]) for key, row in out)


def audit_rows():
    r = random.Random(5)
    texts = [" ".join(r.choices([f"w{i}" for i in range(r.choice((20, 400)))] + ["LOUD", "a#b"][: r.randint(0, 2)], k=r.randint(5, 90))) for _ in range(60)]
    rows = [(r.randint(0, 99) if r.random() < 0.9 else None, r.choice(texts), "en", r.choice(["a", "b", None, ""]), 1) for _ in range(300)]
    return rows + odd_documents()


@pytest.mark.parametrize("remembered", [64 << 20, 2000])
def test_audit_equals_brute_force(spark, monkeypatch, remembered):
    monkeypatch.setattr(filter_audit, "REMEMBERED", remembered)
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None)]
    out = filter_audit.audit(documents(spark, rows).repartition(4), spark.createDataFrame(labels, LABELS))
    got = sorted(tuple(x) for x in out.collect())
    assert got == audited([(x[0], x[1], x[3]) for x in rows], labels)


def test_later_copies(spark):
    rows = audit_rows()
    expected = sorted(d for d, _, m in masks([(x[0], x[1], x[3]) for x in rows]) if m[4])
    assert sorted(x["doc_id"] for x in filter_audit.later_copies(documents(spark, rows)).collect()) == expected


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(documents(spark, []), labels).count() == 0
    assert filter_audit.audit(documents(spark), labels).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("name", ["op11_suffix_dedup", "op12_importance", "op13_filter_audit"])
def test_queries_run_on_the_tables(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.count() == (docs.select("source").distinct().count() * 600 if name.startswith("op13") else docs.count())


# ---- mixing


@pytest.mark.parametrize("columns", [["row.uid", "nth", "copy"], ["nth"], ["row", "rate", "nth", "part", "copy", "order_key"]])
def test_mixing_keeps_equal_rows_of_a_shuffled_input(spark, columns):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"), F.col("id").alias("uid"), (F.col("id") % 7).alias("k"))
    docs = docs.repartition("k")
    numbered = mixing._numbered(docs.select(F.struct("*").alias("row"), F.lit("1").alias("_id"), F.lit("t").alias("_text"), F.lit("s").alias("_own")))
    assert sorted(x["_nth"] for x in numbered.select("_nth").collect()) == list(range(4000))
    n = mixing.replicate(docs).select(*columns).count()
    assert abs(n - 4000) < 4 * math.sqrt(4000)
