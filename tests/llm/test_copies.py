from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join, substring_dedup
from graphloom.llm.components import connected_components

from .helpers import dedup_substrings, documents, jaccard_classes, odd_documents, sentence


def _random_documents(n=60, seed=3):
    """Documents cut from common passages at random places, with copies and repeats."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(40)] for k in range(6)]
    rows = []
    for d in range(n):
        out = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            out += p[a : a + rng.randint(5, 40)] + [f"d{d}x{rng.randint(0, 9)}"] * rng.randint(0, 2)
        rows.append((rng.randint(0, 45), " ".join(out), "en", "a", 1))
    return rows


def _check_dedup(spark, rows):
    out = substring_dedup.dedup_documents(documents(spark, rows)).collect()
    expected = sorted((repr(d), n, n - len(k), " ".join(k)) for d, n, k in dedup_substrings([(r[0], r[1]) for r in rows]))
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in out) == expected


def test_dedup_matches_brute_force(spark):
    _check_dedup(spark, odd_documents())
    _check_dedup(spark, _random_documents())


def test_dedup_across_batches(spark):
    """Runs of equal hashes that go on over Arrow batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        _check_dedup(spark, _random_documents(80, 5))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_dedup_of_nothing(spark):
    assert substring_dedup.dedup_documents(documents(spark, [])).count() == 0


def test_cover_aligns_any_two_windows():
    cover = set(substring_dedup.COVER)
    for i in range(substring_dedup.PERIOD):
        for j in range(substring_dedup.PERIOD):
            assert any((i + s) % 7 in cover and (j + s) % 7 in cover for s in range(substring_dedup.PERIOD))
    assert substring_dedup.ANCHOR + substring_dedup.PERIOD - 1 == substring_dedup.WINDOW


def _check_join(spark, rows):
    pairs = [(r[0], r[1]) for r in rows]
    links, members = jaccard_classes(pairs)
    out = jaccard_join.join_documents(documents(spark, rows)).collect()
    ids = [d for d, _ in pairs]
    expected = sorted(
        (repr(d), links[i], repr(min((ids[m] for m in members[i] if ids[m] is not None), default=None)), len(members[i])) for i, d in enumerate(ids)
    )
    assert sorted((repr(r["doc_id"]), r["n_links"], repr(r["class_id"]), r["class_size"]) for r in out) == expected


def test_join_matches_brute_force(spark):
    _check_join(spark, odd_documents())


def _near_copies(n=40, seed=1):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 99)}"
        rows.append((d, " ".join(w), "en", "a", 1))
    return rows


def test_join_counts_all_links_of_a_group(spark):
    _check_join(spark, _near_copies())


def test_join_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 7)
    _check_join(spark, _near_copies(seed=2))


def _loosely_alike(n=60, seed=4):
    """Documents that share a frame of a third of their n-grams, some with a close copy, so that buckets hold strangers."""
    rng = random.Random(seed)
    frame = [f"frame{i}" for i in range(40)]
    rows = []
    for d in range(n):
        own = [f"d{d % 40}w{i}" for i in range(40)]
        if d >= 40:
            own[rng.randrange(40)] = f"edit{d}"
        rows.append((d, " ".join(frame + own), "en", "a", 1))
    return rows


def test_strangers_in_a_bucket_chain_nothing(spark, monkeypatch):
    """With bands of one row, documents of similarity 1/3 share buckets all over; no tie between them outlives verification."""
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 9)
    rows = _loosely_alike()
    joined = jaccard_join.join_documents(documents(spark, rows), bands=40, rows=1)
    links, members = jaccard_classes([(r[0], r[1]) for r in rows])
    assert {r["doc_id"]: (r["n_links"], r["class_id"], r["class_size"]) for r in joined.collect()} == {
        i: (links[i], min(m), len(m)) for i, m in enumerate(members)
    }
    assert max(len(m) for m in members) <= 2 and sum(links) == 40


def test_links_between_strangers_of_a_head(spark):
    """Two members are alike, but neither is like the head of the bucket they share."""
    frame = [f"frame{i}" for i in range(40)]
    pair = frame + [f"pair{i}" for i in range(40)]
    rows = [(0, " ".join(frame + [f"x{i}" for i in range(40)]), "en", "a", 1), (1, " ".join(pair), "en", "a", 1), (2, " ".join(pair[:-1] + ["end"]), "en", "a", 1)]
    joined = jaccard_join.join_documents(documents(spark, rows), bands=20, rows=1)
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in joined.collect()} == {0: (0, 0), 1: (1, 1), 2: (1, 1)}


def test_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "small", lambda df, rows=0: df)
    _check_join(spark, odd_documents())


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)]
    got = jaccard_join.intersections(np.concatenate(sets).astype("u8"), np.repeat(np.arange(40), [len(s) for s in sets]), 40)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_one_row_of_each_class_stays(spark):
    rows = odd_documents()
    kept = jaccard_join.filter_documents(documents(spark, rows))
    _, members = jaccard_classes([(r[0], r[1]) for r in rows])
    assert kept.count() == len({tuple(m) for m in members})
    assert kept.columns == documents(spark, rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(15) == 2 and 1 in ids and 2 not in ids and 4 not in ids


def test_join_of_nothing(spark):
    assert jaccard_join.join_documents(documents(spark, [])).count() == 0
    assert jaccard_join.filter_documents(documents(spark, [])).count() == 0


def test_recall_at_the_threshold():
    """Pairs of similarity 0.8 share a band as often as the formula says."""
    rng = np.random.default_rng(5)
    hits = 0
    for _ in range(150):
        common, a, b = rng.integers(0, 2**63, 160, dtype="u8"), rng.integers(0, 2**63, 20, dtype="u8"), rng.integers(0, 2**63, 20, dtype="u8")
        s = [jaccard_join.signature(np.r_[common, x], jaccard_join.BANDS * jaccard_join.ROWS) for x in (a, b)]
        bands = [jaccard_join.band_hashes(x, jaccard_join.BANDS, jaccard_join.ROWS) for x in s]
        hits += bool((bands[0] == bands[1]).any())
    assert hits >= 147


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40) if i % 10] + [(100, 3), (50, 50)]
    out = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    got = {r["node"]: r["root"] for r in out.collect()}
    assert got == {**{i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)}, 100: 1}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_long_texts_are_whole(spark):
    text = sentence(0, 20_000)
    rows = [(1, text, "en", "a", 1), (2, text + " end", "en", "a", 1)]
    out = {r["doc_id"]: r for r in jaccard_join.join_documents(documents(spark, rows)).collect()}
    assert out[2]["class_id"] == 1 and out[2]["n_links"] == 1
    cut = {r["doc_id"]: r for r in substring_dedup.dedup_documents(documents(spark, rows)).select("doc_id", "n_removed", F.length("kept").alias("n")).collect()}
    assert cut[2]["n_removed"] == 20_000


def test_rows_without_an_id_are_not_dealt_out(spark):
    """They stay in their partitions, whatever their number, and lose nothing."""
    rows = [(None if i % 3 else i, sentence(i % 5, 40), "en", "a", 1) for i in range(300)]
    out = substring_dedup.dedup_documents(documents(spark, rows).repartition(6))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["kept"].split(" ") if r["kept"] else []) for r in out.collect())
    assert got == sorted((d is None, d or 0, n, kept) for d, n, kept in dedup_substrings([(x[0], x[1]) for x in rows]))
