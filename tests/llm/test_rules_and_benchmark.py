from __future__ import annotations

import hashlib

from graphloom.llm import decontaminate, quality_rules

from .helpers import contamination, documents, odd_documents, rule_counts, sentence


def test_counts_match_brute_force(spark):
    rows = odd_documents()
    got = quality_rules.measure(documents(spark)).collect()
    expected = sorted((repr(d), *rule_counts(t).values()) for d, t, *_ in rows)
    names = list(rule_counts("x"))
    assert sorted((repr(r["doc_id"]), *(r[n] for n in names)) for r in got) == expected


def test_base_failures_and_hosts(spark):
    out = {(r["doc_id"], r["n_words"]): r for r in quality_rules.score_documents(documents(spark)).collect()}
    assert out[1, 100]["kept"] and not out[1, 100]["base_failed"]
    assert out[12, 60]["base_failed"] and not out[12, 60]["kept"]
    assert out[5, 0]["base_failed"] and out[6, 0]["base_failed"] and out[10, 3]["base_failed"]


def test_bad_host_takes_its_documents(spark):
    good = [(i, sentence(i * 100, 40), "en", f"h{i % 20}", 1) for i in range(400)]
    bad = [(1000 + i, "too short", "en", "bad", 1) for i in range(95)] + [(2000 + i, sentence(i * 50, 40, "b"), "en", "bad", 1) for i in range(5)]
    out = quality_rules.score_documents(documents(spark, good + bad)).collect()
    assert all(r["kept"] for r in out if r["doc_id"] < 1000)
    assert not any(r["kept"] for r in out if r["doc_id"] >= 1000)
    kept = quality_rules.filter_documents(documents(spark, good + bad))
    assert kept.columns == documents(spark, good).columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in good}


def test_prior_shrinks_small_hosts(spark):
    rows = [(i, sentence(i * 100, 40), "en", f"h{i % 10}", 1) for i in range(500)] + [(900, "short", "en", "tiny", 1)]
    out = {r["host"]: r for r in quality_rules.host_verdicts(quality_rules.measure(documents(spark, rows))).collect()}
    assert out["tiny"]["n_failed"] == 1 and 0 < out["tiny"]["shrunk_rate"] < 1


def test_equal_hosts_are_shrunk_to_the_mean(spark):
    """Rates that differ by chance alone say nothing of a host."""
    rows = [(h * 100 + i, "short" if i % 10 == 0 else sentence(i * 50, 40, f"h{h}x"), "en", f"h{h}", 1) for h in range(20) for i in range(30)]
    for r in quality_rules.host_verdicts(quality_rules.measure(documents(spark, rows))).collect():
        assert r["host_ok"] and abs(r["shrunk_rate"] - 0.1) < 0.01


def _planted(n_good=20, n_bad=2):
    """Hosts with one failure in ten, and bad ones whose documents mostly fail; small hosts with a failure are let off."""
    rows = []
    for h in range(n_good):
        rows += [(h * 1000 + i, "short" if i % 10 == 0 else sentence(i * 50, 40, f"h{h}x"), "en", f"h{h}", 1) for i in range(50)]
    for h in range(n_bad):
        rows += [(90_000 + h * 1000 + i, "short" if i % 3 else sentence(i * 50, 40, f"b{h}x"), "en", f"bad{h}", 1) for i in range(60)]
    return [*rows, (99_000, "short", "en", "tiny", 1), (99_001, sentence(0, 40, "t"), "en", "tiny", 1), (99_002, None, None, None, None)]


def test_planted_hosts_match_sql(spark, tmp_path):
    """On planted hosts the verdict is more than the base rules, and SQL gives the same rows."""
    import duckdb

    from graphloom.llm import queries

    path = f"file://{tmp_path}/sf"
    documents(spark, _planted()).select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{path}/documents.parquet")
    got = queries.QUERIES["op2_quality_rules"](spark, path)
    columns = sorted(got.columns)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/sf/documents.parquet/*.parquet'")
    expected = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op2_quality_rules']})").fetchall()
    rows = got.select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, expected))
    gone = {r["doc_id"] for r in rows if not r["base_failed"] and not r["kept"]}
    assert gone == {d for d, t, _, s, _ in _planted() if s and s.startswith("bad") and t != "short"}


def test_rules_on_nothing(spark):
    assert quality_rules.score_documents(documents(spark, [])).count() == 0
    assert quality_rules.filter_documents(documents(spark, [])).count() == 0


ITEMS = [
    (1, "Shared5 shared6, SHARED7 shared8 shared9 shared10 shared11 shared12 shared13 shared14 shared15 shared16"),
    (2, "two three"),
    (3, sentence(20, 10, "base")),
    (3, sentence(20, 10, "base")),
    (4, None),
    (5, "... ---"),
    (None, sentence(50, 12, "long")),
    (6, sentence(0, 9, "p")),
    (7, "Der der der der der der der der der der der der"),
    (8, "été"),
]


def _items(spark, items=None):
    return spark.createDataFrame(ITEMS if items is None else items, "item_id long, text string").selectExpr("*", "'x' as key", "1 as length")


def test_contamination_matches_brute_force(spark):
    rows = [(d, t) for d, t, *_ in odd_documents()]
    out = decontaminate.score_documents(documents(spark), _items(spark)).collect()
    expected = sorted(
        (repr(d), n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for (d, _), (n, h, i) in zip(rows, contamination(rows, ITEMS), strict=True)
    )
    assert sorted((repr(r["doc_id"]), *r[1:]) for r in out) == expected


def test_every_window_is_found_at_every_offset(spark):
    docs = [(i, sentence(i * 1000, i) + " " + sentence(0, 10, "hit") + " " + sentence(i * 1000 + 500, 7), "en", "a", 1) for i in range(25)]
    out = decontaminate.score_documents(documents(spark, docs), _items(spark, [(1, sentence(0, 10, "hit"))]))
    assert {r["n_hit"] for r in out.collect()} == {10}


def test_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    expected = sorted(map(repr, decontaminate.score_documents(documents(spark), _items(spark)).collect()))
    monkeypatch.setattr(decontaminate, "small", lambda df, rows=0: df)
    assert sorted(map(repr, decontaminate.score_documents(documents(spark), _items(spark)).collect())) == expected


def test_contaminated_rows_go(spark):
    kept = decontaminate.filter_documents(documents(spark), _items(spark))
    rows = [(d, t) for d, t, *_ in odd_documents()]
    clean = sorted(repr(d) for (d, _), (_, h, _) in zip(rows, contamination(rows, ITEMS), strict=True) if not h)
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == clean
    assert kept.columns == documents(spark).columns


def test_contamination_of_nothing(spark):
    assert decontaminate.score_documents(documents(spark, []), _items(spark)).count() == 0
    out = decontaminate.score_documents(documents(spark), _items(spark, [])).collect()
    assert len(out) == len(odd_documents()) and not any(r["contaminated"] for r in out)
