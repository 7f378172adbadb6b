from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import mixing
from graphloom.llm import queries as llm_queries
from graphloom.llm.queries import tokenizer_file
from graphloom.llm.shared import table

from .helpers import contamination, documents, jaccard_classes, odd_documents, rule_counts, sentence


def uniform(*parts):
    """The number in [0, 1) of a row: id, text, number among equal rows, part (and "order" before, copy after)."""
    return int(hashlib.md5(":".join(["42", *("-" if p is None else str(p) for p in parts)]).encode()).hexdigest()[:13], 16) / 16**13


def named(doc_id, text):
    return doc_id, None if text is None else hashlib.md5(text.encode()).hexdigest()


def copies(doc_id, text, rate, nth=0, part=0):
    u, k, cumulative = uniform(*named(doc_id, text), nth, part), 0, math.exp(-rate)
    term = cumulative
    while cumulative <= u:
        k += 1
        term *= rate / k
        cumulative += term
    return k


def test_copies_follow_the_poisson_distribution(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 4 else "small", 1) for i in range(8000)]
    out = mixing.replicate(documents(spark, rows)).select("row.doc_id", "row.source", "rate", "copy").collect()
    by_source = {s: [r for r in out if r["source"] == s] for s in ("big", "small")}
    assert by_source["big"][0]["rate"] == pytest.approx(2 / 3) and by_source["small"][0]["rate"] == pytest.approx(2.0)
    assert len(by_source["big"]) == pytest.approx(4000, rel=0.05) and len(by_source["small"]) == pytest.approx(4000, rel=0.05)
    counts = {r["doc_id"]: 0 for r in out}
    for r in out:
        counts[r["doc_id"]] += 1
    assert all(counts.get(i, 0) == copies(i, f"t{i}", 2 / 3 if i % 4 else 2.0) for i in range(8000))


def test_weights(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", 1) for i in range(3000)]
    out = mixing.mix(documents(spark, rows), weights={"s0": 3.0, "s1": 1.0, "missing": 5.0})
    n = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert "s2" not in n and n["s0"] / n["s1"] == pytest.approx(3.0, rel=0.15)


def test_steps_of_the_largest_part(spark):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(mixing.PART)).alias("s")).first()["s"]
    assert steps[-1] == pytest.approx(1.0, abs=1e-9) and all(a <= b for a, b in zip(steps, steps[1:], strict=False))


def test_rates_far_above_a_part(spark):
    """A single document of a source with a rate near 10^6: its copies are made by parts, in all tasks."""
    rows = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 1, "rare").otherwise("big").alias("source"))
    out = mixing.replicate(rows)
    seen = out.select("row.source", "part", F.spark_partition_id().alias("task")).groupBy("source")
    n = {r["source"]: (r["n"], r["parts"], r["tasks"]) for r in seen.agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"), F.countDistinct("task").alias("tasks")).collect()}
    assert abs(n["rare"][0] - 200_000) < 4 * math.sqrt(200_000) and n["rare"][1] == math.ceil(200_000 / mixing.PART)
    assert n["rare"][2] == 4


def test_rows_that_share_an_id_keep_the_mean(spark):
    rows = [(None, "x", "en", "a", 1)] * 200 + [(None, "x", "en", "b", 1)] * 200 + [(7, f"t{i}", "en", "c", 1) for i in range(1600)]
    out = mixing.replicate(documents(spark, rows), weights={"a": 1.0, "b": 3.0, "c": 4.0}).cache()
    n = {r["source"]: r["count"] for r in out.groupBy("row.source").count().collect()}
    for source, mean in (("a", 250), ("b", 750), ("c", 1000)):
        assert abs(n[source] - mean) < 4 * math.sqrt(mean)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 4
    drawn = {(r["nth"], r["copy"]) for r in out.where("row.source = 'a'").select("nth", "copy").collect()}
    assert drawn == {(i, c) for i in range(200) for c in range(copies(None, "x", 1.25, i))}


def test_odd_weights(spark):
    assert mixing.mix(documents(spark), weights={}).count() == 0
    assert mixing.mix(documents(spark), weights={"a": 0.0}).count() == 0
    for bad in (-1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            mixing.mix(documents(spark), weights={"a": bad})


def test_mix_odd_documents(spark):
    out = mixing.mix(documents(spark))
    assert out.columns == documents(spark).columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, mixing.mix(documents(spark)).collect()))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_order_is_global(spark):
    rows = [(i, f"t{i}", "en", "a", 1) for i in range(500)]
    keys = [r["order_key"] for r in mixing.replicate(documents(spark, rows)).collect()]
    assert keys == sorted(keys)


def good_hosts(hosts):
    """Whether each host (its documents' failures) passes, by sums over hosts and documents one by one."""
    failed = [f for h in hosts.values() for f in h]
    mean = sum(failed) / len(failed)
    by_chance = mean * (1 - mean)
    between = sum(len(h) * (sum(h) / len(h) - mean) ** 2 for h in hosts.values()) - (len(hosts) - 1) * by_chance
    room = len(failed) - sum(len(h) ** 2 for h in hosts.values()) / len(failed)
    strength = min(10000.0, max(2.0, by_chance * room / between - 1 if between > 0 and room > 0 else 10000.0))
    limit = 3 * mean / (1 + 2 * mean)
    out = {}
    for name, h in hosts.items():
        rate = (sum(h) + mean * strength) / (len(h) + strength)
        out[name] = rate - 2 * math.sqrt(rate * (1 - rate) / (len(h) + strength + 1)) <= limit
    return out


def brute_pipeline(docs, items, tokenizer):
    """(doc_id, n_tokens, crc) of every copy, in the order of the files."""
    hosts = {}
    measured = []
    for d, t, _, s, _ in docs:
        m = rule_counts(t)
        bad = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        soft = bad or 100 * m["n_symbols"] > 10 * m["word_chars"] or 100 * m["n_dup_lines"] > 30 * m["n_lines"]
        measured.append((bad, soft))
        hosts.setdefault(s, []).append(soft)
    ok = good_hosts(hosts)
    docs = [r for r, (bad, _) in zip(docs, measured, strict=True) if not bad and ok[r[3]]]
    _, members = jaccard_classes([(r[0], r[1]) for r in docs])
    first = {min(m, key=lambda i: docs[i][0]) for m in members}
    docs = [r for i, r in enumerate(docs) if i in first]
    dirty = [h > 0 for _, h, _ in contamination([(r[0], r[1]) for r in docs], items)]
    docs = [r for r, d in zip(docs, dirty, strict=True) if not d]
    n = {}
    for r in docs:
        n[r[3]] = n.get(r[3], 0) + 1
    out = []
    for r in docs:
        k = copies(r[0], r[1], len(docs) / len(n) / n[r[3]])
        out += [(uniform("order", *named(r[0], r[1]), 0, 0, c), r) for c in range(k)]
    start, rows = 0, []
    for _, r in sorted(out, key=lambda x: x[0]):
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids + [1]
        rows.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_pipeline_matches_brute_force(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute_pipeline(docs, items, tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")))
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out) == sorted(expected)


def test_stages_take_odd_documents(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([(1, sentence(0, 12, "p"))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for rows in (odd_documents(), []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns, name
            docs = table(out, "stage")
        assert set(corpus_pipeline.STAGES[-1][1](spark, docs, path).columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_registry():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm_queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(llm_queries.ORACLES) <= set(llm_queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token-ID output"]


def test_queries_match_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in llm_queries.ORACLES.items():
        got = llm_queries.QUERIES[name](spark, sf_dir)
        columns = sorted(got.columns)
        expected = c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, expected)), name
