from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.errors import Conflict, DecodeError, MissingContext, NameError_, NotFound, QueryError
from graphloom.functions.terms import Name, PrefixMap, compact_space, file_stem, format_name, fragment, parse_name
from graphloom.operators import infer, joins, update
from graphloom.operators.closure import path_closure
from graphloom.operators.records import Field, RecordSpec, decode, decode_all, decode_containers, decode_lists, encode, first_record, lookup, subject_hash
from graphloom.plans.pattern import MappedGraph, Pattern, Solutions, TripleGraph, bgp, path, values
from graphloom.plans.storage import new_path
from graphloom.sources.mapping import mapped_graph
from graphloom.sources.turtle import format_triples, read_turtle, scan_text, write_turtle

PREFIXES = PrefixMap({"ex": "urn:ctx:", "deep": "urn:ctx:deep/", "": "http://example.org/"})


def triples(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


# ---- names


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("rdf:label", Name("rdf", "label")),
        (":", Name("", "")),
        (":Ação", Name("", "Ação")),
        ("ex:", Name("ex", "")),
        (r"task:1f\-2b\-3c", Name("task", "1f-2b-3c")),
        ("<http://example.org/model#Ação>", Name(None, "http://example.org/model#Ação")),
        ("ex:a%20b", Name("ex", "a%20b")),
    ],
)
def test_parse_name(text, name):
    assert parse_name(text) == name


@pytest.mark.parametrize("text", ["ex:a.", "noColon", "<open", "<a b>", "ex:a b", "1x:a"])
def test_bad_names(text):
    with pytest.raises(NameError_):
        parse_name(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcé019_-.~!&()*+,;=/", max_size=12))
def test_names_round_trip(local):
    assert parse_name(format_name(Name("ex", local))) == Name("ex", local)


def test_resolve_and_compact(spark):
    assert PREFIXES.resolve("ex:a") == "urn:ctx:a"
    assert PREFIXES.resolve("no:a") is None
    assert PREFIXES.shorten("urn:ctx:deep/x") == "deep:x"
    assert PREFIXES.shorten("urn:other") == "<urn:other>"
    assert PrefixMap({}, "http://e.org/a/b").resolve_iri("../c") == "http://e.org/c"
    assert PrefixMap({}, "http://e.org/m#").resolve_iri("c") == "http://e.org/m#c"
    df = spark.createDataFrame([("urn:ctx:deep/x",), ("urn:ctx:y",), ("other",), (None,)], "i string")
    got = [tuple(r) for r in df.select(PREFIXES.compact_column(F.col("i")), PREFIXES.shorten_column(F.col("i"))).collect()]
    assert got == [("deep:x", "deep:x"), ("ex:y", "ex:y"), (None, "<other>"), (None, None)]
    back = df.select(PREFIXES.resolve_column(PREFIXES.shorten_column(F.col("i"))).alias("r")).collect()
    assert [r[0] for r in back] == ["urn:ctx:deep/x", "urn:ctx:y", "other", None]


def test_text_functions(spark):
    df = spark.createDataFrame([("http://a/b#c", "/x/y.tar.gz", "  a \n b ")], "i string, f string, t string")
    assert tuple(df.select(fragment(F.col("i")), file_stem(F.col("f")), compact_space(F.col("t"))).first()) == ("c", "y.tar", "a b")


# ---- patterns


def test_triple_patterns(spark):
    g = TripleGraph(triples(spark, [("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "c"), ("a", "name", "A"), ("b", "name", "B")]))
    assert {tuple(r) for r in bgp(g, ("?x", "knows", "?y"), ("?y", "name", "?n")).project("x", "n").df.collect()} == {("a", "B")}
    assert [r["x"] for r in bgp(g, ("?x", "knows", "?x")).df.collect()] == ["c"]
    assert g.scan(Pattern("?s", "?p", "B")).df.first().asDict() == {"s": "b", "p": "name"}
    with pytest.raises(QueryError):
        bgp(g, ("?x", "knows", "?y"), ("?u", "name", "?v"))


def test_optional_union_minus(spark):
    g = TripleGraph(triples(spark, [("a", "t", "1"), ("b", "t", "1"), ("a", "u", "x"), ("a", "v", "y")]))
    base = bgp(g, ("?s", "t", "?t"))
    nested = base.optional(bgp(g, ("?s", "u", "?u")).optional(bgp(g, ("?s", "v", "?v"))))
    assert {tuple(r) for r in nested.project("s", "u", "v").df.collect()} == {("a", "x", "y"), ("b", None, None)}
    assert base.union(base).df.count() == 4
    assert [r["s"] for r in base.not_exists(bgp(g, ("?s", "u", "?u"))).df.collect()] == ["b"]
    assert base.minus(bgp(g, ("?z", "u", "?w"))).df.count() == 2
    assert base.exists(bgp(g, ("?s", "v", "?v"))).df.count() == 1
    assert base.values("s", ["b"]).df.count() == 1 and values(spark, "s", ["b"], "string").join(base).df.count() == 1
    assert base.ask() and not base.filter("s = 'z'").ask()
    with pytest.raises(QueryError):
        base.bind("t", F.lit(1))


def test_construct_is_a_set_without_unbound_parts(spark):
    g = TripleGraph(triples(spark, [("a", "t", "1"), ("b", "t", "1"), ("a", "u", "x")]))
    found = bgp(g, ("?s", "t", "?t")).optional(bgp(g, ("?s", "u", "?u")))
    out = found.construct([("?s", "is", "?t"), ("?s", "u2", "?u"), ("const", "c", "?t"), ("_:n", "of", "?s")])
    rows = {tuple(r) for r in out.collect()}
    assert {("a", "is", "1"), ("b", "is", "1"), ("a", "u2", "x"), ("const", "c", "1")} < rows
    assert len(rows) == 6 and rows == {tuple(r) for r in found.construct([("?s", "is", "?t"), ("?s", "u2", "?u"), ("const", "c", "?t"), ("_:n", "of", "?s")]).collect()}


def test_rows_and_tuples(spark):
    g = TripleGraph(triples(spark, [("a", "t", "1"), ("b", "t", "2")]))
    found = bgp(g, ("?s", "t", "?t"))
    assert sorted(found.tuples()) == [("a", "1"), ("b", "2")]
    assert list(found.filter("s = 'a'").rows(dict)) == [{"s": "a", "t": "1"}]
    with pytest.raises(QueryError):
        list(found.optional(bgp(g, ("?s", "none", "?z"))).tuples())


def test_json_solutions(spark):
    found = bgp(TripleGraph(triples(spark, [("a", "t", "1"), ("b", "t", "2")])), ("?s", "t", "?t"))
    back = Solutions.from_json(found.to_json(), "s string, t string")
    assert {tuple(r) for r in back.df.collect()} == {("a", "1"), ("b", "2")}


def test_star_is_one_scan(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "orders")
    found = bgp(g, ("?o", "orders.o_orderstatus", "F"), ("?o", "orders.o_totalprice", "?p"))
    plan = found.df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    assert "PushedFilters" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_comment" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_mapped_graph_errors(spark, sf_dir):
    g = mapped_graph(spark, sf_dir, "nation")
    assert isinstance(g, MappedGraph)
    for bad in [("?s", "?p", "?o"), ("?s", "a", "nothing"), ("?s", "no.such", "?o")]:
        with pytest.raises(QueryError):
            bgp(g, bad)
    assert g.triples().count() == 25 * 4
    assert ("nation/0", "nation.n_regionkey", "region/0") in {tuple(r) for r in g.triples().where("s = 'nation/0'").collect()}
    names = g.triples(predicates=["nation.n_name"])
    assert names.count() == 25 and "n_regionkey" not in names._jdf.queryExecution().executedPlan().toString()
    both = mapped_graph(spark, sf_dir, "orders", "supplier")
    with pytest.raises(QueryError, match="customer"):
        bgp(both, ("?o", "orders.o_custkey", "?c"), ("?c", "supplier.s_name", "?n"))


def test_paths(spark):
    g = TripleGraph(triples(spark, [("a", "p", "m"), ("m", "q", "b"), ("b", "p", "n"), ("n", "q", "a")]))
    assert {tuple(r) for r in path(g, "?x", ["p", "q"], "?y").df.collect()} == {("a", "b"), ("a", "a"), ("b", "a"), ("b", "b")}
    assert path(g, "?x", ["p"], "?y", zero=True).df.count() == 2 + 4


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 4) for i in range(4)], "s int, o int")
    assert path_closure(edges).count() == 16
    assert path_closure(edges.limit(0)).count() == 0


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(None, 3)], "s int, o int")
    assert path_closure(edges).count() == 100 * 101 // 2


# ---- joins


def test_nearest_matches_brute_force(spark):
    import random

    rng = random.Random(4)
    points = [(i, rng.uniform(-50, 50), rng.gauss(0, 5)) for i in range(200)] + [(999, 1e6, -1e6), (1000, None, 1.0)]
    centers = [(i, rng.uniform(-50, 50), rng.gauss(0, 5)) for i in range(17)] + [(50, 1.0, 1.0), (51, 1.0, 1.0)]
    p = spark.createDataFrame(points, "p int, x double, y double")
    c = spark.createDataFrame(centers, "c int, x double, y double")
    got = {r["p"]: r["c"] for r in joins.nearest(p, "p", ["x", "y"], c, "c", ["x", "y"]).collect()}
    expected = {i: min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in centers)[1] for i, x, y in points if x is not None}
    assert got == expected
    assert joins.nearest(p, "p", ["x"], c.limit(0), "c", ["x"]).where("c is null").count() == 201


def test_nearest_meets_few_centers_however_many_there_are(spark, monkeypatch):
    """Centers on a few lines, copied many times: a cell of the first grid holds few of them, and equal positions are one."""
    import random

    rng = random.Random(6)
    centers = [(i, round(rng.uniform(-1000, 10000), 2), float(rng.randrange(5))) for i in range(400)]
    centers += [(i + 400 * k, x, y) for k in range(1, 20) for i, x, y in centers]
    points = [(i, round(rng.uniform(-1000, 10000), 2), float(rng.randrange(5))) for i in range(100)]
    points += [(i + 100, x, y) for i, x, y in points] + [(0, 5.0, 2.0)]
    held, small = [], joins.small

    def seen(df, *more):
        if "_g0" in df.columns:
            held.append([r["count"] for r in df.groupBy("_g0", "_g1").count().collect()])
        return small(df, *more)

    monkeypatch.setattr(joins, "small", seen)
    p, c = spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(centers, "c int, x double, y double")
    got = joins.nearest(p, "p", ["x", "y"], c, "c", ["x", "y"]).collect()
    best = {i: min(min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in centers) for j, x, y in points if j == i) for i, _, _ in points}
    assert {r["p"]: (r["distance2"], r["c"]) for r in got} == best and len(got) == 200
    assert sum(n * n for n in held[0]) / sum(held[0]) <= 8 and sum(held[0]) <= 400


def test_division_and_latest(spark):
    have = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", 3)], "n string, i int")
    assert [r[0] for r in joins.division(have, "n", "i", [1, 2, 2]).collect()] == ["a"]
    assert joins.division(have, "n", "i", []).count() == 3
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, at int, v string")
    assert {r["v"] for r in joins.latest(log, ["k"], "at").collect()} == {"y", "z", "w"}
    assert {r["v"] for r in joins.latest_one(log, ["k"], ["at", "v"]).collect()} == {"z", "w"}


def test_datasets(spark):
    f = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3")], "k int, f string")
    t = spark.createDataFrame([(1, "t1"), (1, "t0"), (2, "t2")], "k int, t string")
    assert joins.key_join(f, t, ["k"]).count() == 3
    assert {tuple(r) for r in joins.key_join(f, t, ["k"], dedupe="min").collect()} == {(1, "f1", "t0"), (2, "f2", "t2")}
    assert [r["k"] for r in joins.unmatched(f, t, ["k"]).collect()] == [3]
    assert joins.unmatched(f, t, []).count() == 0 and joins.unmatched(f, t.limit(0), []).count() == 3
    with pytest.raises(QueryError):
        joins.key_join(f, t, [])
    with pytest.raises(MissingContext):
        joins.require(f.join(t, "k", "left"), "t", "k")


def test_units_over_several_hops(spark):
    units = spark.createDataFrame(
        [("bit", None, 1.0), ("byte", "bit", 8.0), ("megabyte", "byte", 1e6), ("bps", None, 1.0), ("gbps", "bps", 1e9)], "unit string, reference_unit string, factor double"
    )
    df = spark.createDataFrame([(2.0, "megabyte"), (3.0, "byte"), (1.0, "bit"), (1.0, "gbps"), (1.0, "unknown")], "v double, u string")
    got = {r["u"]: r["converted"] for r in joins.convert_units(df, "v", "u", "byte", units).collect()}
    assert got == {"megabyte": 2e6, "byte": 3.0, "bit": 0.125, "gbps": None, "unknown": None}
    chain = spark.createDataFrame([("u0", None, None), *[(f"u{i}", f"u{i - 1}", 2.0) for i in range(1, 12)]], units.schema)
    assert joins.convert_units(spark.createDataFrame([(1.0, "u11")], df.schema), "v", "u", "u0", chain).first()["converted"] == 2.0**11
    circle = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0)], units.schema)
    with pytest.raises(QueryError):
        joins.convert_units(df, "v", "u", "a", circle)


def test_division_by_a_table(spark):
    have = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, None)], "s int, i string")
    assert [r["s"] for r in joins.division(have, "s", "i", have).collect()] == [1]
    assert joins.division(have, "s", "i", have.limit(0)).count() == 3


def test_a_lost_write_does_not_stop_the_store(spark, tmp_path):
    store = update.GraphStore(spark, f"file://{tmp_path}/lost")
    store.insert(triples(spark, [("a", "p", "b")]))
    (tmp_path / "lost" / "u-half").mkdir()  # a folder that no entry of the log names
    (tmp_path / "lost" / "u-half" / "part-0.parquet").write_bytes(b"half")
    store.insert(triples(spark, [("c", "p", "d")]))
    assert store.version() == 1 and {r["s"] for r in store.triples().collect()} == {"a", "c"}


def test_of_two_writers_one_commits(spark, tmp_path):
    one, two = (update.GraphStore(spark, f"file://{tmp_path}/two") for _ in range(2))
    one.insert(triples(spark, [("a", "p", "b")]))
    began = one.version()
    one.update(None, triples(spark, [("c", "p", "d")]), began)
    with pytest.raises(Conflict):
        two.update(triples(spark, [("a", "p", "b")]), triples(spark, [("e", "p", "f")]), began)
    assert {r["s"] for r in two.triples().collect()} == {"a", "c"}
    two.update(triples(spark, [("a", "p", "b")]), triples(spark, [("e", "p", "f")]))
    assert {r["s"] for r in one.triples().collect()} == {"c", "e"} and {r["s"] for r in one.triples(began).collect()} == {"a"}


def test_bases_and_lookups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(update.GraphStore, "UPDATES", 3)
    store = update.GraphStore(spark, f"file://{tmp_path}/base")
    expected = set()
    for k in range(8):
        new, old = {(f"s{i}", "p", f"o{k}") for i in range(k, k + 4)}, {(f"s{k}", "p", f"o{k - 1}"), (f"s{k + 1}", "p", f"o{k}")}
        store.update(triples(spark, sorted(old)), triples(spark, sorted(new)))
        expected = (expected - old) | new
    assert {tuple(r) for r in store.triples().collect()} == expected
    assert store.version() > 7 and len(store._layers()[1]) < 3
    some = spark.createDataFrame([("s3",), ("s5",), ("s5",)], "x string")
    assert {tuple(r) for r in store.about(some).collect()} == {t for t in expected if t[0] in ("s3", "s5")}
    assert {tuple(r) for r in store.about(spark.createDataFrame([("o7",)], "x string"), "o").collect()} == {t for t in expected if t[2] == "o7"}
    # a lookup reads the buckets of its keys and not the whole base
    base = [f for f in store.triples().inputFiles() if "/by_s/" in f]
    assert 0 < len([f for f in store.about(some).inputFiles() if "/by_s/" in f]) <= 2 < len(base)


# ---- records


PERSON = RecordSpec(
    "Person",
    [Field("name", "name"), Field("age", "age", "uint8"), Field("likes", "likes", many=True), Field("note", "note", default="-"), Field("born", "born", "timestamp", optional=True)],
)
PEOPLE = [
    ("p1", "a", "Person"), ("p1", "name", "Ann"), ("p1", "age", "30"), ("p1", "likes", "tea"), ("p1", "born", "2000-01-02T03:04:05+01:00"),
    ("p2", "a", "Person"), ("p2", "name", "Bo"), ("p2", "age", "40"), ("p2", "likes", "a"), ("p2", "likes", "b"), ("p2", "likes", "c"),
    ("p3", "a", "Person"),
    ("p4", "a", "Person"), ("p4", "name", "Cy"), ("p4", "age", "300"),
    ("x", "a", "Dog"), ("x", "name", "Rex"),
]


def test_decode_records_and_errors(spark):
    good, bad = decode(triples(spark, PEOPLE), PERSON)
    rows = {r["subject"]: r for r in good.collect()}
    assert set(rows) == {"p1", "p2"} and rows["p2"]["likes"] == ["a", "b", "c"] and rows["p1"]["note"] == "-"
    assert rows["p1"]["age"] == 30 and str(rows["p1"]["born"]) == "2000-01-02 02:04:05" and rows["p2"]["born"] is None
    assert {tuple(r) for r in bad.collect()} == {("p3", "name", "no matching object"), ("p3", "age", "no matching object"), ("p4", "age", "not a uint8")}
    with pytest.raises(DecodeError, match="p3"):
        decode_all(triples(spark, PEOPLE), PERSON)
    assert first_record(triples(spark, PEOPLE), PERSON).first()["subject"] == "p1"


def test_encode_round_trip(spark):
    spec = RecordSpec("Task", [Field("status", "status", enum={"urn:ok": "Ok", "urn:run": "Running"}), Field("n", "n", "bigint"), Field("on", "on", many=True)])
    rows = triples(spark, [("t1", "a", "Task"), ("t1", "status", "urn:ok"), ("t1", "n", "5"), ("t1", "on", "x"), ("t1", "on", "y"), ("t2", "a", "Task"), ("t2", "status", "urn:bad"), ("t2", "n", "1")])
    good, bad = decode(rows, spec)
    assert [r["error"] for r in bad.collect()] == ["not a variant", "no matching object"] or [r["error"] for r in bad.collect()] == ["not a variant"]
    assert {tuple(r) for r in encode(good, spec).collect()} == {tuple(r) for r in rows.where("s = 't1'").collect()}


def test_nested_records(spark):
    inner = RecordSpec("Place", [Field("x", "x", "double", default=0.0)], "place")
    outer = RecordSpec("Node", [Field("at", "at", nested=inner)])
    rows = triples(spark, [("n1", "a", "Node"), ("n1", "at", "l1"), ("l1", "a", "Place"), ("l1", "x", "2.5"), ("n2", "a", "Node"), ("n2", "at", "l2")])
    good, bad = decode(rows, outer)
    assert good.select("subject", "at.place", "at.x").collect() == [("n1", "l1", 2.5)] and bad.first()["subject"] == "n2"
    assert ("n1", "at", "l1") in {tuple(r) for r in encode(good, outer).collect()}


def test_lists_and_containers(spark):
    cells = triples(
        spark,
        [("l1", "first", "hello"), ("l1", "rest", "l2"), ("l2", "first", "world"), ("l2", "rest", "nil"), ("c1", "first", "x"), ("c1", "rest", "c2"), ("c2", "first", "y")],
    )
    assert {r["head"]: r["items"] for r in decode_lists(cells).collect()} == {"l1": ["hello", "world"], "c1": ["x"]}
    seq = triples(spark, [("s", "a", "Seq"), ("s", "_1", "a"), ("s", "_3", "c"), ("s", "_2", "b"), ("g", "a", "Bag"), ("g", "_1", "a"), ("g", "_3", "c"), ("e", "a", "Alt")])
    assert {r["s"]: (r["kind"], r["items"]) for r in decode_containers(seq).collect()} == {"s": ("Seq", ["a", "b", "c"]), "g": ("Bag", ["a"]), "e": ("Alt", [])}
    assert decode_containers(seq, kind="Seq").count() == 1


def test_long_lists_shared_ends_and_circles(spark):
    n = 10_500
    rows = [(f"c{i}", "first", str(i)) for i in range(n)] + [(f"c{i}", "rest", f"c{i + 1}" if i + 1 < n else "nil") for i in range(n)]
    rows += [("b", "first", "b"), ("b", "rest", f"c{n - 2}")]
    out = {r["head"]: r["items"] for r in decode_lists(triples(spark, rows)).collect()}
    assert out == {"c0": [str(i) for i in range(n)], "b": ["b", str(n - 2), str(n - 1)]}
    for links in ([("a", "b"), ("b", "c"), ("c", "b")], [("a", "b"), ("b", "a")], [("a", "a")]):
        circle = [(s, "first", s) for s in "abc"] + [(s, "rest", o) for s, o in links]
        with pytest.raises(DecodeError, match="circle"):
            decode_lists(triples(spark, circle))
    assert decode_lists(triples(spark, [])).collect() == []


def test_lookup_and_subjects(spark):
    g = triples(spark, [("a", "p", "2"), ("a", "p", "1"), ("b", "q", "3")])
    assert lookup(g, g.select("s"), "p").collect() == [("a", "1")] and lookup(g, g.select("s"), "p", many=True).first()["value"] == ["1", "2"]
    names = g.select(subject_hash("c", F.col("s"), F.col("o")).alias("n"))
    assert names.distinct().count() == 3 and names.first()["n"].startswith("_:")


# ---- inference, updates


def test_materialize(spark):
    g = triples(spark, [("a", "acquiredBy", "n"), ("C", "subClassOf", "B"), ("B", "subClassOf", "A"), ("x", "a", "C"), ("x", "repBy", "r"), ("r", "cat", "k"), ("x", "in", "y"), ("y", "in", "z"), ("q", "sub", "1")])
    axioms = infer.Axioms(
        inverse=[("acquired", "acquiredBy")], sub_property=[("sub", "mid"), ("mid", "top")], transitive=["in"], chains={"label": ["repBy", "cat"]},
        equivalent_class=[("A", "A2")], domain={"cat": "Rep"}, range={"cat": "Cat"},
    )
    rows = {tuple(r) for r in infer.materialize(g, axioms, [*infer.RULES, "equivalent_class", "domain_range"]).collect()}
    assert {("n", "acquired", "a"), ("C", "subClassOf", "A"), ("x", "a", "A"), ("x", "a", "A2"), ("x", "label", "k"), ("x", "in", "z"), ("q", "top", "1"), ("r", "a", "Rep"), ("k", "a", "Cat")} <= rows
    assert infer.functional_violations(triples(spark, [("a", "f", "1"), ("a", "f", "2"), ("b", "f", "1")]), ["f"]).count() == 1


def test_store_versions_and_updates(spark):
    store = update.GraphStore(spark, new_path(spark, "store"))
    assert store.version() == -1 and store.triples().count() == 0
    store.insert(triples(spark, [("n1", "acquires", "C1"), ("n1", "a", "EdgeNode"), ("C1", "visibility", "Public"), ("C1", "a", "Class")]))
    store.insert(triples(spark, [("n1", "acquires", "C1")]))
    assert store.version() == 1 and store.triples().count() == 4 and store.is_public("C1") and not store.is_public("C2")
    store.replace(["n1"], ["acquires"], triples(spark, [("n1", "acquires", "C2"), ("n1", "acquires", "C3")]))
    assert not store.contains("n1", "acquires", "C1") and store.object("n1", "acquires") == "C2"
    store.replace([], ["acquires"], None)
    other = store.use_graph("other")
    other.insert(triples(spark, [("z", "a", "Z")]))
    assert other.triples().count() == 1 and store.triples().count() == 5
    assert store.require_classes(["C1"]).count() == 2
    with pytest.raises(NotFound):
        store.require_classes(["C9"])
    store.execute("snapshot", f"{store.path}-copy")
    with pytest.raises(QueryError):
        store.execute("drop")
    assert spark.read.parquet(f"{store.path}-copy").count() == 5


def test_update_deletes_before_it_inserts(spark):
    g = triples(spark, [("a", "p", "1"), ("b", "p", "1")])
    out = update.apply_update(g, g.where("s = 'a'"), triples(spark, [("a", "p", "1"), ("c", "p", "2"), ("c", "p", "2")]))
    assert sorted(tuple(r) for r in out.collect()) == [("a", "p", "1"), ("b", "p", "1"), ("c", "p", "2")]
    assert update.insert_new(g, out).count() == 1


# ---- Turtle


TEXT = """@prefix ex: <urn:ctx:> . PREFIX f: <http://f.org/#>
ex:a a ex:C ; ex:name "A \\"q\\" \\u00e9"@en-GB, 'b' ; f:n 1, 2.5, 1e3, true ; ex:items ( "x" ex:y ) .  # comment
<urn:ctx:b> ex:at [ a ex:P ; ex:v \"\"\"long
text\"\"\"^^ex:T ] ."""


def test_scan_turtle():
    rows = scan_text(TEXT)
    objects = {(s, p): o for s, p, o, *_ in rows}
    assert ("urn:ctx:a", "urn:ctx:name", 'A "q" é', "literal", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en-gb") in rows
    assert {o for s, p, o, *_ in rows if p == "http://f.org/#n"} == {"1", "2.5", "1e3", "true"}
    assert objects[objects["urn:ctx:b", "urn:ctx:at"], "urn:ctx:v"] == "long\ntext"
    for bad in ("ex:a ex:b ex:c .", "<a> <b> ", '<a> <b> "x', "<a> <b> <c> <d> ."):
        with pytest.raises(DecodeError):
            scan_text(bad)


def test_turtle_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.ttl").write_text(TEXT)
    (tmp_path / "in" / "sub" / "b.ttl").write_text("<urn:ctx:z> <urn:ctx:p> 'tab\\t' .")
    df = read_turtle(spark, str(tmp_path / "in"))
    assert df.count() == len(scan_text(TEXT)) + 1
    write_turtle(df, str(tmp_path / "out"), PREFIXES)
    back = read_turtle(spark, str(tmp_path / "out"), pattern="*.txt")
    plain = ["p", "o_kind", "o_type", "o_lang"]
    assert sorted(map(repr, back.select(*plain).collect())) == sorted(map(repr, df.select(*plain).collect()))
    assert {r["o"] for r in back.where("o_kind = 'literal'").collect()} == {r["o"] for r in df.where("o_kind = 'literal'").collect()}


def test_turtle_faults(spark, tmp_path):
    (tmp_path / "ok.ttl").write_text("<a:a> <a:b> <a:c> .")
    (tmp_path / "bad.ttl").write_text("<a:a> <a:b> .")
    rows = read_turtle(spark, str(tmp_path), mode="PERMISSIVE").collect()
    assert len(rows) == 2 and sum(r["error"] is not None for r in rows) == 1
    with pytest.raises(Exception, match="bad.ttl"):
        read_turtle(spark, str(tmp_path)).collect()


def test_format_guesses_kinds(spark):
    lines = [r["value"] for r in format_triples(triples(spark, [("urn:a", "urn:p", "urn:b"), ("_:x", "urn:p", "two words")])).collect()]
    assert lines == ["<urn:a> <urn:p> <urn:b> .", '_:x <urn:p> "two words" .']
