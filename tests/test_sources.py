"""Files in and out, networks, streams, numbers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplewright.functions import numbers
from triplewright.graph import Graph
from triplewright.operators import neural
from triplewright.sources import entities, reports, tables
from triplewright.streaming.incremental import Incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def value(x):
    return {"value": x, "type": "wikibase-entityid" if isinstance(x, dict) and "id" in x else "other"}


def snak(p, x=None, kind="value"):
    return {"snaktype": kind, "property": p} | ({"datavalue": value(x)} if x is not None else {})


DUMP = [
    {"id": "Q100", "type": "item", "labels": {"en": {"language": "en", "value": "hundred"}, "de": {"language": "de", "value": "Hundert"}},
     "claims": {"P2738": [{"mainsnak": snak("P2738", {"id": "Q900"}), "id": "Q100-a", "rank": "normal", "qualifiers": {"P11260": [snak("P11260", {"id": "Q101"}), snak("P11260", {"id": "Q102"})], "P580": [snak("P580", {"time": "+1999-05-01T00:00:00Z"})]}}]}},
    {"id": "Q200", "type": "item", "labels": {},
     "claims": {"P39": [{"mainsnak": snak("P39", {"id": "Q901"}), "id": "Q200-a", "rank": "deprecated", "qualifiers": {"P580": [snak("P580", {"time": "+2020-01-01T00:00:00Z"})], "P1111": [snak("P1111", {"amount": "+42"})], "P582": [snak("P582", kind="novalue")]}}],
                "P31": [{"mainsnak": snak("P31", kind="somevalue"), "id": "Q200-b", "rank": "normal"}, {"mainsnak": snak("P31", {"id": "Q5"}), "id": "Q200-c", "rank": "normal"}]}},
]


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "dump.json"
    path.write_text("[\n" + ",\n".join(map(json.dumps, DUMP)) + "\n]\n")
    return entities.entities(spark, str(path))


def test_direct_import(dump):
    assert rows(entities.direct(dump).select("s", "p", "o", "rank")) == [("Q100", "P2738", "Q900", "normal"), ("Q200", "P31", "Q5", "normal"), ("Q200", "P39", "Q901", "deprecated")]
    assert rows(entities.names(dump)) == [("Q100", "en", "hundred")]


def test_qualifiers(dump, tmp_path, spark):
    assert rows(entities.qualified(dump)) == sorted([
        ("Q100", "p:P2738", "Q100-a"), ("Q100-a", "ps:P2738", "Q900"), ("Q100-a", "pq:P11260", "Q101"), ("Q100-a", "pq:P11260", "Q102"), ("Q100-a", "pq:P580", "+1999-05-01T00:00:00Z"), ("Q100-a", "wikibase:rank", "wikibase:NormalRank"),
        ("Q200", "p:P39", "Q200-a"), ("Q200-a", "ps:P39", "Q901"), ("Q200-a", "pq:P580", "+2020-01-01T00:00:00Z"), ("Q200-a", "pq:P1111", "+42"), ("Q200-a", "wikibase:rank", "wikibase:DeprecatedRank"),
    ])
    assert {r[0] for r in rows(entities.qualified(dump, ["P11260"]))} == {"Q100", "Q100-a"}
    g = Graph.empty(spark).insert_triples(entities.qualified(dump))
    assert rows(g.sparql("SELECT ?v { wd:Q100 p:P2738/pq:P11260 ?v }")) == [("Q101",), ("Q102",)]
    entities.extract(dump, ["Q200"], str(tmp_path / "out"))
    assert entities.entities(spark, str(tmp_path / "out")).count() == 1


def test_constraints(spark, tmp_path):
    path = tmp_path / "p.json"
    claim = lambda kind, **q: {"mainsnak": snak("P2302", {"id": kind}), "id": kind, "rank": "normal", "qualifiers": {k: [snak(k, {"id": v})] for k, v in q.items()}}
    path.write_text(json.dumps({"id": "P9", "type": "property", "labels": {}, "claims": {"P2302": [claim("Q21502838", P2306="P31", P2305="Q5"), claim("Q52558054", P2305="Q7"), claim("Q1", P2305="Q7")]}}))
    assert rows(entities.constraint_rules(entities.entities(spark, str(path))).fillna("none")) == [("P9", "Q1", "none"), ("P9", "Q21502838", "(X P9 Y, X P31 Q5) => !"), ("P9", "Q52558054", "(X P9 Q7) => !")]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "d.csv").write_text("s,p,o\ntim, ancestor ,tom\ntom,ancestor,paul\nbroken,row\n")
    assert rows(tables.csv_triples(spark, str(tmp_path / "d.csv"))) == [("tim", "ancestor", "tom"), ("tom", "ancestor", "paul")]
    (tmp_path / "d.json").write_text(json.dumps([{"species": "Wolf", "family": "Canidae", "order": "Carnivora", "class": "Mammalia"}, {"species": "Red Fox", "family": "Canidae", "order": "Carnivora", "class": "Mammalia"}]))
    chains = tables.record_chains(tables.json_records(spark, str(tmp_path / "d.json")), ["species", "family", "order", "class"])
    assert chains.count() == 4
    g = Graph.empty(spark).insert_triples(chains).add('(R is transitive, A R B, B R C) => (A R C)', '"member of" is transitive')
    members = g.infer()[0].sources("member of", "Mammalia")
    assert rows(members) == [("Canidae",), ("Carnivora",), ("Red Fox",), ("Wolf",)]
    tables.write_json(members, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    assert tables.record_facts(spark.createDataFrame([(1, "x", None)], "id int, a string, b string"), "id").collect()[0]["p"] == "a"


def test_reports(spark):
    g, _ = Graph.empty(spark).add("(A x B, B x C) => (A y C)", "a x b", "b x c").infer()
    lines = reports.deductions(g)
    assert rows(lines) == [("(a x b), (b x c) => (a y c)",)]
    coded, table = reports.encode(lines)
    assert rows(reports.decode(coded, table)) == rows(lines) and all(ord(c) >= reports.FIRST_SIGN or c == " " for c in coded.first()["text"])
    assert dict(rows(reports.pages(g)))["a"] == "# a\n\n- x b\n- y c *(derived)*\n"
    assert reports.drawing(spark, g, "a", 1).count("-->") == 2
    with pytest.raises(ValueError):
        reports.drawing(spark, g, "a", 1, most=1)


def test_network_forward_and_training(spark):
    wires = spark.createDataFrame([("a", "h1", 1.0), ("b", "h1", 1.0), ("a", "h2", 1.0), ("b", "h2", 1.0), ("one", "h2", -1.0), ("h1", "y", 1.0), ("h2", "y", -2.0)], "src string, dst string, w double")
    inputs = spark.createDataFrame([(k, n, float(v)) for k, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)]) for n, v in (("a", a), ("b", b), ("one", 1))], "sample int, node string, value double")
    layer = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    out = {r["sample"]: r["value"] for r in neural.forward(wires, inputs, [layer("h1", "h2"), layer("y")]).collect()}
    assert out == {0: 0.0, 1: 1.0, 2: 1.0, 3: 0.0}
    net = neural.Compiled(wires, [["a", "b", "one"], ["h1", "h2"], ["y"]])
    assert net.evaluate(np.array([1.0, 1.0, 1.0]))[-1].tolist() == [0.0]
    losses = [net.train(np.array([1.0, 0.0, 1.0]), np.array([2.0]), 0.05) for _ in range(60)]
    assert losses[-1] < 1e-3 < losses[0] and net.weights[0][2, 0] == 0  # no synapse, no weight
    assert neural.weight(neural.set_weight(wires, "a", "h1", 3), "a", "h1") == 3
    edges = spark.createDataFrame([(f"s{k}", f"o{k % 3}") for k in range(9)], "s string, o string")
    net, loss = neural.link_predictor(spark, edges, epochs=200, rate=0.2)
    assert loss < 0.05 and net.best("s4", 1)[0][0] == "o1" and net.scores(spark).count() == 27


def test_stream(spark, tmp_path):
    g = Graph.empty(spark).add("(A next B) => (A before B)", "(A before B, B next C) => (A before C)")
    steps = Incremental(g)
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(str(k), "next", str(k + 1))], "s string, p string, o string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("s string, p string, o string").parquet(str(source))
        q = steps.start(stream, str(tmp_path / "check"))
        q.awaitTermination()
    assert rows(steps.graph.triples.where("p = 'before'").select("s", "o")) == [(str(a), str(b)) for a in range(3) for b in range(a + 1, 4)]


ARITHMETIC = [("+", "98", "13", "111"), ("+", "67", "45", "112"), ("-", "123456", "54321", "69135"), ("-", "1000", "1", "999"), ("-", "5", "7", None), ("*", "12", "34", "408"), ("*", "99", "99", "9801"), ("/", "123", "4", "30"), ("%", "123", "4", "3"), ("/", "1000", "7", "142"), ("/", "3", "12", "0"), ("/", "5", "0", None), ("%", "5", "0", None), ("+", "x", "1", None)]


def test_numbers(spark):
    fns = {"+": numbers.add, "-": numbers.subtract, "*": numbers.multiply, "/": numbers.divide, "%": numbers.modulo}
    df = spark.createDataFrame([(a, b) for _, a, b, _ in ARITHMETIC], "a string, b string")
    for big in (False, True):
        out = {}
        for op, f in fns.items():
            for r in df.distinct().select("a", "b", f(F.col("a"), F.col("b"), big).alias("r")).collect():
                out[op, r["a"], r["b"]] = r["r"]
        assert all(out[op, a, b] == r for op, a, b, r in ARITHMETIC)
    huge = spark.createDataFrame([("9" * 60, "8" * 50)], "a string, b string").select(numbers.multiply(F.col("a"), F.col("b"), True).alias("r")).first()["r"]
    assert huge == str(int("9" * 60) * int("8" * 50))
    one = spark.range(1).select(numbers.compare(F.lit("0039"), F.lit("41")), numbers.compare(F.lit("7"), F.lit("007")), numbers.canonical(F.lit("000")), numbers.to_base(F.lit("5"), 2), numbers.primality(F.lit(13)), numbers.smallest_divisor(F.lit(9)), numbers.primality(F.lit(1))).first()
    assert tuple(one) == ("<", "==", "0", "101", "prime", 3, None)
