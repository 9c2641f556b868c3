"""One model in three layouts, mappings, exports, incremental runs, stores and streams."""

import json

import pytest
from pyspark.sql import functions as F

from skemaforge import __main__ as command
from skemaforge.operators import foreign_keys, inference, metrics, profile, relational
from skemaforge.plans import analysis, evaluation, exports, service, snapshot
from skemaforge.plans.mapping import PhysicalMapping
from skemaforge.sources import generator, star, store
from skemaforge.sources.catalog import Catalog, Collection, Graph, compatible, sample, type_category
from skemaforge.streaming import changes

MODEL = {
    "entities": [{"name": "Person", "properties": ["name", "age"]}, {"name": "Movie", "properties": ["title", "year"]}],
    "relationships": [{"type": "ACTED_IN", "from": "Person", "to": "Movie", "properties": ["role"]}, {"type": "DIRECTED", "from": "Person", "to": "Movie", "properties": []}],
}


@pytest.fixture(scope="module")
def layouts(spark):
    return {shared: generator.materialize(spark, MODEL, shared, scale=40) for shared in (False, True)}


def test_layouts_give_one_model(layouts):
    a, b = analysis.analyze(layouts[False]), analysis.analyze(layouts[True])
    assert a.conceptual == b.conceptual
    assert [e["name"] for e in a.conceptual["entities"]] == ["Movie", "Person"]
    assert {m["style"] for m in a.mapping["entities"].values()} == {"COLLECTION"}
    assert {m["style"] for m in b.mapping["relationships"].values()} == {"GENERIC_WITH_TYPE"}
    assert [(s["relation"], s["edges"]) for s in a.statistics] == [(s["relation"], s["edges"]) for s in b.statistics] == [("ACTED_IN", 80), ("DIRECTED", 80)]


def test_traversals_agree(layouts):
    counts = []
    for c in layouts.values():
        m = analysis.analyze(c).physical(c)
        out = m.traverse("ACTED_IN")
        assert out.where(F.col("t__id").isNull()).isEmpty()
        counts.append((out.count(), m.traverse("ACTED_IN", "inbound").count(), m.extent(["Person", "Movie"]).count(), m.entity("Person").count()))
    assert counts[0] == counts[1] == (80, 80, 80, 40)


def test_label_filter_reaches_the_scan(spark, layouts, tmp_path):
    layouts[True].collections["entities"].df.write.parquet(str(tmp_path / "e"))
    rows = relational.labelled(spark.read.parquet(str(tmp_path / "e")), "type", "Person")
    assert "EqualTo(type,Person)" in rows._jdf.queryExecution().executedPlan().toString()


def test_resolve_reports_errors(layouts):
    m = PhysicalMapping(layouts[False], {"Ghost": {"style": "COLLECTION", "collection": "ghosts"}, "Odd": {"style": "NONE"}}, {"R": {"style": "FOREIGN_KEY"}})
    got = m.resolve()
    assert all("INVALID_ARGUMENT" in v["error"] for v in got.values()) and set(got) == {"Ghost", "Odd", "R"}


def test_foreign_key_and_junction_mappings(spark):
    frame = lambda rows, s: (lambda: spark.createDataFrame(rows, s))
    c = Catalog(spark, [Collection("album", frame([("1", "a"), ("2", None)], "_key string, artist string")), Collection("artist", frame([("a",), ("b",)], "_key string")), Collection("credit", frame([("1", "a"), ("1", "b")], "album string, artist string"))])
    m = PhysicalMapping(c, {}, {
        "BY": {"style": "FOREIGN_KEY", "from_collection": "album", "from_fields": ["artist"], "to_collection": "artist", "to_key_fields": ["_key"]},
        "CREDITS": {"style": "JOIN_TABLE", "collection": "credit", "from_collection": "album", "from_keys": ["_key"], "near_fields": ["album"], "far_fields": ["artist"], "to_collection": "artist", "to_keys": ["_key"]},
    })
    assert [(r["s__key"], r["t__key"]) for r in m.traverse("BY").collect()] == [("1", "a")]
    assert m.traverse("BY", "inbound").count() == 1 and m.traverse("CREDITS").count() == 2 and m.traverse("CREDITS", "inbound").count() == 2


def test_directions_and_types_are_checked(layouts):
    e = layouts[True].collections["entities"].df
    with pytest.raises(ValueError, match="INVALID_ARGUMENT"):
        relational.traverse(e, e, e, "sideways")
    with pytest.raises(ValueError, match="two type fields"):
        relational.class_extent([("x", e, "type", ("Person",)), ("x", e, "name", ("b",))])
    assert type_category("integer") == "integer" and type_category("array") == "unknown"
    assert compatible("integer", "float") and compatible("unknown", "string") and not compatible("integer", "string")


def test_incremental(layouts, spark):
    c = layouts[False]
    first = analysis.analyze(c)
    assert analysis.analyze_incremental(c, first) == ("unchanged", first)
    more = generator.materialize(spark, MODEL, False, scale=41)
    state, new = analysis.analyze_incremental(more, first)
    assert state == "stats_changed" and new.conceptual == first.conceptual and new.statistics[0]["edges"] == 82
    more.collections["extra"] = Collection("extra", lambda: spark.range(1).selectExpr("cast(id as string) _key", "concat('extra/', id) _id"))
    assert analysis.analyze_incremental(more, first)[0] == "shape_changed"
    assert analysis.change(None, c) == "no_cache"


def test_foreign_keys_join_the_model(spark, sf_dir):
    c = star.relational(spark, sf_dir)
    true = {("visits", "visitor", "customers"), ("customers", "nation_id", "nations"), ("items", "part_key", "parts"), ("items", "purchase_id", "purchases"), ("items", "supplier_id", "suppliers"), ("nations", "regionId", "regions"), ("nations", "region_name", "regions"), ("purchases", "customerId", "customers"), ("suppliers", "nationid", "nations")}
    found = foreign_keys.infer(c)[0].collect()
    assert {(r["collection"], r["fields"][0], r["target"]) for r in found if len(r["fields"]) == 1} == true
    a = analysis.analyze(c)
    # collections with a label field are several entities, so what refers to one of them as a whole has no entity
    whole = {m["collection"] for m in a.mapping["entities"].values() if m["style"] == "COLLECTION"}
    want = {x for x in true if x[0] in whole and x[2] in whole}
    keys = {(m["from_collection"], m["from_fields"][0], m["to_collection"]) for m in a.mapping["relationships"].values() if len(m["from_fields"]) == 1}
    assert keys == want and ("items", "part_key", "parts") in want
    status = a.extra["foreignKeys"]
    assert (status["status"], status["candidates"], status["added"] + status["unmapped"]) == ("ok", 10, 10)
    assert a.extra["quality"]["dangling"] == 0 and a.extra["quality"]["grounding"] == 1.0 and a.extra["detected"]["tenancy"]["style"] == "none"
    m = a.physical(c)
    relation = next(n for n, x in a.mapping["relationships"].items() if x["to_collection"] == "parts")
    assert m.traverse(relation).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert foreign_keys.infer(c, limit=2)[1]


def test_empty_edges_single_types_and_equal_names(spark):
    frame = lambda rows, s: (lambda: spark.createDataFrame(rows, s))
    pair = "_key string, _id string"
    c = Catalog(spark, [
        Collection("crates", frame([("1", "crates/1")], pair)), Collection("crate", frame([("1", "crate/1")], pair)), Collection("depots", frame([("1", "depots/1")], pair)),
        Collection("stored", frame([], "_from string, _to string"), "edge"), Collection("links", frame([("crates/1", "depots/1", "NEAR")], "_from string, _to string, type string"), "edge"),
    ], [Graph("g", [("stored", ["crates"], ["depots"])])])
    a = analysis.analyze(c)
    assert set(a.mapping["entities"]) == {"Crate", "Crate_crates", "Depot"}
    r = a.mapping["relationships"]
    assert (r["STORED"]["from_entity"], r["STORED"]["to_entity"]) == ("Crate_crates", "Depot")
    assert r["NEAR"]["style"] == "GENERIC_WITH_TYPE" and (r["NEAR"]["from_entity"], r["NEAR"]["to_entity"]) == ("Crate_crates", "Depot")


def test_evaluation_run_and_gate(spark):
    report = evaluation.run(spark, {"films": MODEL}, scale=40)
    rows = {r["variant"]: r.asDict() for r in report.collect()}
    assert set(rows) == {"collection_dedicated", "generic_generic"}
    for r in rows.values():
        assert all(r[k] == 1.0 for k in ("entity_f1", "relationship_f1", "domain_range_f1", "entity_mapping", "relationship_mapping"))
    worse = report.withColumn("entity_f1", F.col("entity_f1") - 0.1)
    assert {r["metric"] for r in evaluation.compared(report, worse).collect()} == {"entity_f1"} and evaluation.compared(report, report).isEmpty()
    assert evaluation.overall(report).count() == 2


def test_snapshot(spark, sf_dir, layouts):
    c = layouts[True]
    snap = snapshot.snapshot(c, samples=1)
    again = snapshot.snapshot(c)
    assert snapshot.fingerprint(snap) == snapshot.fingerprint(again) and snapshot.fingerprint(snap, True) != snapshot.fingerprint(again, True)
    assert {x["name"]: x["count"] for x in snap["collections"]} == {"entities": 80, "relationships": 160}
    assert dict(snap["collections"][0]["values"]["type"]) == {"Movie": 40, "Person": 40} and snap["collections"][1]["endpoints"] == [("entities", "entities")]
    assert snapshot.fingerprint(snapshot.snapshot(layouts[False])) != snapshot.fingerprint(snap)
    cut = snapshot.truncated(snap, 1)
    assert cut["omitted"] == 1 and [set(x) == {"name", "type", "count"} for x in cut["collections"]] == [True, False]
    assert service.run({"operation": "snapshot", "full": True}, spark, c)["fingerprint"] == snapshot.fingerprint(snap)


def test_exports(layouts):
    a = analysis.analyze(layouts[False])
    assert ":ACTED_IN a owl:ObjectProperty" in exports.turtle(a) and "rdfs:domain :Person" in exports.turtle(a)
    assert len(exports.json_ld(a)["@graph"]) == 4 and len(exports.vocabulary(a)["predicates"]) == 2
    assert "| ACTED_IN | Person | Movie | 80 |" in exports.markdown(a)
    assert exports.from_interchange(json.loads(json.dumps(exports.interchange(a)))).conceptual == a.conceptual
    assert set(exports.graph_bundle(a)["types"]) == {"ACTED_IN", "DIRECTED"} and json.loads(a.to_json())["counts"]["person" if "person" in a.counts else "Person"] == 40


def test_differences_and_issues(spark, layouts):
    a, b = (analysis.analyze(layouts[x], foreign=False) for x in (False, True))
    found = exports.diff(spark, a, b)
    assert found["differs"] and not exports.diff(spark, a, a)["differs"]
    assert found["relationship"] == {"added": [], "removed": [], "changed": [], "restyled": ["ACTED_IN", "DIRECTED"]}
    assert (found["entity"]["added"], found["entity"]["removed"]) == ([], [])
    assert "PG_DEDICATED_EDGE" in a.extra["patterns"] and "LPG_GENERIC_EDGE" in b.extra["patterns"]
    assert exports.issues(spark, exports.interchange(a)) == ["relationship ACTED_IN: actedIn", "relationship DIRECTED: directed"]
    assert exports.issues(spark, {"version": "1"})[:2] == ["conceptualModel is missing", "physicalMapping is missing"]


def test_probes_of_ones_own(spark, sf_dir):
    never = lambda catalog, candidates, limit, sampled: (spark.createDataFrame([], foreign_keys.PROBE), True)
    ranked, short = foreign_keys.infer(star.relational(spark, sf_dir), probe=never)
    assert short and ("parts", ["region_id"]) in [(r["collection"], r["fields"]) for r in ranked.collect()]


def test_domain_relationships(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"domain": "film", **MODEL}))
    assert [tuple(r) for r in store.read_domain_relationships(spark, str(tmp_path)).orderBy("relation").collect()] == [("film", "ACTED_IN", "Person", "Movie"), ("film", "DIRECTED", "Person", "Movie")]


def test_service(spark, sf_dir, layouts):
    assert len(service.run({"operation": "snapshot", "path": sf_dir}, spark)["result"]) == 9
    assert service.run({"operation": "export", "target": "graph"}, spark, layouts[False])["ok"]
    assert service.run({"operation": "resolve"}, spark, layouts[False])["result"]["Person"]["kind"] == "entity"
    assert service.run({"operation": "none"}, spark)["error"]["code"] == "INVALID_ARGUMENT"
    assert service.run({"operation": "export", "target": "?"}, spark, layouts[False])["error"]["code"] == "INVALID_ARGUMENT"


def test_command_line(spark, sf_dir, tmp_path, capsys):
    assert command.main(["counts", "--path", sf_dir]) == 0
    counts = {r["collection"]: r["rows"] for r in json.loads(capsys.readouterr().out)["result"]}
    assert counts["region"] == 5 and len(counts) == 9
    assert command.main(["export", "--path", sf_dir, "--graph", "none", "--target", "graph", "--out", str(tmp_path / "o.json")]) == 1
    assert json.loads((tmp_path / "o.json").read_text())["error"]["code"] == "INVALID_ARGUMENT"


def test_graphs_and_samples(spark, sf_dir):
    cat = star.catalog(spark, sf_dir)
    with pytest.raises(ValueError):
        cat.user_collections(graph="none")
    assert Graph.from_dict({"name": "g", "edge_definitions": [{"edge_collection": "e", "from_vertex_collections": ["b", "a"], "to_vertex_collections": []}]}).edge_definitions == [("e", ["a", "b"], [])]
    assert [r["_key"] for r in sample(star.vertices(spark, sf_dir, "region"), 2).collect()] == ["0", "1"]


def test_store(spark, tmp_path):
    cache = store.FileCache(str(tmp_path / "c"))
    assert cache.get("abc") is None
    cache.set("abc", {"x": 1})
    assert cache.get("abc") == {"x": 1} and store.FileCache(str(tmp_path / "c"), ttl=-1).get("abc") is None
    cache.invalidate("abc")
    assert cache.get("abc") is None
    with pytest.raises(ValueError):
        cache.get("../x")
    h = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.75)], "series string, position int, value double")
    store.append_history(h, str(tmp_path / "h"))
    store.append_history(h.limit(1), str(tmp_path / "h"))
    assert metrics.history_summary(store.read_history(spark, str(tmp_path / "h")), "series", "position", "value").first()["delta"] == 0.25
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.json").write_text(json.dumps({"domain": "x", "entities": [{"name": "A", "properties": ["p"]}]}))
    assert store.read_domains(spark, str(tmp_path / "d")).first()["entity"] == "A"


def test_streams(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.append_value_counts(stream(), ["event_type"], str(tmp_path / "out"), str(tmp_path / "ck1")).awaitTermination()
    merged = {r["value"]: r["count"] for r in changes.merged_value_counts(spark.read.parquet(str(tmp_path / "out"))).collect()}
    static = {r["value"]: r["count"] for r in profile.value_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"]).collect()}
    assert merged == static
    q = changes.windowed_counts(stream(), "ts", "event_type", "1 day", "1000 days").writeStream.format("memory").queryName("w").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("w").groupBy("start", "label").agg(F.max("n").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == sum(static.values())


def test_degenerate_metrics(spark):
    some, none = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "name string")
    assert metrics.precision_recall(none, some).first()["recall"] == 0.0 and metrics.precision_recall(some, none).first()["precision"] == 0.0
    good = spark.createDataFrame([(0.2, True), (0.9, True)], "s double, g boolean")
    assert metrics.youden(good, "s", "g").first()["threshold"] == 0.2
    bad = spark.createDataFrame([(0.2, False), (0.9, False)], "s double, g boolean")
    assert metrics.youden(bad, "s", "g").first()["threshold"] == pytest.approx(0.91)


def test_ties_and_types_of_discriminators(spark):
    counts = spark.createDataFrame([("c", f, v, 5) for f in ("zone", "kind") for v in ("a", "b")] + [("c", "note", "two words", 10)], "collection string, field string, value string, count long")
    totals = spark.createDataFrame([("c", 10)], "collection string, rows long")
    assert inference.choose_discriminator(counts, totals).first()["field"] == "kind"
    assert inference.choose_discriminator(counts, spark.createDataFrame([("c", 20)], "collection string, rows long")).isEmpty()
