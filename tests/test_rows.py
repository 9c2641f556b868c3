"""Operators on rows and their place in an analysis, against plain Python on small and odd inputs."""

import hashlib
import hmac
import json
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from skemaforge.operators import foreign_keys, health, inclusion, inference, numbering, partials, profile, relational, shapes, taxonomy
from skemaforge.plans import analysis, exports, service, snapshot
from skemaforge.plans.mapping import PhysicalMapping
from skemaforge.sources import star
from skemaforge.sources.catalog import Catalog, Collection


def frame(spark, rows, schema):
    return lambda: spark.createDataFrame(rows, schema)


def documents(spark, **tables):
    """A catalog of collections: name to (schema, rows)."""
    return Catalog(spark, [Collection(n, frame(spark, rows, schema)) for n, (schema, rows) in tables.items()])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- inclusion --------------------------------------------------------------------------------------------------


def some_columns(spark):
    rnd = random.Random(5)
    pool = [str(i) for i in range(40)] + [None, "a b", "x/1", "é"]
    columns = {f"c{i}": {f"f{j}": [rnd.choice(pool[: 5 + 6 * i + 3 * j]) for _ in range(60)] for j in range(2)} for i in range(5)}
    tables = {c: ("f0 string, f1 string", list(zip(*own.values()))) for c, own in columns.items()}
    return columns, documents(spark, **tables)


def test_matches_of_all_columns(spark):
    columns, cat = some_columns(spark)
    sets = {(c, f): {v for v in values if v is not None} for c, own in columns.items() for f, values in own.items()}
    everything = {c: list(own) for c, own in columns.items()}
    every = inclusion.hashes(cat, everything)
    got = {((r["collection"], r["field"]), (r["target"], r["target_field"])): (r["hits"], r["values"]) for r in inclusion.matches(every, every).collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a])) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    asked = [(*a, *b) for a in sets for b in sets if a != b]
    found = {(r["collection"], r["field"], r["target"], r["target_field"]): r["ratio"] for r in inclusion.contained(cat, asked, None).collect()}
    assert found == {p: len(sets[p[:2]] & sets[p[2:]]) / len(sets[p[:2]]) for p in asked}


def test_samples_are_values_of_the_column_and_name_collections(spark):
    cat = documents(spark, users=("_id string, name string", [(f"users/{i}", f"n{i}") for i in range(500)]), links=("who string, none string, odd string", [(f"users/{i % 300}", None, "ghosts/1" if i % 2 else "users/7") for i in range(900)]))
    sample = inclusion.sampled(cat, {"links": ["who", "none", "odd"]}, 50)
    rows = sample.collect()
    assert {r["field"] for r in rows} == {"who", "odd"} and 25 < sum(r["field"] == "who" for r in rows) <= 50
    assert {r["prefix"] for r in rows if r["field"] == "who"} == {"users"} and {r["prefix"] for r in rows if r["field"] == "odd"} <= {"users", None}
    ratios = {r["field"]: r["ratio"] for r in inclusion.contained(cat, [("links", "who", "users", "_id"), ("links", "none", "users", "_id"), ("links", "who", "users", "name")], sample).where("target_field = '_id'").collect()}
    assert ratios == {"who": 1.0}


def test_one_scan_of_a_collection_for_all_its_columns(spark, sf_dir):
    cat = star.relational(spark, sf_dir)
    asked = [(c, f, t, "_key") for c in ("items", "purchases") for f in ("purchase_id", "part_key", "supplier_id") if f in cat.collections[c].df.columns for t in ("parts", "purchases", "suppliers")]
    children = inclusion.hashes(cat, {"items": ["purchase_id", "part_key", "supplier_id"]})
    parents = inclusion.hashes(cat, {t: ["_key"] for t in ("parts", "purchases", "suppliers")})
    assert plan(children).count("FileScan parquet") == 1 and plan(parents).count("FileScan parquet") == 3
    assert len(asked) == 9 and inclusion.contained(cat, asked, None).count() == 9


def test_keys_of_many_collections_are_all_tried(spark):
    tables = {f"z{i:02d}": ("_key string", [(str(k),) for k in range(i + 1)]) for i in range(12)}
    found = {(r["child"], r["parent"]) for r in foreign_keys.key_containments(documents(spark, **tables), sampled=None).collect()}
    assert found == {(f"z{i:02d}", f"z{j:02d}") for i in range(12) for j in range(12) if i < j}


def test_rules_of_equal_key_names_and_of_three_candidates(spark):
    fields = [("orders", "sku", "string", False), ("goods", "sku", "string", True)]
    fields += [(n, "_key", "string", True) for n in ("account", "accounts", "ACCOUNT", "Account", "orders", "goods")] + [("orders", "account_id", "integer", False)]
    table = spark.createDataFrame(fields, "collection string, field string, category string, is_unique boolean")
    none = spark.createDataFrame([], "collection string, field string, target string, ratio double")
    by_name = foreign_keys.single_candidates(table, none).where("method = 'name_suffix'").collect()
    assert [r["target"] for r in by_name] == ["ACCOUNT", "Account", "account"]  # three of four, by name
    same = foreign_keys.single_candidates(table.where("field <> '_key'"), none, key="sku").where("method = 'key_name_match'").collect()
    assert {(r["collection"], r["target"], r["confidence"]) for r in same} == {("orders", "goods", 0.65), ("goods", "orders", 0.7)}


# -- joins and traversals ---------------------------------------------------------------------------------------


def test_numbers_meet_text_keys(spark):
    a = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id int, ref int")
    b = spark.createDataFrame([("7", "seven"), ("x9", "nine"), (None, "none")], "_key string, name string")
    for direction, want in (("outbound", [(1, "seven")]), ("inbound", [(1, "seven")])):
        out = relational.foreign_key(a, ["ref"], b, ["_key"], direction)
        ids = ("s_id", "t_name") if direction == "outbound" else ("t_id", "s_name")
        assert [tuple(r) for r in out.select(*ids).collect()] == want and "isnotnull" in plan(out)
    nulls = relational.foreign_key(a, ["ref"], b.withColumnRenamed("_key", "code"), ["code"]).select("s_id", "t_name").collect()
    assert sorted(map(tuple, nulls)) == [(1, "seven"), (2, "none")]  # a plain field: null matches null
    with pytest.raises(ValueError):
        relational.foreign_key(a, ["ref", "id"], b, ["_key"])


def test_relationships_with_several_ends(spark):
    def unread():
        raise AssertionError("no edge reaches this collection")

    pair = "_key string, _id string, w int"
    c = Catalog(spark, [
        Collection("crates", frame(spark, [("1", "crates/1", 5), ("2", "crates/2", 6)], pair)), Collection("drums", frame(spark, [("1", "drums/1", 7)], pair)), Collection("vats", unread),
        Collection("depots", frame(spark, [("1", "depots/1", "N"), ("2", "depots/2", "S")], "_key string, _id string, kind string")),
        Collection("stored", frame(spark, [("crates/1", "depots/1"), ("drums/1", "depots/2"), ("crates/2", "depots/9"), ("crates/2", "drums/1")], "_from string, _to string"), "edge"),
    ])
    entities = {n.title()[:-1]: {"style": "COLLECTION", "collection": n} for n in ("crates", "drums", "vats")}
    entities |= {k: {"style": "LABEL", "collection": "depots", "type_field": "kind", "type_value": v} for k, v in (("North", "N"), ("South", "S"))}
    m = PhysicalMapping(c, entities, {"IN": {"style": "DEDICATED_COLLECTION", "collection": "stored", "from_entity": "Any", "to_entity": "Any", "from_entities": ["Crate", "Drum", "Vat"], "to_entities": ["North", "South", "Drum", "Vat"]}})
    ends = relational.End
    parts = lambda names: [ends(n, entities[n]["collection"], c.collections[entities[n]["collection"]].df, *((entities[n]["type_field"], entities[n]["type_value"]) if "type_field" in entities[n] else ())) for n in names]
    out = relational.traverse_any(parts(["Crate", "Drum"]), c.collections["stored"].df, parts(["North", "South", "Drum"]))
    want = [("Crate", "crates/1", "North", "depots/1"), ("Crate", "crates/2", "Drum", "drums/1"), ("Crate", "crates/2", None, None), ("Drum", "drums/1", "South", "depots/2")]
    shown = lambda df: sorted((tuple(r) for r in df.select("s_entity", "s__id", "t_entity", "t__id").collect()), key=str)
    assert shown(out) == sorted(want, key=str)
    back = relational.traverse_any(parts(["North", "South"]), c.collections["stored"].df, parts(["Crate", "Drum"]), "inbound")
    assert shown(back) == [("North", "depots/1", "Crate", "crates/1"), ("South", "depots/2", "Drum", "drums/1")]
    m.entities.pop("Vat")
    m.relationships["IN"] |= {"from_entities": ["Crate", "Drum"], "to_entities": ["North", "South", "Drum"]}
    assert shown(m.traverse("IN")) == sorted(want, key=str)
    assert shown(m.traverse("IN", source=c.collections["crates"].df.where("w = 5"))) == [want[0]]
    with pytest.raises(ValueError):
        m.traverse("IN", "sideways")
    reached = relational.reached(c.collections["stored"].df, "_to")
    assert reached == {"depots", "drums"}


def test_an_analysis_traverses_what_it_found(spark):
    pair = "_key string, _id string"
    c = Catalog(spark, [
        Collection("crates", frame(spark, [("1", "crates/1")], pair), indexes=[{"type": "persistent", "fields": ["_key", "size"], "unique": True}]), Collection("drums", frame(spark, [("1", "drums/1")], pair)), Collection("depots", frame(spark, [("1", "depots/1")], pair)),
        Collection("stored", frame(spark, [("crates/1", "depots/1"), ("drums/1", "depots/1")], "_from string, _to string"), "edge"),
    ], properties={"time": "2024-05-05"})
    a = analysis.analyze(c)
    r = a.mapping["relationships"]["STORED"]
    assert (r["from_entity"], r["from_entities"], r["to_entity"]) == ("Any", ["Crate", "Drum"], "Depot")
    assert {tuple(x) for x in a.physical(c).traverse("STORED").select("s_entity", "t_entity").collect()} == {("Crate", "Depot"), ("Drum", "Depot")}
    assert a.mapping["entities"]["Crate"]["indexes"][0]["fields"] == ["_key", "size"] and a.mapping["entities"]["Crate"]["properties"]["_key"]["indexed"]
    assert a.extra["provenance"]["Crate"] == {"first_seen": "2024-05-05", "last_validated": "2024-05-05"}
    c.properties["time"] = "2024-06-06"
    again = analysis.analyze(c, prior=a)
    assert again.extra["provenance"]["Crate"] == {"first_seen": "2024-05-05", "last_validated": "2024-06-06"}


# -- counts and sketches ----------------------------------------------------------------------------------------


def test_bounded_counts(spark):
    rnd = random.Random(2)
    rows = [(f"u{i}", f"w{int(rnd.paretovariate(0.9))}", "ab"[i % 2], None) for i in range(30_000)]
    df = spark.createDataFrame(rows, "`unique.id` string, skewed string, label string, empty string").repartition(5)
    seen = {r["field"]: r for r in profile.frequent(df, df.columns, tracked=1000, told=500).collect()}
    assert seen["unique.id"]["items"] == [] and seen["empty"]["rows"] == 0 and len(seen["label"]["items"]) == 2
    got = {(r["field"], r["value"]): r["count"] for r in profile.bounded_counts(df, df.columns, cap=100, tracked=1000).collect()}
    full = Counter(("skewed", r[1]) for r in rows) + Counter(("label", r[2]) for r in rows)
    least = profile.certain_share(1000) * len(rows)
    assert got == {k: n for k, n in full.items() if k[0] == "label" or n > least} and 5 < len(got) < 200
    assert profile.bounded_counts(df.limit(0), df.columns, cap=5).count() == 0 and profile.bounded_counts(df, []).count() == 0


def test_snapshot_values_of_wide_fields(spark):
    """Most values of a name stand in one row each: the first ranks are few rows, the others ties by value."""
    names = [f"n{i}" for i in range(12_000)] + ["n77"] * 2 + [f"n{i}" for i in range(500, 530)] + [None] * 5
    rows = [(n, "ab"[i % 2]) for i, n in enumerate(names)]
    got = {(r["collection"], r["field"], r["value"]): (r["count"], r["rank"]) for r in snapshot.value_table(documents(spark, people=("name string, kind string", rows))).collect()}
    want = {}
    for k, field in enumerate(("name", "kind")):
        best = sorted(Counter(r[k] for r in rows if r[k] is not None).items(), key=lambda x: (-x[1], x[0]))[:70]
        want |= {("people", field, v): (n, rank) for rank, (v, n) in enumerate(best, 1)}
    assert got == want and len(got) == 72


def test_hubs_stay_where_they_are(spark):
    rows = [(f"a/{i}", "b/0" if i % 10 else f"b/{i}", "R") for i in range(5000)]
    edges = spark.createDataFrame(rows, "_from string, _to string, r string")
    vertices = spark.createDataFrame([(f"a/{i}", "A") for i in range(0, 5000, 2)] + [("b/0", "B"), ("b/10", "C")], "_id string, kind string")
    often = profile.hubs(edges, "_from", "_to")
    assert often == {"_from": [], "_to": ["b/0"]}
    kinds = dict(map(tuple, vertices.collect()))
    want = Counter((r, kinds.get(f), kinds.get(t)) for f, t, r in rows)
    got = {tuple(r)[:3]: r["edges"] for r in profile.endpoint_types(edges, vertices, "r", "kind").collect()}
    assert got == dict(want)
    v = vertices.select(F.col("_id").alias("id"), F.col("kind").alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        typed = profile.with_end(edges, "_to", v, "to_type", often["_to"])
        sizes = [n for n in typed.where("_to <> 'b/0'").rdd.glom().map(len).collect() if n]
        assert typed.count() == len(rows) and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
        assert plan(typed).count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_and_running_sums(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 50), f"k{i % 7}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "`a.b` int, k string, v long").repartition(6)
    got = numbering.numbered(df, ["a.b", "k"]).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: r["n"])] == list(range(400))
    ordered = [(r[0], r[1]) for r in sorted(got, key=lambda r: r["n"])]
    assert ordered == sorted((a, k) for a, k, _ in rows)
    by = df.groupBy(F.col("`a.b`").alias("x")).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    for down in (False, True):
        total, want = 0, {}
        for x in sorted({r[0] for r in rows}, reverse=down):
            total += sum(r[2] for r in rows if r[0] == x)
            want[x] = total
        assert {r["x"]: r["s"] for r in numbering.running_sums(by, "x", ["s", "n"], down).collect()} == want
    assert numbering.numbered(df.limit(0), ["k"]).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4), ("é", 5)], "`v.w` string, n int")
    tokens = inference.redaction_tokens(df, "v.w")
    assert {r["value"]: r["token"] for r in tokens.collect()} == {"a": "<redacted>:0", "b": "<redacted>:1", "é": "<redacted>:2"}
    hidden = inference.masked(df, ["v.w"], tokens.where("value <> 'a'"))
    assert {r["n"]: r["v.w"] for r in hidden.collect()} == {1: "<redacted>:1", 2: None, 3: None, 4: "<redacted>:1", 5: "<redacted>:2"}
    assert sorted(map(tuple, inference.unmasked(inference.masked(df, ["v.w"], tokens), ["v.w"], tokens).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    key = b"secret"
    keyed = {r["n"]: r["v.w"] for r in inference.redacted(df, ["v.w"], key).collect()}
    assert keyed[1] == keyed[4] == "<redacted>:" + hmac.new(key, b"b", hashlib.sha256).hexdigest() and keyed[3] is None
    assert keyed[5] == "<redacted>:" + hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        inference.redacted(df, ["n"], b"")


def test_referential_health(spark):
    vertices = spark.createDataFrame([(f"a/{i}",) for i in range(5)] + [(f"b/{i}",) for i in range(3)] + [("c/1",)], "_id string")
    edges = spark.createDataFrame([("a/0", "b/0")] * 4 + [("a/1", "b/9"), ("x/1", "b/1"), (None, "b/1"), ("a/0", "a/2")], "_from string, _to string")
    got = {r["collection"]: tuple(r)[1:] for r in health.referential_health(edges, vertices).collect()}
    assert got == {"a": (5, 3, 2, 0, 0), "b": (3, 2, 1, 0, 1), "c": (1, 0, 1, 0, 0), "x": (0, 0, 0, 1, 0)}
    assert health.catalog_health(Catalog(spark, [])).count() == 0


def test_profiles_of_files_are_merged(spark, tmp_path):
    table, store = f"file://{tmp_path}/t", f"file://{tmp_path}/profile"
    rows = lambda lo, hi: spark.createDataFrame([(i, "ab"[i % 2], None if i % 5 else f"x{i % 20}") for i in range(lo, hi)], "id long, label string, `odd.name` string")
    rows(0, 100).repartition(2).write.parquet(table)
    p = partials.FileProfiles(spark, table, store, ["id", "label", "odd.name"], ["label", "odd.name"])
    first = p.update()
    assert len(first) == 2 and p.update() == [] and p.new_files() == []
    rows(100, 160).coalesce(1).write.mode("append").parquet(table)
    added = p.new_files()
    assert len(added) == 1 and p.update() == added and not set(added) & set(first)
    whole = rows(0, 160)
    assert {tuple(r) for r in p.values().collect()} == {tuple(r) for r in profile.value_counts(whole, ["label", "odd.name"]).collect()}
    assert {r["field"]: tuple(r)[1:] for r in p.stats().collect()} == {"id": (160, 160, 160), "label": (160, 160, 2), "odd.name": (160, 32, 4)}


# -- shapes, taxonomy, tenancy ----------------------------------------------------------------------------------


def test_shapes_of_odd_documents(spark):
    docs = ['{"a": 1, "b.c": {"d": null, "e`f": [1, {"x": 2}]}}', '{"a": 2.5, "b.c": 7}', '{"a": "t"}', "[1, 2]", "no json", None, "{}", '{"deep": {"deep": {"deep": {"deep": {"deep": 1}}}}}']
    df = spark.createDataFrame([(x,) for x in docs], "`doc.umented` string")
    got = {r["path"]: tuple(r)[1:] for r in shapes.shapes(df, "doc.umented").collect()}
    assert got == {
        "a": (3, 0, "float:1,integer:1,string:1", "unknown"), "`b.c`": (2, 0, "integer:1,object:1", "unknown"), "`b.c`.d": (0, 1, "", "unknown"), "`b.c`.`e``f`": (1, 0, "array:1", "array"),
        "deep": (1, 0, "object:1", "object"), "deep.deep": (1, 0, "object:1", "object"), "deep.deep.deep": (1, 0, "object:1", "object"), "deep.deep.deep.deep": (1, 0, "object:1", "object"),
    }
    assert {tuple(r) for r in shapes.sampled(df, "doc.umented").collect()} == {("a", "1"), ("a", "2.5"), ("a", "t"), ("`b.c`", "7")}
    many = spark.createDataFrame([(json.dumps({"k": i % 200}),) for i in range(1000)], "doc string")
    assert shapes.sampled(many, "doc").count() == 50 and shapes.shapes(many.limit(0), "doc").count() == 0


def test_concepts_are_the_closed_sets(spark):
    rnd = random.Random(4)
    for _ in range(3):
        rows = {(f"E{rnd.randint(0, 6)}", f"p{rnd.randint(0, 7)}") for _ in range(26)}
        names = sorted({e for e, _ in rows})
        has = {e: {p for x, p in rows if x == e} for e in names}
        want = {}
        for k in range(2, len(names) + 1):
            for group in combinations(names, k):
                shared = set.intersection(*(has[e] for e in group))
                if shared and all(not shared <= has[e] for e in names if e not in group):
                    want[group] = tuple(sorted(shared))
        got = taxonomy.concepts(spark.createDataFrame(sorted(rows), "entity string, property string")).collect()
        assert {tuple(r["extent"]): tuple(r["intent"]) for r in got} == want and len(got) == len(want)
        for r in got:
            for p in r["partial"]:
                assert list(p["present_on"]) == [e for e in r["extent"] if p["property"] in has[e]] != list(r["extent"])
    assert taxonomy.concepts(spark.createDataFrame([], "entity string, property string")).count() == 0


def test_abstract_parents_join_the_model(spark):
    shared, own = "_key string, _id string, owner string, balance double", [("1", "x/1", "o", 1.0)]
    c = documents(spark, mortgageAccounts=(shared + ", rate double, years int", [(*own[0], 2.0, 9)]), savingAccounts=(shared + ", rate double", [(*own[0], 2.0)]), cashAccounts=(shared, own), people=("_key string, _id string, age int", [("1", "people/1", 3)]))
    a = analysis.analyze(c, foreign=False, abstract=True)
    classes = {x["name"]: x for x in a.extra["taxonomy"]["abstractClasses"]}
    top = classes["Account"]
    assert top["members"] == ["CashAccount", "MortgageAccount", "SavingAccount"] and top["sharedProperties"] == ["balance", "owner"]
    assert top["partialProperties"] == [{"name": "rate", "presentOn": ["MortgageAccount", "SavingAccount"]}, {"name": "years", "presentOn": ["MortgageAccount"]}] and classes["Account2"]["parent"] == "Account"
    model = {e["name"]: e for e in a.conceptual["entities"]}
    assert model["Account"]["abstract"] and model["CashAccount"]["parent"] == "Account" and model["SavingAccount"]["parent"] == "Account2" and "parent" not in model["Person" if "Person" in model else "People"]


def test_tenancy_rules(spark):
    no = spark.createDataFrame([("Sharded",)], "style string")
    fields = spark.createDataFrame([("a", "x"), ("b", "y")], "collection string, field string")
    verdict = lambda rows: inference.tenancy_verdict(spark.createDataFrame(rows, "collection string, shard_keys array<string>"), fields, no).first()["style"]
    assert verdict([("a", ["tenantId"]), ("b", ["_key"])]) == "none"  # one collection alone doesn't decide
    assert verdict([("a", ["tenantId"]), ("b", ["orgId"])]) == "none"
    assert verdict([("a", ["x", "tenantId"]), ("b", ["y", "tenantId"])]) == "none"  # nor does a key that isn't the first
    assert verdict([("a", ["_key", "my_workspace"]), ("b", ["my_workspace"])]) == "shard_key"
    entities = spark.createDataFrame([("Org", ["tenant_id"]), ("Team", [])], "entity string, properties array<string>")
    links = spark.createDataFrame([("Org", "Team")], "from_entity string, to_entity string")
    assert inference.tenant_scope(entities, links).count() == 0  # without a root there are no scopes
    assert {r["entity"]: r["scope"] for r in inference.tenant_scope(entities, links, roots=("Tenant", "Org")).collect()} == {"Org": "root", "Team": "reachable"}
    assert inference.tenant_coverage(Catalog(spark, [])).count() == 0


# -- odd catalogs -----------------------------------------------------------------------------------------------


def test_empty_catalog(spark):
    c = Catalog(spark, [])
    a = analysis.analyze(c)
    assert a.conceptual == {"entities": [], "relationships": []} and a.extra["sharding"]["reasons"] == ["no user collections"] and a.extra["sharding"]["status"] == "degraded"
    snap = snapshot.snapshot(c)
    assert snap["collections"] == [] and snapshot.fingerprint(snap) == snapshot.fingerprint(snapshot.snapshot(c))
    for op in service.OPERATIONS:
        assert service.run({"operation": op, "full": True, "target": "turtle"}, spark, c)["ok"]
    assert service.run({"operation": "counts", "path": "/nowhere"}, spark)["error"]["code"]
    assert analysis.analyze_incremental(c, a)[0] == "unchanged" and foreign_keys.infer(c)[0].count() == 0


def test_names_with_dots(spark):
    pair = "_key string, _id string, "
    c = Catalog(spark, [
        Collection("people", frame(spark, [(str(i), f"people/{i}", "AB"[i % 2], f"n{i}", None) for i in range(20)], pair + "`kind.of` string, `full``name` string, `none.at.all` string")),
        Collection("teams", frame(spark, [(str(i), f"teams/{i}", i % 3, "LAB") for i in range(6)], pair + "`people.id` int, kind string")),
        Collection("in", frame(spark, [(f"people/{i}", f"teams/{i % 6}", "IN") for i in range(20)], "_from string, _to string, `relation` string"), "edge"),
    ])
    df = c.collections["people"].df
    assert {r["field"]: r["present"] for r in profile.observed_fields(df).collect()} == {"kind.of": 20, "full`name": 20}
    assert {(r["type"], r["field"]) for r in profile.observed_fields_by_type(df, "kind.of").collect()} == {("A", "full`name"), ("B", "full`name")}
    assert profile.value_counts(df, ["kind.of", "none.at.all"]).count() == 2 and profile.field_coverage(df, ["full`name"]).first()["distinct"] == 20
    a = analysis.analyze(c)
    assert {e["name"]: e["properties"] for e in a.conceptual["entities"]}["People"] == ["full`name", "kind.of"]
    snap = snapshot.snapshot(c, samples=1)
    assert [x["name"] for x in snap["collections"]] == ["in", "people", "teams"]
    assert a.physical(c).resolve()["People"]["kind"] == "entity"


def test_label_floor_and_aliases(spark):
    rows = [(str(i), f"things/{i}", f"type_{i % 40}") for i in range(400)]
    c = documents(spark, things=("_key string, _id string, type string", rows))
    usual, full = analysis.analyze(c, foreign=False), analysis.analyze(c, foreign=False, label_floor=5)
    assert list(usual.mapping["entities"]) == ["Thing"] and len(full.mapping["entities"]) == 40
    assert full.mapping["entities"]["Type7"]["aliases"] == ["type_7"]
    assert snapshot.type_fields(c) == {} and snapshot.type_fields(c, label_floor=5) == {"things": "type"}
    snap = snapshot.snapshot(c, label_floor=5)["collections"][0]
    assert snap["type_field"] == "type" and len(snap["fields_by_type"]) == 0 and snap["count"] == 400


def test_domain_of_the_names(spark):
    c = documents(spark, crates=("_key string, _id string, depot string", [("1", "crates/1", "x")]))
    words = spark.createDataFrame([("freight", w) for w in ("crates", "depot", "truck")] + [("film", "actor")], "domain string, keyword string")
    assert analysis.analyze(c, foreign=False, domains=words).extra["domain"]["domain"] == "freight"


def test_exports_tell_parents_and_places(spark):
    shared, own = "_key string, _id string, owner string, balance double", [("1", "x/1", "o", 1.0)]
    c = documents(spark, mortgage_accounts=(shared + ", rate double", [(*own[0], 2.0)]), cash_accounts=(shared, own), people=("_key string, _id string, full_name string", [("1", "people/1", "p")]))
    a = analysis.analyze(c, foreign=False)
    text = exports.turtle(a)
    assert ":CashAccount rdfs:subClassOf :Account ." in text and ":Account a owl:Class" in text and ':CashAccount phys:collection "cash_accounts" .' in text
    by_id = {n["rdfs:label"]: n for n in exports.json_ld(a)["@graph"] if "rdfs:label" in n}
    assert by_id["MortgageAccount"]["rdfs:subClassOf"]["@id"].endswith("Account")
    doc = exports.interchange(a)
    named = exports.conformed(spark, doc, {"People": "Person"})
    model = {e["name"]: e["properties"] for e in named["conceptualModel"]["entities"]}
    assert model["Person"] == ["fullName"] and named["physicalMapping"]["entities"]["Person"]["properties"]["fullName"]["field"] == "full_name"
    assert exports.conformed(spark, named) == named and exports.issues(spark, named) == [] and "full_name" in str(doc)


def test_redacted_snapshots(spark):
    c = documents(spark, people=("_key string, _id string, kind string, secret_name string", [(str(i), f"people/{i}", "AB"[i % 2], f"n{i}") for i in range(10)]))
    snap = snapshot.snapshot(c, samples=2)
    for names in (False, True):
        out, tokens = snapshot.redacted(snap, names)
        text = json.dumps(out)
        assert '"n3"' not in text and "samples" not in text and ("secret_name" in text) != names and "<redacted>:0" in text
        plain = json.loads(json.dumps(snap, default=str))
        for x in plain["collections"]:
            x.pop("samples", None)
        assert snapshot.restored(out, tokens) == plain
