"""Mutations, transactions, streams and what surrounds them, over small tables."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.entity import Entity
from sievewright.functions import rows as R
from sievewright.functions.compare import differs
from sievewright.model import FieldDef, LinkDef, ModelDef, Registry, RelationDef, UnknownField
from sievewright.operators.mutate import Mutations
from sievewright.operators.query import EntityQuery
from sievewright.plans import graph
from sievewright.plans.search import all_of, any_of, conditions_from, parse
from sievewright.runtime import errors, metrics
from sievewright.runtime.control import EngineConfig, concurrency_for, in_parallel
from sievewright.sources.tables import read_table, read_tables, read_text, write_snapshot, write_text
from sievewright.streaming.upserts import latest, upsert_stream

INT, TEXT, REAL, WHEN = T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampType()
STAMPS = (FieldDef("createdAt", WHEN), FieldDef("updatedAt", WHEN))
USER = ModelDef("User", (FieldDef("id", INT, is_id=True), FieldDef("name", TEXT), FieldDef("bossId", INT)), (RelationDef("boss", "User", ("bossId",), ("id",), cascade=True), RelationDef("posts", "Post", ("id",), ("authorId",), True)))
POST = ModelDef("Post", (FieldDef("id", INT, is_id=True), FieldDef("title", TEXT), FieldDef("authorId", INT)), (RelationDef("author", "User", ("authorId",), ("id",), cascade=True), RelationDef("comments", "Comment", ("id",), ("postId",), True)))
COMMENT = ModelDef("Comment", (FieldDef("id", INT, is_id=True), FieldDef("text", TEXT), FieldDef("postId", INT), FieldDef("authorId", INT)), (RelationDef("post", "Post", ("postId",), ("id",), cascade=True), RelationDef("author", "User", ("authorId",), ("id",), cascade=True)))
AREA = ModelDef("Area", (FieldDef("id", INT, is_id=True), FieldDef("name", TEXT, unique=True)))
SUBJECT = ModelDef("Subject", (FieldDef("id", INT, is_id=True), FieldDef("name", TEXT, unique=True), FieldDef("level", INT), *STAMPS), links=(LinkDef("areas", "Area", "AreaSubject", "subjectId", "areaId"),))
AREA_SUBJECT = ModelDef("AreaSubject", (FieldDef("subjectId", INT), FieldDef("areaId", INT), *STAMPS), primary_key=("areaId", "subjectId"))


def frame(spark, model, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.type) for f in model.fields]))


@pytest.fixture
def blog(spark):
    r = Registry()
    r.add(USER, frame(spark, USER, [(1, "Ana", None), (2, "Beto", 1), (3, "Carla", None), (4, "Dora", 2)]))
    r.add(POST, frame(spark, POST, [(1, "a", 1), (2, "b", 3), (3, "c", 4)]))
    return r.add(COMMENT, frame(spark, COMMENT, [(1, "x", 1, 3), (2, "y", 2, 1), (3, "z", 2, 3), (4, "w", None, None), (5, "v", 3, 3)]))


@pytest.fixture
def school(spark):
    r = Registry()
    r.add(AREA, frame(spark, AREA, [(1, "Maths"), (2, "Nature"), (3, "Arts")]))
    r.add(SUBJECT, frame(spark, SUBJECT, [(10, "Biology", 1, None, None)]))
    return r.add(AREA_SUBJECT, frame(spark, AREA_SUBJECT, [(10, 1, None, None)]))


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


def test_cascade_takes_every_path_and_cycles(blog):
    m = Mutations(blog, "User")
    left = m.delete_cascading(m.delete_by_ids([3]))
    assert ids(left["User"]) == [1, 2, 4] and ids(left["Post"]) == [1, 3]
    assert ids(left["Comment"]) == [4]  # 1, 3 and 5 by their author, 2 by its post
    left = m.delete_cascading(m.delete_by_ids([1]))  # 2 reports to 1, and 4 to 2
    assert ids(left["User"]) == [3] and ids(left["Post"]) == [2] and ids(left["Comment"]) == [3, 4]
    m.apply_cascading(m.delete_by_filter({"name": "Carla"}))
    assert ids(blog.df("Comment")) == [4] and blog.metrics.operations[-1].name == "cascade"


def pairs(registry):
    return sorted((r["subjectId"], r["areaId"]) for r in registry.df("AreaSubject").collect())


def test_links_of_created_and_updated_rows(school):
    m = Mutations(school, "Subject")
    m.apply(m.create_many([{"id": 11, "name": "Algebra", "areas": [{"id": 1}, {"id": 2}]}, {"id": 12, "name": "Physics", "areas": {"connect": [{"id": 2}]}}, {"id": 13, "name": "Alone", "areas": []}, {"id": 14, "name": "Biology", "areas": [3]}]))
    assert pairs(school) == [(10, 1), (11, 1), (11, 2), (12, 2)]
    stamps = {(r["subjectId"], r["areaId"]): r["createdAt"] for r in school.df("AreaSubject").collect()}
    assert stamps[10, 1] is None and stamps[11, 1] is not None
    done = m.apply(m.upsert_many([{"name": "Biology", "level": 2, "areas": [1, 3]}, {"name": "Algebra", "areas": [3]}, {"id": 15, "name": "Music", "areas": [3, 3]}]))
    assert done.counts() == {"created": 1, "updated": 1, "unchanged": 1, "total": 3}
    assert pairs(school) == [(10, 1), (10, 3), (11, 1), (11, 2), (12, 2), (15, 3)]  # Algebra didn't change
    m.apply(m.create_many([{"id": 16, "name": "Dance", "areas": [3]}], links=False))
    assert (16, 3) not in pairs(school)
    table = school.df("Area").sparkSession.createDataFrame([(17, "Chemistry", [2, None])], "id int, name string, areas array<int>")
    m.apply(m.upsert_many(table))
    assert (17, 2) in pairs(school) and len(pairs(school)) == 7


def test_foreign_keys_by_relation_and_template(blog):
    m = Mutations(blog, "Post")
    rows = {r["id"]: r["authorId"] for r in m.create_many([{"id": 7, "author": {"id": 2}}, {"id": 8, "author": {"connect": {"id": 3}}, "authorId": 4}]).snapshot.collect()}
    assert rows[7] == 2 and rows[8] == 4
    own = replace(POST, name="Item", fields=(*POST.fields, FieldDef("fk_writer", INT)), relations=())
    blog.add(own, frame(blog.df("Post").sparkSession, own, []))
    rows = Mutations(blog, "Item", foreign_key=lambda r: f"fk_{r}").create_many([{"id": 1, "writer": {"id": 5}}]).snapshot.collect()
    assert rows[0]["fk_writer"] == 5


def test_related_rows_are_created_along(blog, school):
    m = Mutations(blog, "Post")
    m.apply(m.create_many([{"id": 20, "author": {"create": {"id": 9, "name": "New"}}}, {"id": 21, "author": {"id": 3, "name": "There already"}}]))
    assert {r["id"]: r["authorId"] for r in blog.df("Post").where("id >= 20").collect()} == {20: 9, 21: 3}
    assert {r["id"]: r["name"] for r in blog.df("User").where("id in (3, 9)").collect()} == {3: "Carla", 9: "New"}
    s = Mutations(school, "Subject")
    s.apply(s.upsert_many([{"id": 30, "name": "Law", "areas": {"connect": [1], "create": [{"id": 7, "name": "Rules"}]}}, {"id": 31, "name": "Ethics", "areas": [{"id": 8, "name": "Duties"}, 2]}]))
    assert [p for p in pairs(school) if p[0] >= 30] == [(30, 1), (30, 7), (31, 2), (31, 8)] and ids(school.df("Area")) == [1, 2, 3, 7, 8]


def test_upsert_is_one_join_and_one_scan(spark, tmp_path):
    folder = str(tmp_path / "t")
    frame(spark, AREA, [(i, str(i)) for i in range(50)]).write.parquet(folder)
    r = Registry().add(AREA, spark.read.parquet(folder))
    change = Mutations(r, "Area").upsert_many(frame(spark, AREA, [(1, "1"), (99, "x")]), ["id"])
    for df in (change.snapshot, change.rows):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and plan.count("Join ") == 1


def test_paged_include_reads_related_rows_by_key(spark, tmp_path, blog):
    for name in ("User", "Post"):
        blog.df(name).write.parquet(str(tmp_path / name))
        blog.bind(name, spark.read.parquet(str(tmp_path / name)))
    found = EntityQuery(blog, "User").find(order_by={"id": "asc"}, take=2, include=["posts"], columns={"posts": ["title"]})
    assert [(r["id"], [tuple(p) for p in r["posts"]]) for r in found.collect()] == [(1, [("a",)]), (2, [])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan[plan.index("collect_list") :]
    assert "Join LeftSemi" in aggregate and "broadcast" in aggregate
    with pytest.raises(UnknownField):
        EntityQuery(blog, "User").find(include=["posts"], columns={"posts": ["nope"]})
    deep = {r["id"]: r for r in EntityQuery(blog, "User").find(include=[{"posts": ["comments"]}, "boss"]).collect()}
    assert [c["id"] for c in deep[3]["posts"][0]["comments"]] == [2, 3] and deep[2]["boss"]["name"] == "Ana" and deep[1]["boss"] is None


def test_upsert_seeds(spark):
    product = ModelDef("Product", (FieldDef("id", INT, is_id=True), FieldDef("name", TEXT), FieldDef("sku", TEXT, unique=True), FieldDef("price", REAL), FieldDef("discount", REAL), FieldDef("tags", T.ArrayType(TEXT)), FieldDef("size", T.StructType([T.StructField("w", REAL), T.StructField("unit", TEXT)])), *STAMPS))
    rows = [(1, "Keep", "K", 10.0, 7.0, ["a"], (1.0, "cm"), None, None), (2, "Change", "C", 20.0, 8.0, None, None, None, None)]
    r = Registry().add(product, frame(spark, product, rows))
    m = Mutations(r, "Product")
    change = m.upsert_many([{"sku": "K", "price": 10.0}, {"sku": "C", "price": 99.0, "discount": None}, {"id": 3, "sku": "N", "price": 30.0}])
    assert change.counts() == {"created": 1, "updated": 1, "unchanged": 1, "total": 3}
    got = {x["sku"]: x for x in m.apply(change).snapshot.collect()}
    assert got["K"]["discount"] == 7.0 and got["C"]["discount"] is None and got["C"]["name"] == "Change"
    assert got["K"]["updatedAt"] is None and got["C"]["updatedAt"] is not None and got["N"]["createdAt"] is not None
    assert got["C"]["updatedAt"] == {x["sku"]: x for x in r.df("Product").collect()}["C"]["updatedAt"]  # times stand still
    for sku, count in (("updated", ["C"]), ("created", ["N"]), ("unchanged", ["K"])):
        assert [got[c]["id"] for c in count] == ids(change.ids(sku))
    assert m.upsert_many([{"sku": "K", "price": 20.0}, {"sku": "K", "price": 30.0}]).counts() == {"created": 0, "updated": 1, "unchanged": 1, "total": 2}
    assert m.upsert_many([{"sku": "K", "price": 10.0}] * 2).counts() == {"created": 0, "updated": 0, "unchanged": 2, "total": 2}
    noisy = [{"sku": "K", "name": " Keep ", "price": 10 + 1e-15, "tags": [" a"], "size": {"w": 1.0, "unit": "cm "}}]
    assert m.upsert_many(noisy).counts()["updated"] == 1
    assert Mutations(r, "Product", "normalized").upsert_many(noisy).counts()["unchanged"] == 1
    assert Mutations(r, "Product", "normalized").upsert_many([{"sku": "K", "tags": ["a", "b"]}]).counts()["updated"] == 1
    later = spark.createDataFrame([("K", 1.0, 2), ("K", 2.0, 1)], "sku string, price double, at int")
    with pytest.raises(UnknownField):
        m.upsert_many(later)
    kept = m.upsert_many(later.withColumnRenamed("at", "_ord")).snapshot.where("sku = 'K'").first()
    assert kept["price"] == 1.0


def test_differs_inside_arrays_and_structs(spark):
    kind = T.ArrayType(T.StructType([T.StructField("x", REAL), T.StructField("s", TEXT)]))
    rows = [([(1.0, " a ")], [(1.0 + 2e-16, "a")], False), ([(1.0, "a")], [(1.1, "a")], True), (None, [], True), (None, None, False), ([], [(1.0, "a")], True), ([(None, "")], [(None, None)], False), ([None], [None], False), ([None], [(1.0, "a")], True)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("want", T.BooleanType())]))
    assert df.where(differs(F.col("a"), F.col("b"), kind, "normalized") != F.col("want")).count() == 0


def test_single_rows(blog):
    m = Mutations(blog, "Post")
    with pytest.raises(ValueError):
        m.create({})
    with pytest.raises(ValueError):
        m.update({"title": "no id"})
    m.apply(m.create({"id": 9, "title": "new", "authorId": 1}))
    m.apply(m.update({"id": 9, "title": "newer"}))
    m.apply(m.upsert({"id": 9, "authorId": 2}))
    m.apply(m.upsert({"id": 10, "title": "made"}))
    assert sorted((r["id"], r["title"], r["authorId"]) for r in blog.df("Post").where("id > 8").collect()) == [(9, "newer", 2), (10, "made", None)]
    m.apply(m.delete(9))
    assert 9 not in ids(blog.df("Post"))
    large = Mutations(Registry(blog.models, blog.snapshots, EngineConfig(list_limit=1)), "Post")
    for x in (m, large):
        assert ids(x.delete_by_ids([1, None, 10, 77]).snapshot) == [2, 3] and ids(x.delete_by_ids([(2,)]).rows) == [2]
        assert x.delete_by_ids([]).snapshot.count() == 4
    query = EntityQuery(blog, "Post")
    assert query.probe({"id": 10})["title"] == "made" and query.probe({"id": 99}) is None and query.probe({"id": None}) is None
    assert query.only_one({"title": "made"})["id"] == 10 and query.only_one({"title": "zz"}) is None
    assert ids(query.by_keys(blog.df("Post").where("id < 3").select("id"), ["id"])) == [1, 2]


def test_entity(school):
    s = Entity(school, "Subject", {"_id": 20, "name": "Latin", "areas": [{"id": 3}]})
    s.level = 4
    assert s.to_object() == {"id": 20, "name": "Latin", "areas": [{"id": 3}], "level": 4} and s.createdAt is None
    s.create()
    assert s.createdAt is not None and (20, 3) in pairs(school)
    s.level = 5
    assert s.update().level == 5
    t = Entity(school, "Subject", {"name": "Latin", "level": 6}).upsert()
    assert (t.id, t.level) == (20, 6)
    assert Entity(school, "Subject", {"name": " Latin"}).level is None
    made = json.loads(Entity(school, "Subject", {"id": 1, "createdAt": dt.datetime(2026, 1, 2, 3, 4, 5, 6000)}).to_json())
    assert made == {"id": 1, "createdAt": "2026-01-02T03:04:05.006Z"}
    assert t.delete() == 20 and 20 not in ids(school.df("Subject"))
    with pytest.raises(UnknownField):
        t.nope = 1
    with pytest.raises(AttributeError):
        t.nope  # noqa: B018
    with pytest.raises(ValueError):
        Entity(school, "Subject", {"name": "x"}).delete()


def test_enum_defaults_and_required(spark):
    task = ModelDef("Task", (FieldDef("id", INT, is_id=True), FieldDef("status", TEXT, kind="enum", required=True, has_default=True, default="PENDING", values=("PENDING", "ACTIVE")), FieldDef("rank", TEXT, kind="enum", values=("LOW", "HIGH")), FieldDef("title", TEXT, required=True)))
    r = Registry().add(task, frame(spark, task, [(1, "ACTIVE", None, "t")]))
    m = Mutations(r, "Task")
    rows = {x["id"]: x for x in m.create_many([{"id": 2, "title": "u"}, {"id": 3, "title": "v", "status": "ACTIVE", "rank": "LOW"}]).snapshot.collect()}
    assert rows[2]["status"] == "PENDING" and rows[3]["rank"] == "LOW"
    with pytest.raises(Exception, match="no value NOPE"):
        m.create_many([{"id": 4, "title": "w", "rank": "NOPE"}]).snapshot.collect()
    with pytest.raises(Exception, match="title is required"):
        m.upsert_many([{"id": 5}]).snapshot.collect()
    assert m.upsert_many([{"id": 1, "rank": "HIGH"}]).snapshot.first()["title"] == "t"  # an existing row needs no more


def test_hooks_run_in_order_and_after_the_work(spark):
    seen = []
    config = EngineConfig(before=(lambda n, x: seen.append("global before"),), after=(lambda n, c: seen.append(("global after", c.counts()["created"])),))
    r = Registry(config=config).add(AREA, frame(spark, AREA, []))
    m = Mutations(r, "Area", before=[lambda n, x: seen.append("before")], after=[lambda n, c: seen.append(("after", r.df("Area").count()))])
    change = m.upsert_many([{"id": 1, "name": "x"}])
    assert seen == ["global before", "before"]
    m.apply(change)
    assert seen[2:] == [("global after", 1), ("after", 1)]


def test_settings_reach_the_engine(spark, blog):
    def found(registry, tree):
        return ids(EntityQuery(registry, "User").find(search=tree))

    exact = Registry(blog.models, blog.snapshots, EngineConfig(insensitive_search=False, list_limit=1, compare="normalized"))
    tree = {"field": "name", "like": "ANA"}
    assert found(blog, tree) == [1] and found(exact, tree) == [] and found(exact, {**tree, "insensitive": True}) == [1]
    plan = EntityQuery(exact, "User").find(search={"field": "id", "in": [1, 2]})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan
    assert Mutations(exact, "User").compare == "normalized" and Mutations(exact, "User", "strict").compare == "strict"
    for bad in ({"concurrency": 0}, {"concurrency": True}, {"max_queries_per_second": -1}, {"max_queries_per_second": float("inf")}, {"retries": -1}, {"parallel": 1}, {"compare": "loose"}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_snapshots_as_parquet(spark, blog, tmp_path):
    r = Registry(blog.models, blog.snapshots, EngineConfig(snapshot_folder=str(tmp_path / "snapshots")))
    m = Mutations(r, "User")
    m.apply(m.upsert_many([{"id": 1, "name": "Anna"}, {"id": 8, "name": "New"}]))
    m.apply_cascading(m.delete_by_ids([3]))
    assert {x["id"]: x["name"] for x in r.df("User").collect()}[1] == "Anna" and ids(r.df("Comment")) == [4]
    plan = r.df("Comment")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Join" not in plan and len(list((tmp_path / "snapshots").iterdir())) == 4


def test_transaction_publishes_together(blog):
    m, p = Mutations(blog, "User"), Mutations(blog, "Post")
    before = dict(blog.snapshots)
    with pytest.raises(ZeroDivisionError), blog.transaction():
        m.apply(m.delete_by_ids([1]))
        assert ids(blog.df("User")) == [2, 3, 4]
        1 / 0  # noqa: B018
    assert blog.snapshots == before
    with blog.transaction():
        m.apply_cascading(m.delete_by_ids([3]))
        p.apply(p.create({"id": 50, "authorId": 1}))
        assert blog.snapshots == before and 50 in ids(blog.df("Post"))
    assert ids(blog.df("Post")) == [1, 3, 50] and ids(blog.df("User")) == [1, 2, 4]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, folder, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = T.StructType([T.StructField(f.name, f.type) for f in AREA.fields])

    def run(*rows):
        if rows:
            frame(spark, AREA, rows).coalesce(1).write.mode("append").parquet(source)
        registry = Registry().add(AREA, frame(spark, AREA, [(1, "base")]))  # a restarted driver knows the base table only
        query = upsert_stream(spark.readStream.schema(schema).parquet(source), registry, "Area", folder, check, ["id"])
        query.awaitTermination()
        return sorted(map(tuple, registry.df("Area").collect()))

    assert run((2, "b"), (1, "changed")) == [(1, "changed"), (2, "b")]
    assert run((3, "c")) == [(1, "changed"), (2, "b"), (3, "c")]
    assert run() == [(1, "changed"), (2, "b"), (3, "c")]
    assert latest(spark, folder)[0] == 1
    write_text(spark, f"{folder}/x", "one")
    write_text(spark, f"{folder}/x", "two")
    assert read_text(spark, f"{folder}/x") == "two" and read_text(spark, f"{folder}/none") is None


def test_database_tables(spark):
    options = {"url": "jdbc:derby:memory:tables;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    frame(spark, AREA, [(1, "Maths"), (2, "Arts")]).write.format("jdbc").options(**options, dbtable="AREA").save()
    df = read_table(spark, "AREA", "jdbc", **options)
    r = Registry().add(AREA, df.toDF("id", "name"))
    assert ids(EntityQuery(r, "Area").find(search={"field": "id", "gte": 2})) == [2]


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, kind):
    path = f"{tmp_path}/t.{kind}"
    spark.range(3).selectExpr("id", "concat('n', id) name").write.format(kind).options(header="true").save(path)
    options = {"header": "true"} if kind == "csv" else {}
    assert sorted(map(tuple, read_table(spark, path, kind, "id long, name string", **options).collect())) == [(0, "n0"), (1, "n1"), (2, "n2")]
    if kind == "parquet":
        assert read_tables(spark, str(tmp_path), ["t"])["t"].count() == 3
        one, two = (write_snapshot(spark.range(2).withColumn("p", F.col("id")), str(tmp_path / "s"), ["p"]) for _ in range(2))
        assert one != two and spark.read.parquet(one).count() == 2
    with pytest.raises(ValueError):
        read_table(spark, path, "xml")


def test_graph_helpers(blog, school):
    assert graph.parent_filter(blog, "Comment", "User", "id", 3) == {"author.id": 3}
    assert graph.parent_filter(blog, "User", "Area", "id", 3) == {"areaId": 3}
    assert graph.path_to(blog, "User", "User") == "boss"
    assert graph.relation_type(SUBJECT, "areas") == "explicit" and graph.relation_type(USER, "posts") == "one-to-many" and graph.relation_type(POST, "author") == "to-one"
    assert graph.join_table(school, SUBJECT, "areas") == {"table": "AreaSubject", "source_key": "subjectId", "target_key": "areaId", "extras": ["createdAt", "updatedAt"]}
    loop = Registry().add(replace(POST, relations=(RelationDef("c", "Comment", ("id",), ("id",)),))).add(COMMENT)
    with pytest.raises(ValueError, match="depend"):
        graph.sorted_by_dependency(loop, ["Post", "Comment"])
    with pytest.raises(KeyError):
        graph.relation_type(POST, "nope")
    deep = graph.include_tree(blog, USER, [{"posts": [{"comments": [{"author": [{"posts": ["comments"]}]}]}]}])
    assert deep == {"posts": {"comments": {"author": {"posts": {}}}}}
    assert ModelDef("J", (FieldDef("j", TEXT, "json"), FieldDef("l", T.ArrayType(INT)))).json_fields() == ["j"]
    assert ModelDef("J", (FieldDef("j", TEXT, "json"), FieldDef("l", T.ArrayType(INT)))).scalar_list_fields() == ["l"]


def test_search_helpers_and_node_order(blog):
    assert any_of(["a"], {"like": "x"}) == {"field": "a", "like": "x"} and parse(any_of([], {"like": "x"})) is None
    assert all_of(["a", "b"], {"equals": 1}) == {"and": [{"field": "a", "equals": 1}, {"field": "b", "equals": 1}]}
    assert conditions_from({"a": "x", "b": " ", "c": 3}, "like") == [{"field": "a", "like": "x"}]
    both = parse({"field": "name", "equals": "Ana", "and": [{"field": "id", "equals": 9}]})
    assert both.field == "name"  # a condition with a field comes before everything else
    assert parse({"field": "x", "isNull": False}) is None and parse({"not": [1]}) is None and parse({"and": {"field": "x", "equals": 1}}) is None


def test_strict_nested_skips_the_whole_object(blog):
    base = {"author": {"name": "Ana", "bossId": ""}}
    strict = Registry(blog.models, blog.snapshots, EngineConfig(strict_nested=True))
    assert ids(EntityQuery(blog, "Post").find(base)) == [1] and ids(EntityQuery(strict, "Post").find(base)) == [1, 2, 3]


def test_embedded_and_json_seeds(spark):
    spec = T.StructType([T.StructField("key", TEXT), T.StructField("value", TEXT)])
    subject = T.StructType([T.StructField("shortname", TEXT)])
    product = ModelDef("P", (FieldDef("sku", TEXT, is_id=True), FieldDef("dims", T.StructType([T.StructField("width", INT), T.StructField("label", TEXT)]), "embedded"), FieldDef("specs", T.ArrayType(spec), "embedded"), FieldDef("program", T.StructType([T.StructField("code", TEXT), T.StructField("subjects", T.ArrayType(subject))]), "embedded"), FieldDef("meta", TEXT, "json")))
    rows = [
        ("1", (10, "small"), [("cpu", "x86"), ("ram", "8GB")], ("A", [("m",), ("n",)]), '{"color":"red","d":{"w":10},"brand":"Acme","tags":["sale","new"],"n":[1,2]}'),
        ("2", (20, "large"), [("cpu", "arm"), ("ram", "16GB")], ("B", []), '{"color":"blue","d":{"w":20},"brand":"ACME","tags":["new"],"n":["1"]}'),
        ("3", (30, None), [("cpu", "x86")], None, '{"color":"red","d":{"w":30},"brand":"Other","tags":["sale","clearance"],"n":null}'),
        ("4", None, None, None, "not json"),
    ]
    r = Registry().add(product, frame(spark, product, rows))

    def found(tree, base=None):
        return ids(EntityQuery(r, "P").find(base, tree), "sku")

    assert found({"field": "dims.width", "gte": 20}) == ["2", "3"] and found({"field": "dims.label", "like": "LAR"}) == ["2"] and found({"field": "dims.label", "isNull": True}) == ["3", "4"]
    some = {"field": "specs.value", "equals": "x86"}
    assert found(some) == ["1", "3"] and found({**some, "relation": "every"}) == ["3", "4"] and found({**some, "relation": "none"}) == ["2", "4"]
    assert found({"field": "program.subjects.shortname", "equals": "m"}) == ["1"] and found({"field": "program.code", "equals": "B"}) == ["2"]
    assert found(None, {"dims": {"label": "small"}, "specs": {"key": "cpu", "value": "x86"}}) == ["1"]
    assert found(None, {"specs": {"key": "ram", "value": "x86"}}) == []  # one element must have both
    assert found({"field": "meta.color", "equals": "red"}) == ["1", "3"] and found({"field": "meta.d.w", "gte": 20}) == ["2", "3"]
    assert found({"field": "meta.brand", "like": "acme"}) == ["1", "2"] and found({"field": "meta.brand", "startsWith": "AC"}) == ["1", "2"] and found({"field": "meta.brand", "endsWith": "ER", "insensitive": True}) == ["3"]
    assert found({"field": "meta.tags.0", "equals": "sale"}) == ["1", "3"] and found({"field": "meta.tags", "hasEvery": ["sale"]}) == ["1", "3"]
    assert found({"field": "meta.n", "hasEvery": [1]}) == ["1"] and found({"field": "meta.n", "hasEvery": ["1"]}) == ["2"]
    assert found([{"field": "meta.color", "equals": "red"}, {"field": "meta.tags", "hasEvery": ["clearance"]}]) == ["3"]
    assert found({"field": "meta.color", "in": ["red"]}) == ["1", "2", "3", "4"]  # not an operator of JSON: left out
    assert found({"field": "meta", "equals": "not json"}) == ["4"] and found({"field": "meta.n", "equals": None}) == ["3"]


def test_dates_and_scalar_lists(spark):
    job = ModelDef("Job", (FieldDef("id", TEXT, is_id=True), FieldDef("at", WHEN), FieldDef("tags", T.ArrayType(TEXT))))
    day = lambda m: dt.datetime(2026, m, 15)
    r = Registry().add(job, frame(spark, job, [("A", day(1), ["new", "offer"]), ("B", day(2), ["new"]), ("C", day(3), ["used", None]), ("D", None, [])]))

    def found(tree, base=None):
        return ids(EntityQuery(r, "Job").find(base, tree))

    assert found({"field": "at", "between": [dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 28)]}) == ["A", "B"]
    assert found({"field": "at", "between": [day(1), day(3)]}) == ["A", "B", "C"]
    assert found({"field": "at", "between": [day(1), day(2)], "orNull": True}) == ["A", "B", "D"]
    assert found({"field": "at", "isNull": True}) == ["D"] and found({"field": "at", "gte": "2026-02-15"}) == ["B", "C"]
    assert found({"field": "tags", "hasSome": ["new", "used"]}) == ["A", "B", "C"] and found({"field": "tags", "hasEvery": ["new", "offer"]}) == ["A"] and found({"field": "tags", "hasSome": []}) == ["A", "B", "C", "D"]
    assert found(None, {"tags": ["new"]}) == ["A", "B"]


def test_row_utilities():
    assert R.build("a.b", 1) == {"a": {"b": 1}} and R.assign({"a": 3}, "a.c", 2) == {"a": {"c": 2}}
    assert R.get({"a": [{"b": 5}]}, "a.0.b") == 5 and R.get({}, "x.y", "d") == "d"
    assert R.clean({"a": None, "b": {"c": None}, "d": [{"e": None}]}) == {"d": [{}]}
    assert R.update_payload({"createdAt": 1, "a": None, "b": {}, "c": {"connect": {}}, "d": 2}) == {"a": None, "d": 2}
    assert R.is_plain_object({}) and not R.is_plain_object([]) and R.is_empty("") and not R.is_empty(0) and R.is_non_empty_list([0])
    assert R.unique_by_id([{"id": 1, "a": 1}, {"id": 1, "a": 2}, {"a": 3}, {"a": 4}]) == [{"id": 1, "a": 1}, {"a": 3}, {"a": 4}]


def test_errors_metrics_and_parallel_calls():
    assert errors.is_unique_violation(ValueError("User: unique key exists: email")) and not errors.is_unique_violation(ValueError("no"))

    def fail(text):
        def call():
            raise ValueError(text)

        return call

    assert errors.without_duplicates(fail("Duplicate entry 3"), lambda: 7, "create") == 7
    for call, again in ((fail("other"), lambda: 7), (fail("duplicate key"), fail("still"))):
        with pytest.raises(ValueError):
            errors.without_duplicates(call, again, "create")
    assert errors.guarded(fail("x"), "read", lambda: 1) == 1
    with pytest.raises(ValueError):
        errors.guarded(fail("x"), "read")
    clock = iter([0.0, 2.0]).__next__
    m = metrics.Metrics(clock=clock)
    with m.timed("create", "User") as found:
        found["rows"] = 10
    assert m.total("create").rows_per_second == 5.0 and m.total("none").rows == 0
    report = metrics.ParallelReport(2.0, 6.0, 4, 8)
    assert (report.speedup, report.efficiency, report.utilisation, report.calls_per_second) == (3.0, 0.75, 0.75, 4.0)
    seen = []
    assert in_parallel(lambda x: x + 1, [1, 2], 2, seen.append) == ([2, 3], []) and seen[0].calls == 2
    assert metrics.batch_megabytes(2048) == 2.0 and metrics.batch_fits(1000) and not metrics.batch_fits(200_000)
    assert metrics.placeholders([{"a": 1}, {"a": 1, "b": 2}]) == 3 and metrics.alternatives_fit([{"a": 1}] * 8, 10) and not metrics.alternatives_fit([{"a": 1}] * 9, 10)
    assert [concurrency_for(n) for n in (1, 100, 1000, 10_000)] == [1, 2, 4, 8] and Decimal("1.5") == Decimal("1.50")
