"""The registered queries over the driver's tables: models, trees, mutations, and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LinkDef, ModelDef, Registry, RelationDef
from ..operators.mutate import Mutations
from ..operators.query import EntityQuery
from ..sources.tables import read_table
from .search import all_of, any_of, conditions_from

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",),
}
RELATIONS = {
    "nation": (RelationDef("region", "region", ("n_regionkey",), ("r_regionkey",)),),
    "customer": (RelationDef("nation", "nation", ("c_nationkey",), ("n_nationkey",)), RelationDef("orders", "orders", ("c_custkey",), ("o_custkey",), True)),
    "supplier": (RelationDef("nation", "nation", ("s_nationkey",), ("n_nationkey",)),),
    "orders": (RelationDef("customer", "customer", ("o_custkey",), ("c_custkey",), cascade=True), RelationDef("lineitems", "lineitem", ("o_orderkey",), ("l_orderkey",), True)),
    "lineitem": (RelationDef("order", "orders", ("l_orderkey",), ("o_orderkey",), cascade=True), RelationDef("part", "part", ("l_partkey",), ("p_partkey",)), RelationDef("supplier", "supplier", ("l_suppkey",), ("s_suppkey",)), RelationDef("part_doc", "part_doc", ("l_partkey",), ("p_partkey",)), RelationDef("order_n", "orders_n", ("l_orderkey",), ("o_orderkey",))),
}


def bind_model(registry: Registry, name: str, df: DataFrame, **how: object) -> Registry:
    return registry.add(ModelDef.of_schema(name, df.schema, **how), df)


class Tables(Registry):
    """The models over a folder's tables, each bound when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def model(self, name: str) -> ModelDef:
        if name not in self.models:
            self._load(name)
        return super().model(name)

    def _table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    def _load(self, name: str) -> None:
        if name in KEYS:
            required = {"customer": ("c_acctbal",), "lineitem": ("l_quantity",)}.get(name, ())
            bind_model(self, name, self._table(name), key=KEYS[name], json=("props",) if name == "events" else (), required=required, relations=RELATIONS.get(name, ()))
        elif name == "orders_n":  # with nulls, which the tables have not
            orders = self._table("orders").select("o_orderkey", "o_orderstatus", F.nullif("o_orderstatus", F.lit("P")).alias("status_n"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price_n"))
            bind_model(self, name, orders, key=("o_orderkey",))
        elif name == "tagged_part":
            bind_model(self, name, self._table("part").withColumn("tags", F.split("p_name", " ")), key=("p_partkey",))
        elif name == "conversation":
            turns = self._table("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
            bind_model(self, name, turns, key=("conv_id",))
        elif name == "course":  # an embedded list inside an embedded document
            turns = self._table("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
            bind_model(self, name, turns.select("conv_id", F.struct(F.size("turns").alias("length"), "turns").alias("program")), key=("conv_id",))
        elif name == "part_doc":  # JSON with text, numbers, an object and an array
            attrs = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("width")).alias("dimensions"), F.split("p_name", " ").alias("tags"), F.array("p_size", F.lit(1)).alias("sizes")))
            bind_model(self, name, self._table("part").select("p_partkey", attrs.alias("attrs")), key=("p_partkey",), json=("attrs",))


def registry_of(spark: SparkSession, sf_dir: str) -> Registry:
    return Tables(spark, sf_dir)


_FIND: dict[str, tuple[str, dict | None, object, tuple[str, ...]]] = {
    "base_equals": ("customer", {"c_mktsegment": "BUILDING"}, None, ("*",)),
    "base_null": ("orders_n", {"price_n": None}, None, ()),
    "base_nested_is": ("orders", {"customer": {"c_mktsegment": "BUILDING", "nation": {"n_regionkey": 1}}}, None, ()),
    "like_ci": ("part", None, {"field": "p_name", "like": "WIDGET"}, ()),
    "like_cs": ("part", None, {"field": "p_name", "like": "widget", "insensitive": False}, ()),
    "starts_with_ci": ("part", None, {"field": "p_name", "startsWith": "RED"}, ()),
    "ends_with_ci": ("part", None, {"field": "p_name", "endsWith": "Bolt"}, ()),
    "equals_ci": ("customer", None, {"field": "c_mktsegment", "equals": "building", "insensitive": True}, ()),
    "in_list": ("events", None, {"field": "event_type", "in": ["click", "purchase"]}, ()),
    "not_in_nullable": ("orders_n", None, {"field": "status_n", "notIn": ["F"]}, ()),
    "between_incl": ("customer", None, {"field": "c_acctbal", "between": [0, 1000]}, ()),
    "gte_date": ("orders", None, {"field": "o_orderdate", "gte": dt.datetime(1997, 1, 1)}, ()),
    "not_range_nullable": ("orders_n", None, {"not": {"field": "price_n", "gte": 100000}}, ()),
    "not_equals_nullable": ("orders_n", None, {"not": {"field": "status_n", "equals": "F"}}, ()),
    "or_null": ("orders_n", None, {"field": "price_n", "lte": 50000, "orNull": True}, ()),
    "bool_nest": ("customer", None, {"or": [{"and": [{"field": "c_mktsegment", "equals": "BUILDING"}, {"field": "c_acctbal", "gte": 5000}]}, {"and": [{"field": "c_mktsegment", "equals": "MACHINERY"}, {"field": "c_acctbal", "lte": 0}]}]}, ()),
    "not_subtree": ("customer", None, {"not": {"or": [{"field": "c_mktsegment", "equals": "BUILDING"}, {"field": "c_acctbal", "lte": 0}]}}, ()),
    "prune_blank": ("customer", None, [{"field": "c_name", "like": ""}, {"field": "c_mktsegment", "in": []}, {"field": "c_acctbal", "gte": 5000}], ()),
    "path_to_one": ("orders", None, {"field": "customer.nation.region.r_name", "equals": "ASIA"}, ()),
    "rel_some": ("orders", None, {"field": "lineitems.l_quantity", "gte": 45}, ()),
    "rel_every": ("orders", None, {"field": "lineitems.l_quantity", "gte": 10, "relation": "every"}, ()),
    "rel_none": ("orders", None, {"field": "lineitems.l_returnflag", "equals": "R", "relation": "none"}, ()),
    "rel_in_or": ("orders", None, {"or": [{"field": "lineitems.l_quantity", "gte": 50}, {"field": "o_orderstatus", "equals": "P"}]}, ()),
    "rel_two_hop_every": ("customer", None, {"field": "orders.lineitems.l_quantity", "lte": 49, "relation": "every"}, ()),
    "rel_independent": ("orders", None, [{"field": "lineitems.l_quantity", "gte": 45}, {"field": "lineitems.l_returnflag", "equals": "R"}], ()),
    "rel_same_row": ("orders", {"lineitems": {"l_linenumber": 1, "l_returnflag": "R"}}, None, ()),
    "json_equals": ("events", None, {"field": "props.k", "equals": 87}, ()),
    "json_range": ("events", None, {"field": "props.k", "between": [10, 20]}, ()),
    "has_some": ("tagged_part", None, {"field": "tags", "hasSome": ["red", "blue"]}, ()),
    "has_every": ("tagged_part", None, {"field": "tags", "hasEvery": ["red", "widget"]}, ()),
    "embedded_every": ("conversation", None, {"field": "turns.role", "in": ["user", "assistant"], "relation": "every"}, ()),
    "big_in_list": ("orders", None, {"field": "o_orderkey", "in": list(range(12_000))}, ()),
    "is_null": ("orders_n", None, {"field": "price_n", "isNull": True}, ()),
    "equals_null_in_tree": ("orders_n", None, {"or": [{"field": "status_n", "equals": None}, {"field": "price_n", "gte": 400_000}]}, ()),
    "embedded_some": ("conversation", None, {"field": "turns.role", "equals": "system"}, ()),
    "embedded_none": ("conversation", None, {"field": "turns.role", "equals": "system", "relation": "none"}, ()),
    "embedded_single": ("course", None, {"field": "program.length", "gte": 4}, ()),
    "embedded_nested": ("course", None, {"field": "program.turns.role", "equals": "system"}, ()),
    "json_like": ("part_doc", None, {"field": "attrs.brand", "like": "#1"}, ()),
    "json_starts_with": ("part_doc", None, {"field": "attrs.brand", "startsWith": "BRAND"}, ()),
    "json_ends_with": ("part_doc", None, {"field": "attrs.brand", "endsWith": "2"}, ()),
    "json_index": ("part_doc", None, {"field": "attrs.tags.0", "equals": "red"}, ()),
    "json_has_every": ("part_doc", None, {"field": "attrs.tags", "hasEvery": ["red", "widget"]}, ()),
    "json_has_every_typed": ("part_doc", None, [{"field": "attrs.sizes", "hasEvery": [1, 7]}, {"not": {"field": "attrs.sizes", "hasEvery": ["1"]}}], ()),
    "json_nested_range": ("part_doc", None, [{"field": "attrs.dimensions.width", "gte": 10}, {"field": "attrs.dimensions.width", "lte": 20}], ()),
    "json_through_relation": ("lineitem", None, {"field": "part_doc.attrs.dimensions.width", "equals": 7}, ("l_orderkey", "l_linenumber")),
    "json_bare": ("events", None, {"field": "props", "like": "87"}, ()),
    "base_dotted": ("orders", {"customer.c_mktsegment": "BUILDING"}, None, ()),
    "base_array": ("tagged_part", {"tags": ["red", "widget"]}, None, ()),
    "base_and_search": ("orders", {"o_orderstatus": "F", "o_orderpriority": "", "customer": {}}, [{"field": "o_totalprice", "gte": 100_000}, {"field": "lineitems.l_quantity", "gte": 45}], ()),
    "or_null_through_relation": ("lineitem", None, {"field": "order_n.price_n", "lte": 50_000, "orNull": True}, ("l_orderkey", "l_linenumber")),
    "any_of": ("customer", None, any_of(["c_name", "c_mktsegment"], {"like": "9"}), ()),
    "all_of": ("part", None, all_of(["p_name", "p_type"], {"like": "e"}), ()),
    "conditions_from": ("customer", None, conditions_from({"c_mktsegment": "BUILDING", "c_name": "  ", "c_acctbal": 3}), ()),
    "parse_total": ("customer", None, [None, 7, {"and": "x"}, {"or": []}, {"field": "c_name", "like": "", "gte": 5}, {"not": {"field": "c_acctbal", "in": []}}, {"field": "c_acctbal", "lte": 0}], ()),
}


def _finder(model: str, base: dict | None, search: object, columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = EntityQuery(registry_of(spark, sf_dir), model)
        return query.find(base, search).select(*(columns or query.model.id_fields))

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the well-off customers of a market segment that have a large order."""
    tree = [{"or": [{"field": "c_name", "like": "build"}, {"field": "c_mktsegment", "like": "build"}]}, {"field": "c_acctbal", "gte": 1000}, {"field": "orders.o_totalprice", "gte": 100_000}]
    return EntityQuery(registry_of(spark, sf_dir), "customer").find(search=tree, order_by=[{"c_acctbal": "desc"}, {"c_custkey": "asc"}], page=1, page_size=20)


def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EntityQuery(registry_of(spark, sf_dir), "orders").find(order_by=[{"o_totalprice": "desc"}, {"o_orderkey": "asc"}], take=20, skip=40).select("o_orderkey", "o_totalprice")


def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EntityQuery(registry_of(spark, sf_dir), "customer").count_df(search={"field": "c_acctbal", "gte": 5000})


def include_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EntityQuery(registry_of(spark, sf_dir), "orders").find(include=["customer"]).select("o_orderkey", F.col("customer.c_name").alias("c_name"))


def include_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EntityQuery(registry_of(spark, sf_dir), "orders").find(include=["lineitems"]).select("o_orderkey", F.size("lineitems").cast("long").alias("n_items"))


def _changed_orders(registry: Registry) -> DataFrame:
    """All orders as incoming rows: a fifth each changed, and under a new key, the rest as they are."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return registry.df("orders").select(F.when(k % 5 == 2, k + 10_000_000).otherwise(k).alias("o_orderkey"), F.when(k % 5 == 1, p + 1).otherwise(p).alias("o_totalprice"))


def upsert_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = registry_of(spark, sf_dir)
    return Mutations(registry, "orders").upsert_many(_changed_orders(registry)).rows.groupBy("status").agg(F.count("*").alias("n"))


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = registry_of(spark, sf_dir)
    return Mutations(registry, "orders").upsert_many(_changed_orders(registry)).snapshot.select("o_orderkey", "o_totalprice", "o_orderstatus")


def upsert_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with blanks around them and balances with rounding noise are no changes; other segments are."""
    registry = registry_of(spark, sf_dir)
    rows = registry.df("customer").select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("c_name"), (F.col("c_acctbal") * 3 / 3).alias("c_acctbal"), F.when(F.col("c_custkey") % 3 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return Mutations(registry, "customer", "normalized").upsert_many(rows).rows.groupBy("status").agg(F.count("*").alias("n"))


def upsert_omitted_and_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row brings nulls; those of odd keys provide them and are set to null, those of even keys omit them and keep their value."""
    registry = registry_of(spark, sf_dir)
    given = F.when(F.col("c_custkey") % 2 == 1, F.array(F.lit("c_custkey"), F.lit("c_mktsegment"))).otherwise(F.array(F.lit("c_custkey")))
    rows = registry.df("customer").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), given.alias("_present"), F.col("c_custkey").alias("_ord"))
    return Mutations(registry, "customer").upsert_many(rows).snapshot.select("c_custkey", "c_name", "c_mktsegment")


def _parts_with_suppliers(spark: SparkSession, sf_dir: str) -> tuple[Registry, DataFrame]:
    """Parts linked to suppliers by a table that holds the links of flag R already; and rows of parts with all suppliers of their items."""
    registry = registry_of(spark, sf_dir)
    items = registry.df("lineitem")
    bind_model(registry, "part_supplier", items.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct(), key=("l_partkey", "l_suppkey"))
    registry.add(replace(registry.model("part"), links=(LinkDef("suppliers", "supplier", "part_supplier", "l_partkey", "l_suppkey"),)))
    sold = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_suppkey").alias("suppliers"))
    return registry, registry.df("part").select("p_partkey", "p_size", "p_name").join(sold, "p_partkey")


def create_many_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link rows after parts were copied to new keys together with their suppliers; those of keys that exist aren't made."""
    registry, rows = _parts_with_suppliers(spark, sf_dir)
    moved = rows.withColumn("p_partkey", F.when(F.col("p_size") > 10, F.col("p_partkey") + 10_000_000).otherwise(F.col("p_partkey")))
    m = Mutations(registry, "part")
    return m.apply_links("suppliers", m.create_many(moved).links("suppliers")).select("l_partkey", "l_suppkey")


def upsert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link rows after an upsert of all parts, of which those of size over 10 change: the others' links aren't added."""
    registry, rows = _parts_with_suppliers(spark, sf_dir)
    changed = rows.withColumn("p_size", F.when(F.col("p_size") > 10, F.col("p_size") + 1).otherwise(F.col("p_size")))
    m = Mutations(registry, "part")
    return m.apply_links("suppliers", m.upsert_many(changed).links("suppliers")).select("l_partkey", "l_suppkey")


def create_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers made of customers: those whose key exists are skipped."""
    registry = registry_of(spark, sf_dir)
    rows = registry.df("customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return Mutations(registry, "supplier").create_many(rows).snapshot.select("s_suppkey", "s_name")


def update_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = Mutations(registry_of(spark, sf_dir), "customer").update_by_filter(None, {"c_mktsegment": "DEBT"}, {"field": "c_acctbal", "lte": 0})
    return change.snapshot.select("c_custkey", "c_mktsegment")


def update_many_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's size and one more goes to the part of twice its key; keys beyond the last are unknown and do nothing."""
    registry = registry_of(spark, sf_dir)
    rows = registry.df("part").select((F.col("p_partkey") * 2).alias("p_partkey"), (F.col("p_size") + 1).alias("p_size"))
    return Mutations(registry, "part").update_many_by_id(rows).snapshot.select("p_partkey", "p_size")


def delete_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mutations(registry_of(spark, sf_dir), "orders_n").delete_by_filter(search={"field": "status_n", "equals": "F"}).snapshot.select("o_orderkey")


def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mutations(registry_of(spark, sf_dir), "supplier").delete_by_ids(range(10)).snapshot.select("s_suppkey")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by table that are left after customers in debt are deleted with their orders and these orders' items."""
    registry = registry_of(spark, sf_dir)
    for name in ("customer", "orders", "lineitem"):
        registry.model(name)
    m = Mutations(registry, "customer")
    left = m.delete_cascading(m.delete_by_filter(search={"field": "c_acctbal", "lte": 0}))
    counts = [left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("model"), "n") for n in ("customer", "orders", "lineitem")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


def delete_by_id_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without those that a returned item names."""
    registry = registry_of(spark, sf_dir)
    gone = registry.df("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Mutations(registry, "orders").delete_by_ids(gone).snapshot.select("o_orderkey")


def create_many_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order comes in again, half of them under new keys: those are created, the others skipped."""
    registry = registry_of(spark, sf_dir)
    rows = registry.df("orders").withColumn("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 10_000_000).otherwise(F.col("o_orderkey")))
    return Mutations(registry, "orders").create_many(rows).snapshot.select("o_orderkey", "o_totalprice")


def delete_cascade_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, a, b) of every row left after two nations are deleted: their customers, these customers' orders and those orders'
    items go, and their suppliers with all items that these supply. Items hang on nations by two paths."""
    registry = registry_of(spark, sf_dir)
    for name in ("nation", "customer", "supplier", "orders", "lineitem"):
        model = registry.model(name)
        registry.add(replace(model, relations=tuple(replace(r, cascade=r.name in ("nation", "customer", "order", "supplier")) for r in model.relations)))
    m = Mutations(registry, "nation")
    left = m.delete_cascading(m.delete_by_filter(search={"field": "n_nationkey", "in": [3, 7]}))
    keys = {"nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey"), "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_linenumber")}
    parts = [left[n].select(F.lit(n).alias("model"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")) for n, (a, b) in keys.items()]
    return reduce(DataFrame.unionAll, parts)


def include_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of a page of orders, with contents and in their order."""
    page = EntityQuery(registry_of(spark, sf_dir), "orders").find(order_by={"o_totalprice": "desc"}, take=50, skip=10, include=["lineitems"], columns={"lineitems": ["l_linenumber", "l_partkey", "l_quantity"]})
    return page.select("o_orderkey", F.posexplode("lineitems").alias("at", "x")).select("o_orderkey", "at", "x.l_linenumber", "x.l_partkey", "x.l_quantity")


def include_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a page of customers, each order with its number of items and its own customer's name: three levels."""
    page = EntityQuery(registry_of(spark, sf_dir), "customer").find(search={"field": "c_mktsegment", "equals": "BUILDING"}, order_by={"c_acctbal": "desc"}, take=30, include=[{"orders": ["lineitems", "customer"]}, "nation"])
    rows = page.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.posexplode("orders").alias("at", "x"))
    return rows.select("c_custkey", "n_name", "at", "x.o_orderkey", F.size("x.lineitems").cast("long").alias("n_items"), F.col("x.customer.c_name").alias("c_name"))


def by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = registry_of(spark, sf_dir)
    keys = registry.df("lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return EntityQuery(registry, "orders").by_keys(keys, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer of a key, as a point probe finds it."""
    query = EntityQuery(registry_of(spark, sf_dir), "customer")
    found = query.probe({"c_custkey": 42, "c_name": None})
    return spark.createDataFrame([found] if found else [], query.registry.df("customer").schema)


def null_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls come first in ascending order: a page that begins among them."""
    return EntityQuery(registry_of(spark, sf_dir), "orders_n").find(order_by=[{"price_n": "asc"}], take=2000, skip=10).select("o_orderkey", "price_n")


def big_in_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"field": "o_orderkey", "in": list(range(12_000))}
    return EntityQuery(registry_of(spark, sf_dir), "orders").find(search=tree, order_by={"o_totalprice": "desc"}, page=3, page_size=25).select("o_orderkey", "o_totalprice")


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = registry_of(spark, sf_dir)
    m = Mutations(registry, "events")
    rows = registry.df("events").withColumn("_ord", F.col("event_id"))
    return m.last_wins(m.incoming(rows), ["user_id"]).select("user_id", "event_id")


def link_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = registry_of(spark, sf_dir)
    empty = spark.createDataFrame([], "l_partkey long, l_suppkey long")
    bind_model(registry, "part_supplier", empty, key=("l_partkey", "l_suppkey"))
    registry.add(replace(registry.model("part"), links=(LinkDef("suppliers", "supplier", "part_supplier", "l_partkey", "l_suppkey"),)))
    return Mutations(registry, "part").apply_links("suppliers", registry.df("lineitem").select("l_partkey", "l_suppkey"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    **{k: _finder(*v) for k, v in _FIND.items()},
    **{f.__name__: f for f in (order_page, page_total, include_to_one, include_to_many, upsert_classify, upsert_snapshot, create_many, update_by_filter, update_many_by_id, delete_by_filter, delete_by_ids, delete_cascade, upsert_last_wins, link_apply, upsert_normalized, upsert_omitted_and_null, create_many_links, upsert_links, delete_by_id_table, create_many_orders, delete_cascade_diamond, include_page, include_nested, by_keys, probe, null_order_page, big_in_list_page)},
}

_ORDERS_N = "(SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status_n, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price_n FROM orders) t"
_ITEM = "SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey"
_INC = "inc AS (SELECT CASE WHEN o_orderkey % 5 = 2 THEN o_orderkey + 10000000 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 5 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders)"
_TURNS = "SELECT conv_id FROM conversations GROUP BY conv_id HAVING"
_PARTS = "sold AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem), old AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')"
_NATIONS = "c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 7))"

ORACLES: dict[str, str] = {
    "flagship": "SELECT * FROM customer WHERE (contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')) AND c_acctbal >= 1000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 100000) ORDER BY c_acctbal DESC, c_custkey LIMIT 20",
    "base_equals": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    "base_null": f"SELECT o_orderkey FROM {_ORDERS_N} WHERE price_n IS NULL",
    "base_nested_is": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND n_regionkey = 1)",
    "like_ci": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget')",
    "like_cs": "SELECT p_partkey FROM part WHERE contains(p_name, 'widget')",
    "starts_with_ci": "SELECT p_partkey FROM part WHERE lower(p_name) LIKE 'red%'",
    "ends_with_ci": "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%bolt'",
    "equals_ci": "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'",
    "in_list": "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase')",
    "not_in_nullable": f"SELECT o_orderkey FROM {_ORDERS_N} WHERE status_n NOT IN ('F')",
    "between_incl": "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 1000",
    "gte_date": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'",
    "not_range_nullable": f"SELECT o_orderkey FROM {_ORDERS_N} WHERE NOT (price_n >= 100000 AND price_n IS NOT NULL)",
    "not_equals_nullable": f"SELECT o_orderkey FROM {_ORDERS_N} WHERE NOT (status_n = 'F')",
    "or_null": f"SELECT o_orderkey FROM {_ORDERS_N} WHERE price_n <= 50000 OR price_n IS NULL",
    "bool_nest": "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal >= 5000) OR (c_mktsegment = 'MACHINERY' AND c_acctbal <= 0)",
    "not_subtree": "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal <= 0)",
    "prune_blank": "SELECT c_custkey FROM customer WHERE c_acctbal >= 5000",
    "path_to_one": "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'",
    "rel_some": f"SELECT o_orderkey FROM orders WHERE EXISTS ({_ITEM} AND l_quantity >= 45)",
    "rel_every": f"SELECT o_orderkey FROM orders WHERE NOT EXISTS ({_ITEM} AND NOT (l_quantity >= 10))",
    "rel_none": f"SELECT o_orderkey FROM orders WHERE NOT EXISTS ({_ITEM} AND l_returnflag = 'R')",
    "rel_in_or": f"SELECT o_orderkey FROM orders WHERE EXISTS ({_ITEM} AND l_quantity >= 50) OR o_orderstatus = 'P'",
    "rel_two_hop_every": f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS ({_ITEM} AND NOT (l_quantity <= 49)))",
    "rel_independent": f"SELECT o_orderkey FROM orders WHERE EXISTS ({_ITEM} AND l_quantity >= 45) AND EXISTS ({_ITEM} AND l_returnflag = 'R')",
    "rel_same_row": f"SELECT o_orderkey FROM orders WHERE EXISTS ({_ITEM} AND l_linenumber = 1 AND l_returnflag = 'R')",
    "json_equals": "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 87",
    "json_range": "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 10 AND 20",
    "has_some": "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue'])",
    "has_every": "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'widget'])",
    "embedded_every": "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_and(role IN ('user', 'assistant'))",
    "big_in_list": "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 0 AND 11999",
    "order_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40",
    "page_total": "SELECT count(*) AS total FROM customer WHERE c_acctbal >= 5000",
    "include_to_one": "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "include_to_many": "SELECT o_orderkey, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "upsert_classify": f"WITH {_INC} SELECT CASE WHEN o_orderkey IS NULL THEN 'created' WHEN p IS DISTINCT FROM o_totalprice THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS n FROM inc LEFT JOIN orders ON o_orderkey = k GROUP BY 1",
    "upsert_snapshot": f"WITH {_INC} SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NULL THEN o_totalprice ELSE p END AS o_totalprice, o_orderstatus FROM orders FULL JOIN inc ON o_orderkey = k",
    "create_many": "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "update_by_filter": "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "update_many_by_id": "SELECT p.p_partkey, coalesce(q.p_size + 1, p.p_size) AS p_size FROM part p LEFT JOIN part q ON q.p_partkey * 2 = p.p_partkey",
    "delete_by_filter": f"SELECT o_orderkey FROM {_ORDERS_N} WHERE NOT coalesce(status_n = 'F', false)",
    "delete_by_ids": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT BETWEEN 0 AND 9",
    "delete_cascade": "WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal <= 0), gone_orders AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone)) SELECT 'customer' AS model, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM gone) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (FROM gone) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM gone_orders)",
    "upsert_last_wins": "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id",
    "link_apply": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "is_null": f"SELECT o_orderkey FROM {_ORDERS_N} WHERE price_n IS NULL",
    "equals_null_in_tree": f"SELECT o_orderkey FROM {_ORDERS_N} WHERE status_n IS NULL OR price_n >= 400000",
    "embedded_some": f"{_TURNS} bool_or(role = 'system')",
    "embedded_none": f"{_TURNS} NOT bool_or(role = 'system')",
    "embedded_single": f"{_TURNS} count(*) >= 4",
    "embedded_nested": f"{_TURNS} bool_or(role = 'system')",
    "json_like": "SELECT p_partkey FROM part WHERE contains(lower(p_brand), '#1')",
    "json_starts_with": "SELECT p_partkey FROM part WHERE lower(p_brand) LIKE 'brand%'",
    "json_ends_with": "SELECT p_partkey FROM part WHERE p_brand LIKE '%2'",
    "json_index": "SELECT p_partkey FROM part WHERE string_split(p_name, ' ')[1] = 'red'",
    "json_has_every": "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'widget'])",
    "json_has_every_typed": "SELECT p_partkey FROM part WHERE p_size = 7",
    "json_nested_range": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20",
    "json_through_relation": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size = 7)",
    "json_bare": "SELECT event_id FROM events WHERE contains(props, '87')",
    "base_dotted": "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'",
    "base_array": "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'widget'])",
    "base_and_search": f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND EXISTS ({_ITEM} AND l_quantity >= 45)",
    "or_null_through_relation": f"SELECT l_orderkey, l_linenumber FROM lineitem JOIN {_ORDERS_N} ON o_orderkey = l_orderkey WHERE price_n <= 50000 OR price_n IS NULL",
    "any_of": "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '9') OR contains(lower(c_mktsegment), '9')",
    "all_of": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e') AND contains(lower(p_type), 'e')",
    "conditions_from": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "parse_total": "SELECT c_custkey FROM customer WHERE c_acctbal <= 0",
    "upsert_normalized": "SELECT CASE WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'NEW' THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS n FROM customer GROUP BY 1",
    "upsert_omitted_and_null": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "create_many_links": f"WITH {_PARTS} SELECT l_partkey, l_suppkey FROM old UNION SELECT p_partkey + 10000000, s FROM part JOIN sold ON k = p_partkey WHERE p_size > 10",
    "upsert_links": f"WITH {_PARTS} SELECT l_partkey, l_suppkey FROM old UNION SELECT p_partkey, s FROM part JOIN sold ON k = p_partkey WHERE p_size > 10",
    "delete_by_id_table": f"SELECT o_orderkey FROM orders WHERE NOT EXISTS ({_ITEM} AND l_returnflag = 'R')",
    "create_many_orders": "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey + 10000000, o_totalprice FROM orders WHERE o_orderkey % 2 = 0",
    "delete_cascade_diamond": f"WITH {_NATIONS} SELECT 'nation' AS model, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation WHERE n_nationkey NOT IN (3, 7) UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (FROM c) UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier WHERE s_suppkey NOT IN (FROM s) UNION ALL SELECT 'orders', o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (FROM o) UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (FROM o) AND l_suppkey NOT IN (FROM s)",
    "include_page": "WITH page AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10) SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS at, l_linenumber, l_partkey, l_quantity FROM page JOIN lineitem ON l_orderkey = o_orderkey",
    "include_nested": "WITH page AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 30), items AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT c_custkey, n_name, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS at, o_orderkey, coalesce(n, 0) AS n_items, c_name FROM page JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN items ON l_orderkey = o_orderkey",
    "by_keys": f"SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS ({_ITEM} AND l_quantity >= 50)",
    "probe": "SELECT * FROM customer WHERE c_custkey = 42",
    "null_order_page": f"SELECT o_orderkey, price_n FROM {_ORDERS_N} ORDER BY price_n ASC NULLS FIRST, o_orderkey LIMIT 2000 OFFSET 10",
    "big_in_list_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 0 AND 11999 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50",
}
