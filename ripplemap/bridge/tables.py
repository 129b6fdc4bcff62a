"""Inputs for every operator, derived from the driver tables.

The SQL twin of each function is the common table expression of the same meaning in ``ctes``.
"""

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.functions import constants as K
from ripplemap.functions.urn import dataset_key, dataset_urn, expanded
from ripplemap.marts import facts, staging
from ripplemap.operators import catalog, cube, expand
from ripplemap.plans.review import Catalog, Review
from ripplemap.plans.session import if_any, stored

PROFILES = ("covered", "dark")
PLATFORMS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
DARK_WITHOUT = ("lineitem", "region")
LANDING = ("region", "part")
MODEL_PLATFORM = "orders"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = (K.RENAMED, K.DROPPED, K.ADDED, K.NARROWED, K.WIDENED, K.LOGIC)
FIXED_TIME = "2024-01-01 00:00:00"


class Driver:
    """Driver tables of one scale folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}
        self._reviews: dict[tuple, Review] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # --- catalog ----------------------------------------------------------
    @cached_property
    def _line_pairs(self) -> DataFrame:
        return stored(self.table("lineitem").select("l_orderkey", "l_linenumber").distinct(), "line_pairs")

    def line_pairs(self) -> DataFrame:
        """Lines by their keys; entities and the registry read them several times."""
        return self._line_pairs

    def names(self) -> DataFrame:
        """(platform, name) of every entity."""

        def keyed(table: str, key: str, prefix: str) -> DataFrame:
            return self.table(table).select(
                F.lit(table).alias("platform"), _name(prefix, F.col(key)).alias("name")
            )

        lines = self.line_pairs().select(
            F.lit("lineitem").alias("platform"),
            line_name(F.col("l_orderkey"), F.col("l_linenumber")).alias("name"),
        )
        parts = [
            keyed("region", "r_regionkey", "region-"),
            keyed("nation", "n_nationkey", "nation-"),
            keyed("customer", "c_custkey", "acct-"),
            keyed("supplier", "s_suppkey", "acct-"),
            keyed("part", "p_partkey", "part-"),
            keyed("orders", "o_orderkey", "order-"),
            lines,
        ]
        return reduce(DataFrame.unionByName, parts)

    def entities(self) -> DataFrame:
        return catalog.with_urn(self.names())

    def edges(self) -> DataFrame:
        """(up_urn, down_urn, up_platform, down_platform, provenance, confidence)."""
        rows = self.key_edges()
        return rows.select(
            expanded(F.col("src")).alias("up_urn"), expanded(F.col("dst")).alias("down_urn"),
            "up_platform", "down_platform", "provenance",
            expand.confidence_of(F.col("provenance")).alias("confidence"),
        )

    def key_edges(self) -> DataFrame:
        """(src, dst, up_platform, down_platform, provenance) on compact keys."""
        nation, customer = self.table("nation"), self.table("customer")
        supplier, orders, line = self.table("supplier"), self.table("orders"), self.table("lineitem")
        parsed = F.lit("parsed")
        evidence = (
            F.when(F.col("l_orderkey") % 7 == 0, "inferred")
            .when(F.col("l_orderkey") % 11 == 0, "curated")
            .otherwise("parsed")
        )
        this_line = line_name(F.col("l_orderkey"), F.col("l_linenumber"))

        def edge(df, up_platform, up, down_platform, down, how=parsed) -> DataFrame:
            source = F.lit(up_platform)  # a Column stays one
            return df.select(
                dataset_key(source, up).alias("src"),
                dataset_key(F.lit(down_platform), down).alias("dst"),
                source.alias("up_platform"),
                F.lit(down_platform).alias("down_platform"),
                how.alias("provenance"),
            )

        # Rows of one line of an order meet once; distinct edges of each kind are found there.
        of_line = ["l_orderkey", "l_linenumber"]
        above_line = (
            ("orders", "order-", "l_orderkey"), ("supplier", "acct-", "l_suppkey"), ("part", "part-", "l_partkey")
        )
        ups = [
            F.struct(F.lit(place).alias("up"), F.col(key).cast("bigint").alias("up_key"))
            for place, (_, _, key) in enumerate(above_line)
        ]
        # A name is made of the key after it was found to be distinct, which is cheaper.
        up_platform, up_name = F.when(F.lit(False), ""), F.when(F.lit(False), "")
        for place, (platform, prefix, _) in enumerate(above_line):
            up_platform = up_platform.when(F.col("up") == place, platform)
            up_name = up_name.when(F.col("up") == place, _name(prefix, F.col("up_key")))
        met = line.select(*of_line, "l_suppkey", "l_partkey").repartition(*of_line)
        above = met.select(*of_line, F.inline(F.array(*ups))).distinct()
        parts = [
            edge(nation, "region", _name("region-", F.col("n_regionkey")),
                 "nation", _name("nation-", F.col("n_nationkey"))),
            edge(customer, "nation", _name("nation-", F.col("c_nationkey")),
                 "customer", _name("acct-", F.col("c_custkey"))),
            edge(supplier, "nation", _name("nation-", F.col("s_nationkey")),
                 "supplier", _name("acct-", F.col("s_suppkey"))),
            edge(orders, "customer", _name("acct-", F.col("o_custkey")),
                 "orders", _name("order-", F.col("o_orderkey"))),
            edge(above, up_platform, up_name, "lineitem", this_line, evidence),
        ]
        return reduce(DataFrame.unionByName, parts)

    def profile_platforms(self) -> DataFrame:
        """Declared: which platforms each profile has connected."""
        rows = [("covered", p, True) for p in PLATFORMS]
        rows += [("dark", p, False) for p in PLATFORMS if p not in DARK_WITHOUT]
        return self.spark.createDataFrame(rows, "profile string, platform string, emit_inferred boolean")

    def platforms(self) -> DataFrame:
        return (
            self.names().groupBy("platform").agg(F.count(F.lit(1)).alias("expected"))
            .select("platform", "expected", F.concat(F.lit("entities of "), "platform").alias("note"),
                    (~F.col("platform").isin(*LANDING)).alias("hosts_consumers"))
        )

    def registry(self) -> DataFrame:
        return catalog.build_registry(self.platforms(), self.profile_platforms(), list(PROFILES))

    @cached_property
    def masked_edges(self) -> DataFrame:
        """Edges with the profiles that see them, stored as a catalog would hold them."""
        seen = catalog.masked_edges(self.key_edges(), self.profile_platforms(), list(PROFILES))
        return stored(seen, "edges", plain=("src", "dst"))

    @property
    def masked_column_edges(self) -> DataFrame:
        """Column ``key`` on every edge but those of suppliers."""
        own = self.masked_edges.filter(
            (F.col("up_platform") != "supplier") & (F.col("down_platform") != "supplier")
        )
        return own.withColumns({"up_col": F.lit("key"), "down_col": F.lit("key")})

    @property
    def profile_edges(self) -> DataFrame:
        """Edge table per profile."""
        rows = catalog.edges_by_profile(self.masked_edges, list(PROFILES))
        return rows.withColumn("confidence", expand.confidence_of(F.col("provenance")))

    @property
    def profile_column_edges(self) -> DataFrame:
        return self.profile_edges.filter(
            (F.col("up_platform") != "supplier") & (F.col("down_platform") != "supplier")
        ).select(
            "profile", "up_urn", F.lit("key").alias("up_col"), "down_urn", F.lit("key").alias("down_col"),
            "down_platform", "provenance",
        )

    @cached_property
    def down_hubs(self) -> DataFrame | None:
        links = cube.mask_links(self.masked_edges, list(PROFILES))
        return if_any(cube.link_hubs(links, ["src"]))

    def catalog(self) -> Catalog:
        return Catalog(
            self.entities(), self.profile_edges, self.profile_column_edges, self.registry(),
            PROFILES, LANDING, MODEL_PLATFORM, self.masked_edges, self.masked_column_edges,
        )

    # --- changes ----------------------------------------------------------
    def changes(self) -> DataFrame:
        """One change per event, per nation and per region."""
        e = self.table("events")
        t, user, eid = F.col("event_type"), F.col("user_id"), F.col("event_id")
        model = (
            F.when(t.isin("click", "view"), _name("acct-", user))
            .when(t == "purchase", _name("order-", eid))
            .when(t == "signup", _name("part-", user))
            .otherwise(_name("ghost-", eid))
        )
        answer = (
            F.when(t == "error", "Breaks hard").when(t == "view", "it degrades")
            .when(t == "purchase", "BREAKS and DEGRADES").otherwise("unknown")
        )
        fixed = F.lit(FIXED_TIME).cast("timestamp_ntz")
        no_answer = F.lit(None).cast("string")
        rows = e.select(eid.alias("change_id"), model.alias("model"), eid.alias("n"), "ts", answer.alias("answer"))
        nations = self.table("nation").select(
            (-1 - F.col("n_nationkey").cast("bigint")).alias("change_id"),
            _name("nation-", F.col("n_nationkey")).alias("model"),
            F.col("n_nationkey").cast("bigint").alias("n"), fixed.alias("ts"), no_answer.alias("answer"),
        )
        regions = self.table("region").select(
            (-1001 - F.col("r_regionkey").cast("bigint")).alias("change_id"),
            _name("region-", F.col("r_regionkey")).alias("model"),
            F.col("r_regionkey").cast("bigint").alias("n"), fixed.alias("ts"), no_answer.alias("answer"),
        )
        kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("n") % 6 + 1).cast("int"))
        column = F.when(F.col("n") % 4 == 3, "missing").when(F.col("n") % 4 > 0, "key")
        return (
            rows.unionByName(nations).unionByName(regions)
            .select("change_id", "model", kind.alias("kind"), column.alias("column"),
                    F.col("ts").alias("recorded_at"), "answer")
            .withColumn("new_value", F.when(F.col("kind") == K.RENAMED, "new_key"))
        )

    def overrides(self) -> DataFrame:
        return self.changes().filter(F.col("change_id") % 10 == 0).select(
            "change_id", F.lit("accepted").alias("reason")
        )

    def sources(self) -> DataFrame:
        """A model source per order; it names ``key`` twice and ``key_hash`` once."""
        return self.table("orders").select(
            _name("order-", F.col("o_orderkey")).alias("name"),
            F.concat(F.lit("models/"), F.col("o_orderpriority"), F.lit("/order-"),
                     F.col("o_orderkey").cast("string"), F.lit(".sql")).alias("path"),
            F.concat(F.lit("select key, key_hash from acct_"), F.col("o_custkey").cast("string"),
                     F.lit(" where key > 0")).alias("sql_text"),
        )

    def document_sources(self) -> DataFrame:
        """Every document as a model source, text as it is."""
        return self.table("documents").select(
            "doc_id", _name("doc-", F.col("doc_id")).alias("name"),
            F.concat(F.lit("models/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"),
                     F.lit(".sql")).alias("path"),
            F.col("text").alias("sql_text"),
        )

    def attempts(self) -> DataFrame:
        """Check attempts of the change of each user's id; the event id orders them."""
        return self.table("events").select(
            F.col("user_id").alias("change_id"), F.col("event_id").alias("attempt"),
            F.lit("build models").alias("command"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
            F.when(F.col("event_type") == "error",
                   F.concat(F.lit("Binder Error: Referenced column "), "props", F.lit(" not found")))
            .when(F.col("event_type") == "view", F.concat(F.lit("column not found in "), "props"))
            .otherwise(F.col("props")).alias("output"),
        )

    @cached_property
    def _base(self) -> Review:
        return Review(
            self.changes(), self.catalog(), self.overrides(), self.sources(), self.attempts()
        )

    def review(self, **options) -> Review:
        """The review of all changes; ``options`` select a judge or the true provenance mode."""
        key = tuple(sorted(options.items()))
        if key not in self._reviews:
            self._reviews[key] = self._base.variant(**options) if options else self._base
        return self._reviews[key]

    # --- diffs ------------------------------------------------------------
    def diffs(self) -> DataFrame:
        """(diff_id, text): one diff per event."""
        u = F.col("user_id").cast("string")
        head = F.format_string(
            "--- a/models/staging/stg_%s.sql\n+++ b/models/staging/stg_%s.sql\n", "event_type", "event_type"
        )
        bodies = [
            F.format_string("@@ -1 +1 @@\n-    k%s,\n+    k%s as n%s,\n context", u, u, u),
            F.format_string("-    k%s,", u),
            F.format_string("+    k%s,", u),
            F.format_string("+    cast(k%s as decimal(10,2)) v,", u),
            F.format_string("+    cast(k%s as bigint) v,", u),
            F.lit("-where a\n+where a and b"),
        ]
        case = F.col("event_id") % 7
        text = F.lit("no header\n-gone")
        for i, body in enumerate(bodies):
            text = F.when(case == i, F.concat(head, body)).otherwise(text)
        return self.table("events").select(F.col("event_id").alias("diff_id"), text.alias("text"))

    # --- payloads and logs ------------------------------------------------
    def payloads(self) -> DataFrame:
        acct = dataset_urn(F.lit("customer"), _name("acct-", F.col("user_id")))
        order = dataset_urn(F.lit("orders"), _name("order-", F.col("event_id")))
        text = F.concat(
            F.lit('{"results": [{"urn": "'), acct, F.lit('"}, {"urn": "'), order, F.lit('"}, {"urn": "'),
            acct, F.lit('"}], "'), order, F.lit('": 1, "note": "see \\"'), order,
            F.lit('\\" there", "props": '), F.col("props"), F.lit("}"),
        )
        return self.table("events").select(F.col("event_id").alias("id"), text.alias("payload"))

    def query_log(self) -> DataFrame:
        return self.table("events").select(
            dataset_urn(F.lit("customer"), _name("acct-", F.col("user_id"))).alias("urn"), "ts",
            F.when(F.col("event_type") == "view", "key").otherwise("other").alias("column"), "value",
        )

    # --- warehouse --------------------------------------------------------
    def raw_users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("user_id"), F.col("c_name").alias("email"),
            F.date_add(F.lit("2024-01-01").cast("date"), (key % 600).cast("int")).alias("signup_date"),
            F.col("c_mktsegment").alias("country"), (key % 97 == 0).alias("is_test"),
        )

    def raw_orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "pending").otherwise("cancelled").alias("status"),
            F.col("o_orderpriority").alias("channel"),
        )

    def raw_order_items(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
            F.col("l_orderkey").alias("order_id"), _name("SKU-", F.col("l_partkey")).alias("sku"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.round("l_extendedprice").cast("bigint").alias("unit_price_cents"),
        )

    def raw_payments(self) -> DataFrame:
        totals = facts.order_totals(self.raw_order_items(), self.raw_orders())
        return totals.select(
            F.col("order_id").alias("payment_id"), "order_id", "amount_cents",
            F.col("channel").alias("method"),
            F.date_add("order_date", (F.col("order_id") % 30).cast("int")).alias("paid_at"),
        )

    def raw_refunds(self) -> DataFrame:
        return self.table("lineitem").filter(F.col("l_returnflag") == "R").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("refund_id"),
            F.col("l_orderkey").alias("order_id"),
            F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("bigint").alias("refund_amount_cents"),
            F.col("l_shipdate").cast("date").alias("refund_date"),
            F.col("l_linestatus").alias("reason"),
        )

    def finance_extract(self) -> DataFrame:
        period = F.explode(F.sequence(F.lit(1), F.lit(4)))
        return self.table("region").select("r_regionkey", "r_name", period.alias("p")).select(
            F.concat(F.lit("Q"), F.col("p").cast("string")).alias("period"),
            F.col("r_name").alias("region"),
            ((F.col("r_regionkey").cast("bigint") + 1) * F.col("p") * 1000).alias("reported_revenue_usd"),
        )

    def staging(self) -> dict[str, DataFrame]:
        return {
            "stg_users": staging.stg_users(self.raw_users()),
            "stg_orders": staging.stg_orders(self.raw_orders()),
            "stg_order_items": staging.stg_order_items(self.raw_order_items()),
            "stg_payments": staging.stg_payments(self.raw_payments()),
            "stg_refunds": staging.stg_refunds(self.raw_refunds()),
        }

    def revenue(self) -> DataFrame:
        s = self.staging()
        return facts.fct_revenue(s["stg_payments"], s["stg_orders"], s["stg_refunds"])

    def ltv(self) -> DataFrame:
        return facts.customer_ltv(self.revenue())

    def segment_input(self) -> DataFrame:
        """Lifetime value scaled so that several bins fill; every user, null without payments."""
        value = (F.col("lifetime_value_usd") / 40.0).alias("lifetime_value_usd")
        users = self.raw_users().select(F.col("user_id").alias("cust_id"))
        return users.join(self.ltv(), "cust_id", "left").select("cust_id", value)


def _name(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def line_name(order: Column, number: Column) -> Column:
    return F.concat(F.lit("line-"), order.cast("string"), F.lit("-"), number.cast("string"))
