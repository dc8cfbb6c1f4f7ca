"""Layered merging over documents of users and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.layers import (
    MERGE_ANNOTATION,
    OWN_LAYER,
    layered_merge,
    merge_once,
    order_layers,
    precedence_stack,
    resolve_layers,
    stack_layers,
)
from tallymill.plans.registry import query, table
from tallymill.plans.rendered import DOCS_CTE, documents, map_text
from tallymill.session import checkpoint, spread

# --- merge rules on the documents of users ----------------------------------


@query(
    "merge_required_scalar",
    f"""WITH {DOCS_CTE}
        SELECT user_id, arg_max(t, layer) AS main_application_file FROM docs GROUP BY user_id""",
)
def _merge_required_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"main_application_file": "last"}
    return layered_merge(documents(spark, sf_dir), "user_id", "layer", rules)


@query(
    "merge_optional_scalar",
    f"""WITH {DOCS_CTE}
        SELECT user_id, arg_max('class.' || t, layer) FILTER (v > 30) AS main_class
        FROM docs GROUP BY user_id""",
)
def _merge_optional_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered_merge(documents(spark, sf_dir), "user_id", "layer", {"main_class": "last_set"})


@query(
    "merge_replicas",
    f"""WITH {DOCS_CTE}
        SELECT user_id, arg_max(k, layer) FILTER (k % 2 = 0) AS replicas
        FROM docs GROUP BY user_id""",
)
def _merge_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered_merge(documents(spark, sf_dir), "user_id", "layer", {"replicas": "last_set"})


def _entries(pairs: str, where: str = "true") -> str:
    """SQL for a union of maps, given as key and value expressions per document."""
    stacked = " UNION ALL ".join(
        f"SELECT user_id, layer, {key} AS mk, {value} AS mv FROM docs WHERE {where}"
        for key, value in [p.split(" => ") for p in pairs.split("; ")]
    )
    return f"""
      SELECT user_id, string_agg(mk || '=' || mv, ',' ORDER BY mk) AS merged FROM (
        SELECT user_id, mk, arg_max(mv, layer) AS mv FROM ({stacked}) GROUP BY user_id, mk)
      GROUP BY user_id"""


CONF = _entries("t => CAST(v AS VARCHAR); 'k' => CAST(k AS VARCHAR)", "t <> 'view'")


@query(
    "merge_maps",
    f"""WITH {DOCS_CTE}, m AS ({CONF})
        SELECT user_id, merged AS spark_conf
        FROM (SELECT DISTINCT user_id FROM docs) LEFT JOIN m USING (user_id)""",
)
def _merge_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = layered_merge(documents(spark, sf_dir), "user_id", "layer", {"spark_conf": "union"})
    return merged.select("user_id", map_text("spark_conf").alias("spark_conf"))


@query(
    "merge_arrays",
    f"""WITH {DOCS_CTE}
        SELECT user_id, coalesce(string_agg(t || ',' || k, ',' ORDER BY layer)
                                 FILTER (t <> 'click'), '') AS args
        FROM docs GROUP BY user_id""",
)
def _merge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = layered_merge(documents(spark, sf_dir), "user_id", "layer", {"args": "concat"})
    return merged.select("user_id", F.array_join("args", ",").alias("args"))


@query(
    "merge_nested_maps",
    f"""WITH {DOCS_CTE},
        e AS ({_entries("t => CAST(k AS VARCHAR)", "t <> 'error'")}),
        c AS ({_entries("'level' => t", "t = 'error'")})
        SELECT user_id, e.merged AS env_overrides, c.merged AS config_overrides
        FROM (SELECT DISTINCT user_id FROM docs) LEFT JOIN e USING (user_id)
        LEFT JOIN c USING (user_id)""",
)
def _merge_nested_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"job.env_overrides": "union", "job.config_overrides": "union"}
    merged = layered_merge(documents(spark, sf_dir), "user_id", "layer", rules)
    return merged.select(
        "user_id",
        map_text(F.col("`job.env_overrides`")).alias("env_overrides"),
        map_text(F.col("`job.config_overrides`")).alias("config_overrides"),
    )


@query(
    "merge_fragments",
    f"""WITH {DOCS_CTE}
        SELECT user_id, arg_max(k, layer) FILTER (t NOT IN ('view', 'error')) AS cores,
               arg_max(v, layer) FILTER (t = 'signup') AS memory,
               arg_min(k, layer) FILTER (t NOT IN ('view', 'error')) AS base_cores,
               count(*) FILTER (t <> 'view') = 0 AS absent
        FROM docs GROUP BY user_id""",
)
def _merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both precedences: the overlay wins, and the base wins."""
    docs = documents(spark, sf_dir).withColumn("base", F.col("config"))
    rules = {"config": "fragment", "base": "fragment_base"}
    return layered_merge(docs, "user_id", "layer", rules).select(
        "user_id",
        "config.cores",
        "config.memory",
        F.col("base.cores").alias("base_cores"),
        F.col("config").isNull().alias("absent"),
    )


@query(
    "merge_containers",
    f"""WITH {DOCS_CTE},
        e AS (
          SELECT user_id, layer, 0 AS pos, t AS name, 'requests' AS f, 'cpu' AS mk, k || 'm' AS mv FROM docs
          UNION ALL SELECT user_id, layer, 0, t, 'limits', 'memory', k || 'Mi' FROM docs WHERE v > 30
          UNION ALL SELECT user_id, layer, 1, 'sidecar', 'requests', t, CAST(k AS VARCHAR) FROM docs),
        w AS (SELECT user_id, name, f, mk, arg_max(mv, layer) AS mv FROM e GROUP BY ALL),
        el AS (
          SELECT user_id, name,
                 string_agg(mk || '=' || mv, ',' ORDER BY mk) FILTER (f = 'requests') AS r,
                 string_agg(mk || '=' || mv, ',' ORDER BY mk) FILTER (f = 'limits') AS l
          FROM w GROUP BY ALL),
        p AS (SELECT user_id, name, min(layer * 10 + pos) AS place FROM e GROUP BY ALL)
        SELECT user_id, string_agg(name || '(' || coalesce(r, '-') || ';' || coalesce(l, '-') || ')', ' '
                                   ORDER BY place) AS containers
        FROM el JOIN p USING (user_id, name) GROUP BY user_id""",
)
def _merge_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(container: Column) -> Column:
        def part(name: str) -> Column:
            return F.coalesce(map_text(container[name]), F.lit("-"))

        requests, limits = part("requests"), part("limits")
        return F.concat(container["name"], F.lit("("), requests, F.lit(";"), limits, F.lit(")"))

    docs = checkpoint(documents(spark, sf_dir).select("user_id", "layer", "containers"))
    merged = layered_merge(docs, "user_id", "layer", {"containers": "named"})
    listed = F.array_join(F.transform("containers", text), " ")
    return merged.select("user_id", listed.alias("containers"))


@query(
    "merge_environment",
    f"""WITH {DOCS_CTE}, m AS ({_entries("t => CAST(k AS VARCHAR); 'HOUR' => CAST(layer AS VARCHAR)")})
        SELECT user_id, merged AS env FROM m""",
)
def _merge_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = layered_merge(documents(spark, sf_dir), "user_id", "layer", {"env": "env"})
    pairs = F.transform("env", lambda e: F.concat(e["name"], F.lit("="), e["value"]))
    return merged.select("user_id", F.array_join(pairs, ",").alias("env"))


@query(
    "merge_documents",
    f"""WITH {DOCS_CTE}, m AS ({CONF})
        SELECT * FROM (
          SELECT user_id, arg_max(t, layer) AS main_application_file,
                 arg_max('class.' || t, layer) FILTER (v > 30) AS main_class,
                 coalesce(string_agg(t || ',' || k, ',' ORDER BY layer) FILTER (t <> 'click'), '') AS args
          FROM docs GROUP BY user_id)
        LEFT JOIN (SELECT user_id, merged AS spark_conf FROM m) USING (user_id)""",
)
def _merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rules at once, on documents that are written once for them."""
    rules = {
        "main_application_file": "last",
        "main_class": "last_set",
        "args": "concat",
        "spark_conf": "union",
    }
    docs = checkpoint(documents(spark, sf_dir).select("user_id", "layer", *rules))
    return layered_merge(docs, "user_id", "layer", rules).select(
        "user_id",
        "main_application_file",
        "main_class",
        F.array_join("args", ",").alias("args"),
        map_text("spark_conf").alias("spark_conf"),
    )


# --- settings of customers --------------------------------------------------


@query(
    "precedence_stack",
    """WITH sources AS (
         SELECT c_custkey, 0 AS layer, 'level' AS mk, 'INFO' AS mv FROM customer
         UNION ALL SELECT c_custkey, 0, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer
         UNION ALL SELECT c_custkey, 1, 'level', c_mktsegment FROM customer WHERE c_acctbal > 0
         UNION ALL SELECT o_custkey, 2, 'order.' || o_orderstatus, o_orderpriority
         FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus
                                                ORDER BY o_orderkey DESC) = 1)
       SELECT c_custkey, string_agg(mk || '=' || mv, ',' ORDER BY mk) AS conf FROM (
         SELECT c_custkey, mk, arg_max(mv, layer) AS mv FROM sources GROUP BY c_custkey, mk)
       GROUP BY c_custkey""",
)
def _precedence_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, then segment settings, then one setting per order status."""
    customer = table(spark, sf_dir, "customer")
    nation = F.col("c_nationkey").cast("string")
    defaults = customer.select(
        "c_custkey",
        F.create_map(F.lit("level"), F.lit("INFO"), F.lit("nation"), nation).alias("conf"),
    )
    segment = customer.filter("c_acctbal > 0").select(
        "c_custkey", F.create_map(F.lit("level"), F.col("c_mktsegment")).alias("conf")
    )
    last = F.max_by("o_orderpriority", "o_orderkey")
    user = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
        .agg(last.alias("priority"))
        .select(
            "c_custkey",
            F.create_map(F.concat(F.lit("order."), F.col("o_orderstatus")), "priority").alias("conf"),
        )
    )
    stacked = precedence_stack([defaults, segment, user], "c_custkey", "conf")
    return stacked.select("c_custkey", map_text("conf").alias("conf"))


# --- templates of orders ----------------------------------------------------


def specs(spark: SparkSession, sf_dir: str, switch: Column | None = None) -> DataFrame:
    """Orders as documents that name three layers in annotations, out of order.

    Suppliers are the templates; some of the names do not exist. All documents
    ask for a merge unless ``switch`` says otherwise; where it is NULL, they do
    not mention it.
    """

    def supplier(number: Column) -> Column:
        return F.concat(F.lit("Supplier#"), F.lpad(number.cast("string"), 9, "0"))

    def annotation(index: int) -> Column:
        return F.lit(f"spark-application.template.{index}.name")

    key = F.col("o_orderkey")
    annotations = F.create_map(
        annotation(10),
        supplier(key % 7),
        F.lit(MERGE_ANNOTATION),
        F.lit("true") if switch is None else switch,
        annotation(9),
        supplier(10 + key % 11),
        annotation(200),
        supplier(F.lit(95) + key % 10_000),
    )
    if switch is not None:
        annotations = F.map_filter(annotations, lambda _, v: v.isNotNull())
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    return orders.select(
        "o_orderkey",
        annotations.alias("annotations"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("conf"),
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("s_nationkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.create_map(
            F.lit("nation"), nation, F.lit("status"), F.lit("T"), F.col("s_name"), nation
        ).alias("conf"),
    )


REFS_CTE = """
refs AS (
  SELECT o_orderkey, o_orderstatus, layer, 'Supplier#' || lpad(CAST(n AS VARCHAR), 9, '0') AS name
  FROM (SELECT o_orderkey, o_orderstatus, unnest([0, 1, 2]) AS layer,
               unnest([10 + o_orderkey % 11, o_orderkey % 7, 95 + o_orderkey % 10000]) AS n
        FROM orders))"""


@query(
    "ordered_layers",
    f"""WITH {REFS_CTE}
        SELECT o_orderkey, string_agg(name, ',' ORDER BY layer) AS layers FROM refs GROUP BY 1""",
)
def _ordered_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = F.array_join(order_layers("annotations"), ",").alias("layers")
    return specs(spark, sf_dir).select("o_orderkey", layers)


@query(
    "resolved_layers",
    f"""WITH {REFS_CTE}
        SELECT o_orderkey, CAST(layer AS INTEGER) AS layer, name, s_nationkey AS nation
        FROM refs JOIN supplier ON s_name = name""",
)
def _resolved_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_layers(
        specs(spark, sf_dir), templates(spark, sf_dir), "o_orderkey", order_layers("annotations")
    )
    nation = F.col("conf")["nation"].cast("int").alias("nation")
    return resolved.select("o_orderkey", "layer", "name", nation)


STACKED = f"""
SELECT o_orderkey, CAST(layer AS INTEGER) AS layer, name FROM refs JOIN supplier ON s_name = name
UNION ALL SELECT o_orderkey, {OWN_LAYER}, NULL FROM orders"""


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = specs(spark, sf_dir)
    resolved = resolve_layers(
        own, templates(spark, sf_dir), "o_orderkey", order_layers("annotations")
    )
    return stack_layers(resolved, own.select("o_orderkey", "conf"))


@query("stacked_layers", f"WITH {REFS_CTE} {STACKED}")
def _stacked_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(spark, sf_dir).select("o_orderkey", "layer", "name")


@query(
    "merge_once",
    f"""WITH {REFS_CTE},
        used AS (SELECT refs.*, s_nationkey FROM refs JOIN supplier ON s_name = name),
        fresh AS (SELECT * FROM orders WHERE o_orderkey NOT IN (
                    SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
        entries AS (
          SELECT o_orderkey, layer, 'nation' AS mk, CAST(s_nationkey AS VARCHAR) AS mv FROM used
          UNION ALL SELECT o_orderkey, layer, name, CAST(s_nationkey AS VARCHAR) FROM used
          UNION ALL SELECT o_orderkey, 999, 'status', o_orderstatus FROM orders),
        merged AS (
          SELECT o_orderkey, string_agg(mk || '=' || mv, ',' ORDER BY mk) AS conf FROM (
            SELECT o_orderkey, mk, arg_max(mv, layer) AS mv FROM entries GROUP BY o_orderkey, mk)
          GROUP BY o_orderkey),
        applied AS (
          SELECT o_orderkey, string_agg(name, ',' ORDER BY layer) AS applied FROM used GROUP BY 1)
        SELECT o_orderkey, conf, coalesce(applied, '') AS applied
        FROM fresh JOIN merged USING (o_orderkey) LEFT JOIN applied USING (o_orderkey)""",
)
def _merge_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a returned item stand for the keys that are merged already."""
    ledger = (
        table(spark, sf_dir, "lineitem")
        .filter("l_returnflag = 'R'")
        .select(F.col("l_orderkey").alias("o_orderkey"), F.lit("Unknown").alias("phase"))
    )
    merged = merge_once(stacked(spark, sf_dir), ledger, "o_orderkey", "layer", {"conf": "union"})
    return merged.select(
        "o_orderkey", map_text("conf").alias("conf"), F.array_join("applied", ",").alias("applied")
    )


@query(
    "merge_switched_off",
    f"""WITH {REFS_CTE},
        used AS (SELECT refs.*, s_nationkey FROM refs JOIN supplier ON s_name = name WHERE o_orderkey % 3 = 0),
        entries AS (
          SELECT o_orderkey, layer, 'nation' AS mk, CAST(s_nationkey AS VARCHAR) AS mv FROM used
          UNION ALL SELECT o_orderkey, layer, name, CAST(s_nationkey AS VARCHAR) FROM used
          UNION ALL SELECT o_orderkey, 999, 'status', o_orderstatus FROM orders),
        applied AS (
          SELECT o_orderkey, string_agg(name, ',' ORDER BY layer) AS applied FROM used GROUP BY 1)
        SELECT o_orderkey, string_agg(mk || '=' || mv, ',' ORDER BY mk) AS conf, coalesce(any_value(applied), '') AS applied
        FROM (SELECT o_orderkey, mk, arg_max(mv, layer) AS mv FROM entries GROUP BY o_orderkey, mk)
        LEFT JOIN applied USING (o_orderkey) GROUP BY o_orderkey""",
)
def _merge_switched_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders ask for a merge, a third ask for none and a third say nothing."""
    third = F.col("o_orderkey") % 3
    own = specs(spark, sf_dir, F.when(third == 0, "true").when(third == 1, "false"))
    resolved = resolve_layers(own, templates(spark, sf_dir), "o_orderkey", order_layers("annotations"))
    none = spark.createDataFrame([], "o_orderkey long, phase string")
    docs = stack_layers(resolved, own.select("o_orderkey", "conf"))
    merged = merge_once(docs, none, "o_orderkey", "layer", {"conf": "union"})
    return merged.select(
        "o_orderkey", map_text("conf").alias("conf"), F.array_join("applied", ",").alias("applied")
    )
