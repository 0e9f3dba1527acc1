"""Queries of joins, aggregations and set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from talkmill.operators import aggregate as agg
from talkmill.operators import joins
from talkmill.plans.catalog import query
from talkmill.plans.common import PRED, WIDE
from talkmill.shipping import ship
from talkmill.sources import workbooks
from talkmill.sources.adapters import predictions, table, wide_predictions

STATUS = ["F", "O", "P"]


@query("SELECT c_custkey, n_name, o.n_orders, round(coalesce(o.total, 0), 2) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def left_join_multi(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey", "left").join(orders, "c_custkey", "left")
    return out.select("c_custkey", "n_name", "n_orders", F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT o_orderkey, n_lines, round(qty, 2) AS qty FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def inner_join(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(ids, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_join(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(ids, "c_custkey", "left_anti")


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations e WHERE e.conv_id = c.conv_id AND e.turn = c.turn AND e.role = 'user')")
def anti_join_composite(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn").join(c.where("role = 'user'").select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")


@query(f"WITH {PRED} SELECT call_id, max(pred) FILTER (WHERE condition = 'A') AS p_a, max(pred) FILTER (WHERE condition = 'D') AS p_d FROM pred WHERE n = 5 AND ((condition = 'A' AND call_id % 3 > 0) OR (condition = 'D' AND call_id % 2 = 0)) GROUP BY call_id")
def outer_accumulate(spark, d):
    p = predictions(spark, d).where("n = 5")
    return joins.accumulate_outer({"p_a": p.where("condition = 'A' and call_id % 3 > 0"), "p_d": p.where("condition = 'D' and call_id % 2 = 0")}, "call_id", "pred")


@query(f"WITH {PRED} SELECT a.call_id, a.pred AS pred_a, b.pred AS pred_b FROM pred a JOIN pred b ON a.call_id = b.call_id AND a.n = 2 AND b.n = 2 AND a.condition = 'A' AND b.condition = 'B'")
def paired_conditions(spark, d):
    return joins.paired(predictions(spark, d).where("n = 2"), ["call_id"], "condition", "A", "B", "pred")


@query("SELECT a.o_orderkey, a.o_totalprice AS \"o_totalprice_A\", b.o_totalprice AS \"o_totalprice_B\" FROM orders a JOIN orders b USING (o_orderkey) WHERE b.o_orderstatus = 'O'")
def suffixed_join(spark, d):
    o = table(spark, d, "orders")
    return joins.suffixed(o.select("o_orderkey", "o_totalprice"), o.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("WITH s AS (SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1) SELECT c_custkey, coalesce(s.mean, (SELECT mean FROM s WHERE c_mktsegment = 'BUILDING')) AS mean FROM customer LEFT JOIN s USING (c_mktsegment)")
def lookup_default(spark, d):
    c = table(spark, d, "customer")
    s = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return joins.lookup_with_default(c.select("c_custkey", "c_mktsegment"), s, "c_mktsegment", "BUILDING").select("c_custkey", "mean")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1")
def first_row_dimension(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return joins.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def checked_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    o, c = joins.dealt(o.count(), ["o_custkey"], o, c)
    return joins.checked_left_join(o, c, ["o_custkey"]).select("o_orderkey", "c_mktsegment")


@query("SELECT l.l_orderkey, l.l_suppkey, l.n_lines, o.n_ids FROM (SELECT l_orderkey, l_suppkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey, l_suppkey) l LEFT JOIN (SELECT l_orderkey, l_suppkey, count(DISTINCT l_partkey) AS n_ids FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey, l_suppkey) o ON o.l_orderkey = l.l_orderkey AND o.l_suppkey = l.l_suppkey")
def left_join_composite(spark, d):
    rows, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"]
    lines, large = joins.dealt(rows.count(), keys, rows.select(*keys), rows.where("l_quantity > 25").select(*keys, "l_partkey"))
    large = large.groupBy(*keys).agg(F.countDistinct("l_partkey").alias("n_ids"))
    return joins.checked_left_join(lines.groupBy(*keys).agg(F.count("*").alias("n_lines")), large, keys)


@query("SELECT count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_only_a, count(*) FILTER (WHERE b AND NOT a) AS n_only_b FROM (SELECT i, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT c_custkey AS i, 1 AS s FROM customer UNION ALL SELECT o_custkey, 2 FROM orders) GROUP BY i)")
def id_set_compare(spark, d):
    return joins.same_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("i")), table(spark, d, "orders").select(F.col("o_custkey").alias("i")), "i")


@query("SELECT d.doc_id, l.quality, d.n_chars > 1000 AS expected FROM labels l JOIN documents d USING (doc_id) WHERE (l.quality = 1) <> (d.n_chars > 1000)")
def gold_consistency(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("expected")), "doc_id")
    return rows.where((F.col("quality") == 1) != F.col("expected")).select("doc_id", "quality", "expected")


@query("SELECT o_orderkey, pos, o_totalprice FROM orders JOIN (SELECT * FROM (VALUES (5, 1), (3, 2), (11, 3)) v(o_orderkey, pos)) USING (o_orderkey)")
def reselect_in_order(spark, d):
    ids = spark.createDataFrame([(5, 1), (3, 2), (11, 3)], "o_orderkey long, pos int")
    return joins.in_order(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.broadcast(ids), "o_orderkey").select("o_orderkey", "pos", "o_totalprice")


_RESULTS = ["F", "O", "P", "X"]


@query("SELECT v.value, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (SELECT count(*) FROM orders), 6) AS share FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS value) v LEFT JOIN (SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1) c USING (value)")
def value_counts_domain(spark, d):
    return agg.value_counts(table(spark, d, "orders"), "o_orderstatus", _RESULTS).select("value", "n", F.round("share", 6).alias("share"))


@query("SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\", count(*) AS \"ALL\" FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())")
def crosstab_margins(spark, d):
    return agg.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", STATUS, margins=True)


@query("SELECT conv_id, max(CASE WHEN turn = 0 THEN role END) AS t0, max(CASE WHEN turn = 1 THEN role END) AS t1 FROM conversations WHERE turn IN (0, 1) GROUP BY conv_id")
def pivot_first(spark, d):
    return table(spark, d, "conversations").where("turn in (0, 1)").groupBy("conv_id").pivot("turn", [0, 1]).agg(F.first("role", True)).toDF("conv_id", "t0", "t1")


@query("SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS o, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS p FROM orders GROUP BY 1")
def pivot_mean(spark, d):
    out = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", STATUS).agg(F.avg("o_totalprice")).toDF("o_orderpriority", "f", "o", "p")
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in "fop"])


@query("SELECT o_custkey, o_orderpriority AS top_priority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS i FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE i = 1")
def smallest_mode(spark, d):
    return agg.smallest_mode(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "top_priority")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.2), 4) AS q20, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.8), 4) AS q80 FROM lineitem GROUP BY 1")
def quantile_vector(spark, d):
    out = agg.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.2, 0.5, 0.8])
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q20", "q50", "q80")])


@query("SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, median(l_quantity) AS median, max(l_quantity) AS max FROM lineitem")
def describe_column(spark, d):
    return agg.summary(table(spark, d, "lineitem"), "l_quantity").select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "median", "max")


@query("SELECT l_returnflag, round(avg(l_discount - 0.05), 8) AS mean_shift, round(avg(abs(l_discount - 0.05)), 8) AS mean_abs_shift FROM lineitem GROUP BY 1")
def mean_and_mean_abs(spark, d):
    x = F.col("l_discount") - 0.05
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(x), 8).alias("mean_shift"), F.round(F.avg(F.abs(x)), 8).alias("mean_abs_shift"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1")
def arg_max(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_event, round(avg((l_returnflag = 'R')::INTEGER), 6) AS rate FROM lineitem GROUP BY 1")
def score_bucket_rates(spark, d):
    out = agg.bucket_rates(table(spark, d, "lineitem"), "l_linenumber", F.col("l_returnflag") == "R")
    return out.select("l_linenumber", "n", "n_event", F.round("rate", 6).alias("rate"))


@query(f"WITH {WIDE} SELECT a1 AS old, a5 AS new, count(*) AS n FROM wide WHERE a1 <> a5 GROUP BY ALL")
def label_transitions(spark, d):
    return agg.transitions(wide_predictions(spark, d), "a1", "a5")


@query(f"WITH {WIDE} SELECT call_id, len(list_distinct(list_filter([a1, a2, a3, a5], lambda v: v IS NOT NULL)))::INTEGER AS n_labels FROM wide")
def rowwise_distinct(spark, d):
    return wide_predictions(spark, d).select("call_id", agg.distinct_across(["a1", "a2", "a3", "a5"]).alias("n_labels"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_custkey END) AS n_large, bool_and(o_orderdate IS NOT NULL) AS all_dated FROM orders GROUP BY 1")
def distinct_counts(spark, d):
    large = F.when(F.col("o_totalprice") > 100000, F.col("o_custkey"))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n_customers"), F.countDistinct(large).alias("n_large"), F.bool_and(F.col("o_orderdate").isNotNull()).alias("all_dated"))


@query("SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY 1, 2")
def share_of_total(spark, d):
    out = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("t"))
    return out.select("o_orderpriority", "o_orderstatus", F.round(F.expr("t / sum(t) over (partition by o_orderpriority)"), 6).alias("share"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS phone FROM customer UNION ALL SELECT s_suppkey, s_name, 'none' FROM supplier")
def union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.lit("none").alias("phone"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'patched' ELSE o_orderpriority END AS label FROM orders")
def overlay_union(spark, d):
    o = table(spark, d, "orders")
    base = o.select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return joins.overlay(base, o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("patched").alias("label")), ["o_orderkey"])


@query(f"WITH {PRED} SELECT call_id, condition, n, CASE WHEN condition IN ('B', 'D') THEN gold ELSE pred END AS pred FROM pred WHERE n = 2")
def partial_overlay(spark, d):
    p = predictions(spark, d).where("n = 2")
    return joins.overlay(p.select("call_id", "condition", "n", "pred"), p.where("condition in ('B', 'D')").select("call_id", "condition", "n", F.col("gold").alias("pred")), ["call_id", "condition"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem) WHERE i = 1")
def dedup_on_key(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return joins.first_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def intersect_ids(spark, d):
    return table(spark, d, "orders").select("o_custkey").intersect(table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 40 AND l_returnflag <> 'N' GROUP BY 1, 2")
def filtered_aggregate(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_quantity").between(5, 40) & (F.col("l_returnflag") != "N"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_net"), F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT r_name || '.xlsx' AS path, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) + 1 AS row FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT path, 'nations' AS sheet, row, n_nationkey::VARCHAR || '|' || n_name AS line FROM n
UNION ALL SELECT DISTINCT path, 'nations', 1, 'n_nationkey|n_name' FROM n UNION ALL SELECT DISTINCT path, 'size', 1, 'rows' FROM n
UNION ALL SELECT path, 'size', 2, count(*)::VARCHAR FROM n GROUP BY path"""
)
def workbook_rows(spark, d):
    """A workbook a region, of two sheets, read again."""
    ship(spark)
    columns = ["n_nationkey", "n_name"]

    def make(pdf):
        rows = pdf.sort_values("n_nationkey")[columns].values.tolist()
        book = workbooks.workbook([(workbooks.Sheet("nations"), columns, rows), (workbooks.Sheet("size", hidden=True), ["rows"], [[len(rows)]])])
        return pd.DataFrame({"path": [f"{pdf['r_name'].iloc[0]}.xlsx"], "content": [book]})

    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    books = rows.select("r_name", *columns).groupBy("r_name").applyInPandas(make, "path string, content binary")
    found, _ = workbooks.parse_workbooks(books)
    return found.select("path", "sheet", "row", F.array_join("cells", "|", "").alias("line"))
