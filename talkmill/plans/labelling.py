"""Queries of label fusion, chunk planning, job states and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.functions.nulls import half_even
from talkmill.operators import aggregate as agg
from talkmill.operators import batching, governance, joins, policy, requests
from talkmill.operators import metrics as M
from talkmill.plans.catalog import query
from talkmill.plans.common import LAB, WIDE
from talkmill.shipping import ship
from talkmill.sources import provider, sinks
from talkmill.sources.adapters import FOCUS, LABELS, table, wide_predictions

_FUSE = f"""{WIDE}, g AS (SELECT call_id, call_id % 3 = 0 AS has_focus, a3 AS gate_label FROM wide WHERE call_id % 4 > 0), r AS (SELECT call_id, a5 AS refined_label FROM wide WHERE call_id % 5 > 0)"""


def _passes(spark, d):
    w = wide_predictions(spark, d)
    base = w.select("call_id", F.col("gold").alias("label"))
    gate = w.where("call_id % 4 > 0").select("call_id", (F.col("call_id") % 3 == 0).alias("has_focus"), F.col("a3").alias("gate_label"))
    return base, gate, w.where("call_id % 5 > 0").select("call_id", F.col("a5").alias("refined_label"))


@query(
    f"""WITH {_FUSE} SELECT w.call_id, CASE WHEN has_focus THEN 'complaint' WHEN has_focus = false THEN coalesce(refined_label, gate_label) ELSE gold END AS label,
CASE WHEN has_focus THEN 'gate' WHEN has_focus = false THEN 'refined' ELSE 'base' END AS source
FROM wide w LEFT JOIN g USING (call_id) LEFT JOIN r USING (call_id)"""
)
def label_fusion(spark, d):
    return policy.fuse_labels(*_passes(spark, d), "call_id", FOCUS)


@query(f"WITH {_FUSE} SELECT w.call_id, gold AS label FROM wide w JOIN g USING (call_id) WHERE gold IN ('refund_request', 'delivery_check') AND has_focus = false")
def relabel_targets(spark, d):
    base, gate, _ = _passes(spark, d)
    return policy.relabel_targets(base, gate, "call_id", ["refund_request", "delivery_check"])


@query(f"WITH {WIDE} SELECT call_id, coalesce(a5, b5, c5) AS label, CASE WHEN a5 IS NOT NULL THEN 'v4' WHEN b5 IS NOT NULL THEN 'v3' WHEN c5 IS NOT NULL THEN 'v2' END AS source FROM wide")
def label_fallback(spark, d):
    label, source = policy.fallback_label({"v4": "a5", "v3": "b5", "v2": "c5"})
    return wide_predictions(spark, d).select("call_id", label.alias("label"), source.alias("source"))


@query("SELECT doc_id, CASE WHEN quality >= 1 THEN 'good' ELSE 'bad' END AS quality_group, CASE WHEN quality = 1 AND toxic = 1 THEN 'kept' WHEN quality = 1 THEN 'resolved' WHEN toxic = 1 THEN 'newly_arisen' ELSE 'none' END AS status FROM labels")
def quality_split(spark, d):
    rows = table(spark, d, "labels")
    return rows.select("doc_id", policy.quality_split(F.col("quality"), 1).alias("quality_group"), policy.delta_status(F.col("quality") == 1, F.col("toxic") == 1).alias("status"))


_CHUNK_SQL = """WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
f AS (SELECT i, doc_id, n_chars AS total, 0 AS chunk FROM o WHERE i = 1 UNION ALL
SELECT o.i, o.doc_id, CASE WHEN f.total + o.n_chars > 20000 THEN o.n_chars ELSE f.total + o.n_chars END, CASE WHEN f.total + o.n_chars > 20000 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN o ON o.i = f.i + 1)"""


def _chunks(spark, d):
    return requests.greedy_chunks(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 20_000)


@query(f"{_CHUNK_SQL} SELECT f.doc_id, o.n_chars, chunk FROM f JOIN o USING (doc_id)")
def greedy_chunks(spark, d):
    return _chunks(spark, d)


def _chunk_table(spark, d):
    c = _chunks(spark, d).groupBy(F.col("chunk").alias("index")).agg(F.count("*").alias("n_requests"), F.sum("n_chars").alias("n_tokens"))
    status = F.when(F.col("index") % 5 == 0, "completed").when(F.col("index") % 5 == 1, "submitted").otherwise("pending")
    return c.withColumns({"status": status, "retries": (F.col("index") % 4).cast("int")})


_STATES = f"""{_CHUNK_SQL}, c AS (SELECT chunk AS index, count(*) AS n_requests, sum(o.n_chars)::BIGINT AS n_tokens, CASE chunk % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'submitted' ELSE 'pending' END AS status, (chunk % 4)::INTEGER AS retries FROM f JOIN o USING (doc_id) GROUP BY chunk)"""


@query(f"{_STATES} SELECT index, n_tokens, running FROM (SELECT *, (sum(n_tokens) OVER (ORDER BY index))::BIGINT AS running FROM c WHERE status = 'pending') WHERE running <= 150000")
def admission_prefix(spark, d):
    return batching.admit(_chunk_table(spark, d), 200_000, 50_000).select("index", "n_tokens", "running")


@query(
    f"""{_STATES} SELECT index, CASE index % 3 WHEN 0 THEN 'completed' WHEN 1 THEN CASE WHEN retries + 1 > 2 THEN 'failed_permanent' ELSE 'pending' END ELSE status END AS status, (retries + (index % 3 = 1)::INTEGER)::INTEGER AS retries FROM c"""
)
def chunk_state_machine(spark, d):
    c = _chunk_table(spark, d)
    events = c.where("index % 3 < 2").select("index", F.when(F.col("index") % 3 == 0, "completed").otherwise("failed").alias("outcome"))
    return batching.advance(c, events).select("index", "status", "retries")


@query("SELECT o_custkey AS index, o_orderkey AS batch_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1")
def latest_batch_per_chunk(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("index"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("batch_id"))
    return batching.latest_batch(rows).select("index", "batch_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'error_file' ELSE 'silently_lost' END AS reason FROM orders WHERE o_orderkey % 10 IN (3, 4)")
def dead_letter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return batching.dead_letters(o, o.where("o_orderkey % 10 not in (3, 4)"), o.where("o_orderkey % 10 = 3"), "o_orderkey")


@query("SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 2 = 0 AND turn < 3)")
def resume_extraction(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return batching.still_to_do(c, c.where("conv_id % 2 = 0 and turn < 3"), ["conv_id", "turn"])


@query("SELECT count(*) FILTER (WHERE doc_id % 7 > 0 AND doc_id % 11 > 0) AS n_equal, count(*) FILTER (WHERE doc_id % 7 = 0 AND doc_id % 11 > 0) AS n_different, count(*) FILTER (WHERE doc_id % 11 = 0) AS n_missing FROM documents")
def request_equality(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    other = t.where("doc_id % 11 > 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return requests.byte_equal(t, other, "doc_id", "text")


@query("SELECT conv_id, turn, 'EN: ' || text AS text, 'share of silence: ' || CASE turn % 3 WHEN 0 THEN 'usual' WHEN 1 THEN 'above usual' ELSE 'far above usual' END AS note FROM conversations")
def bilingual_switch(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    cache = c.select("text").distinct().withColumn("translation", F.concat(F.lit("EN: "), "text"))
    level = F.when(F.col("turn") % 3 == 0, None).when(F.col("turn") % 3 == 1, "high").otherwise("very_high")
    note = T.describe_levels({"s_top_db30": level}, T.level_phrases("en")).alias("note")
    return requests.translated(c, cache, "text", "text2").select("conv_id", "turn", F.col("text2").alias("text"), note)


@query(f"WITH {WIDE} SELECT c AS column_name, count(*) FILTER (WHERE v IS NULL) AS n_missing, round(avg((v IS NULL)::INTEGER), 6) AS share_missing FROM (SELECT unnest(['a1', 'd5']) AS c, unnest([a1, d5]) AS v FROM wide) GROUP BY c")
def missing_report(spark, d):
    return governance.missing_report(wide_predictions(spark, d), ["a1", "d5"]).select("column_name", "n_missing", F.round("share_missing", 6).alias("share_missing"))


@query("SELECT 'labels' AS table_name, count(*) AS n_ids, count(l.doc_id) AS n_covered FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'long', count(*), count(*) FILTER (WHERE n_chars > 1000) FROM documents")
def coverage_check(spark, d):
    docs = table(spark, d, "documents")
    return governance.coverage(docs, {"labels": table(spark, d, "labels"), "long": docs.where("n_chars > 1000")}, "doc_id")


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'a%' THEN 'early' WHEN p_name LIKE 'p%' THEN 'middle' ELSE 'other' END AS stage FROM part")
def prefix_classes(spark, d):
    return table(spark, d, "part").select("p_partkey", governance.classify_by_prefix(F.col("p_name"), {"a": "early", "p": "middle"}).alias("stage"))


@query(f"WITH {WIDE} SELECT segment, count(*) FILTER (WHERE d5 IS NULL) AS no_response, count(*) FILTER (WHERE d5 IS NOT NULL AND NOT list_contains({LAB}[1:6], d5)) AS out_of_domain, count(*) AS n FROM wide GROUP BY segment")
def parse_failures(spark, d):
    return wide_predictions(spark, d).groupBy("segment").agg(F.count_if(F.col("d5").isNull()).alias("no_response"), F.count_if(~F.col("d5").isin(LABELS[:6])).alias("out_of_domain"), F.count("*").alias("n"))


@query(f"WITH {WIDE} SELECT gold, count(DISTINCT CASE WHEN a5 <> c5 THEN call_id END) AS n_changed, count(DISTINCT call_id) AS n_calls FROM wide GROUP BY gold")
def level_change(spark, d):
    changed = F.when(F.col("a5") != F.col("c5"), F.col("call_id"))
    return wide_predictions(spark, d).groupBy("gold").agg(F.countDistinct(changed).alias("n_changed"), F.countDistinct("call_id").alias("n_calls"))


@query(f"WITH {WIDE} SELECT segment, " + ", ".join(f"count(*) FILTER (WHERE tokens % 5 + 1 = {i}) AS s{i}" for i in range(1, 6)) + " FROM wide GROUP BY segment")
def score_distribution(spark, d):
    rows = wide_predictions(spark, d)
    return rows.groupBy("segment").agg(*[F.count_if(F.col("tokens") % 5 + 1 == i).alias(f"s{i}") for i in range(1, 6)])


@query(f"WITH {WIDE} SELECT call_id, coalesce(a5 <> gold AND d5 = gold, false) AS saved, coalesce(a5 = gold AND d5 <> gold, false) AS ruined FROM wide")
def voice_effect(spark, d):
    kind = M.change_class(F.col("gold"), F.col("a5"), F.col("d5"))
    both = F.col("a5").isNotNull() & F.col("d5").isNotNull()
    return wide_predictions(spark, d).select("call_id", (both & (kind == "improved")).alias("saved"), (both & (kind == "worsened")).alias("ruined"))


#: A JSON string of ``text`` as DuckDB writes it.
_JSON_TEXT = "to_json(text)::VARCHAR"


@query(f"SELECT md5('{{\"custom_id\":\"' || conv_id || '::A::N' || turn || '\",\"method\":\"POST\",\"url\":\"/v1/chat\",\"body\":{{\"model\":\"m\",\"temperature\":0,\"messages\":[{{\"role\":\"user\",\"content\":' || {_JSON_TEXT} || '}}]}}}}') AS line_md5, conv_id, turn FROM conversations")
def request_lines(spark, d):
    rows = table(spark, d, "conversations").withColumns({"custom_id": requests.custom_id(F.col("conv_id").cast("string"), F.lit("A"), F.concat(F.lit("N"), F.col("turn").cast("string"))), "prompt": F.col("text")})
    lines = sinks.request_lines(rows, "m", "/v1/chat")
    back = F.get_json_object("value", "$.custom_id")
    return lines.select(F.md5(F.col("value").cast("binary")).alias("line_md5"), F.split_part(back, F.lit("::"), F.lit(1)).cast("long").alias("conv_id"), F.regexp_extract(back, r"N(\d+)$", 1).cast("long").alias("turn"))


@query(f"SELECT md5('{{\"messages\":[' || string_agg('{{\"role\":\"' || role || '\",\"content\":' || {_JSON_TEXT} || '}}', ',' ORDER BY turn) || '],\"audios\":[' || coalesce(string_agg('\"' || conv_id || '_' || turn || '.wav\"', ',' ORDER BY turn) FILTER (WHERE role = 'user'), '') || ']}}') AS line_md5 FROM conversations GROUP BY conv_id")
def chat_lines(spark, d):
    rows = table(spark, d, "conversations").withColumn("wav", F.when(F.col("role") == "user", F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".wav"))))
    return sinks.chat_lines(rows, ["conv_id"], "turn", "role", "text", "wav").select(F.md5(F.col("value").cast("binary")).alias("line_md5"))


@query(f"SELECT o_orderkey, {LAB}[('0x' || md5('order ' || o_orderkey)[1:8])::BIGINT % 7 + 1] AS label FROM orders")
def provider_labels(spark, d):
    ship(spark)
    asked = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("custom_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("prompt"))
    got = provider.label(asked, provider.OfflineProvider(LABELS, fail_every=50))
    return got.select(F.col("custom_id").cast("long").alias("o_orderkey"), T.parse_tagged(F.col("response"), "c", LABELS)["label"].alias("label"))


@query(f"WITH {WIDE}, th AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS threshold), s AS (SELECT threshold, 2 * count(*) FILTER (WHERE proba >= threshold AND gold = 'complaint') / (count(*) FILTER (WHERE proba >= threshold) + count(*) FILTER (WHERE gold = 'complaint')) AS f1 FROM wide, th GROUP BY threshold) SELECT threshold, round(f1, 6) AS f1 FROM s ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    swept = M.threshold_sweep(wide_predictions(spark, d), "proba", F.col("gold") == FOCUS, [0.2, 0.4, 0.6, 0.8])
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")
    return swept.agg(best).select("b.threshold", F.round("b.f1", 6).alias("f1"))


@query(
    f"""WITH {_FUSE}, f AS (SELECT w.call_id, gold AS v2, CASE WHEN has_focus THEN 'complaint' WHEN has_focus = false THEN gate_label ELSE gold END AS v4, CASE WHEN has_focus THEN 'complaint' WHEN has_focus = false THEN coalesce(refined_label, gate_label) ELSE gold END AS v5 FROM wide w LEFT JOIN g USING (call_id) LEFT JOIN r USING (call_id)),
c AS (SELECT unnest({LAB}) AS label) SELECT label, (SELECT count(*) FROM f WHERE v2 = label) AS n_v2, (SELECT count(*) FROM f WHERE v4 = label) AS n_v4, (SELECT count(*) FROM f WHERE v5 = label) AS n_v5,
round_even((SELECT count(*) FROM f WHERE v2 = label) / (SELECT count(v2) FROM f) * 100 * 100, 0) / 100 AS share_v2, round_even((SELECT count(*) FROM f WHERE v4 = label) / (SELECT count(v4) FROM f) * 100 * 100, 0) / 100 AS share_v4, round_even((SELECT count(*) FROM f WHERE v5 = label) / (SELECT count(v5) FROM f) * 100 * 100, 0) / 100 AS share_v5 FROM c"""
)
def version_distribution(spark, d):
    base, gate, refined = _passes(spark, d)
    v4 = policy.fuse_labels(base, gate, refined.where("false"), "call_id", FOCUS)
    v5 = policy.fuse_labels(base, gate, refined, "call_id", FOCUS)
    sets = {"v2": base, "v4": v4, "v5": v5}
    return agg.distributions({n: df.select("label") for n, df in sets.items()}, "label", LABELS).select("label", *[f"n_{n}" for n in sets], *[half_even(F.col(f"share_{n}") * 100, 2).alias(f"share_{n}") for n in sets])


@query("SELECT conv_id, md5(CASE turn % 3 WHEN 0 THEN 'Q1 ' || text WHEN 1 THEN CASE WHEN role = 'user' THEN 'mind the tone. ' ELSE '' END || 'Q2 ' || text ELSE 'Q3 ' || CASE WHEN role = 'user' THEN 'short. ' ELSE '' END || text END) AS prompt_md5, turn FROM conversations")
def prompt_versions(spark, d):
    c = table(spark, d, "conversations")
    version = F.concat(F.lit("v"), (F.col("turn") % 3).cast("string"))
    prompt = requests.versioned({"v0": "Q1 {call}", "v1": "{guide}Q2 {call}", "v2": "Q3 {guide}{call}"}, version, {"v1": "mind the tone. ", "v2": "short. "}, F.col("role") == "user", call=F.col("text"))
    return c.select("conv_id", F.md5(prompt.cast("binary")).alias("prompt_md5"), "turn")


@query("SELECT doc_id, 2::INTEGER AS n_changed, (CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END)::INTEGER AS n_structural FROM documents")
def variant_structure(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    head = F.when(F.col("doc_id") % 3 == 0, "task").otherwise("said")
    make = lambda word: t.withColumn("text", F.concat_ws("\n", F.lit("rules"), F.concat(head, F.lit(f": {word} "), F.col("doc_id").cast("string")), F.lit("end")))
    return requests.structure_diff(make("one"), make("two"), "doc_id", "text", ["said"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (3, 4) THEN NULL ELSE 'r' || o_orderkey END AS response, 'order ' || o_orderkey AS prompt FROM orders")
def reattach_metadata(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("custom_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("prompt"))
    got = o.where("o_orderkey % 10 not in (3, 4)").select("custom_id", F.concat(F.lit("r"), "custom_id").alias("response"))
    return joins.reattach(got, o).select("o_orderkey", "response", "prompt")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def publish_strip(spark, d):
    c = table(spark, d, "customer")
    return governance.strip_columns(c.select(*joins.columns_ending(c, "key"), "c_name", "c_address", "c_mktsegment") if "c_address" in c.columns else c, ["c_address", "c_phone", "c_acctbal", "c_comment", "c_nationkey"]).select("c_custkey", "c_name", "c_mktsegment")
