"""Queries of text cleaning, parsing and scanning."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import text as T
from talkmill.functions.tables import register_table_functions
from talkmill.operators import governance
from talkmill.plans.catalog import query
from talkmill.plans.common import LAB
from talkmill.sources.adapters import FOCUS, LABELS, table

#: Marks of every kind, whole and damaged, around what was said.
MARKED = ["((um)) x", " o/n/ I/ t/ go/ uh (wrng)/(", ") (won/(one) won)/(two) (a)/b) (noise) 0/  N/ end "]


def _marked():
    return F.concat(F.lit(MARKED[0]), "text", F.lit(MARKED[1]), "role", F.lit(MARKED[2]), "text")


_MARKED_SQL = f"'{MARKED[0]}' || text || '{MARKED[1]}' || role || '{MARKED[2]}' || text"
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _without_tags(text: str) -> str:
    """Twice, as a tag may stand right behind another."""
    once = "regexp_replace({}, '(^|[^A-Za-z])[onblipfhONBLIPFH]/', '\\1 ', 'g')"
    return once.format(once.format(text))


def _corrected(text: str, keep: str) -> str:
    """Form by form: whole pairs, then those with the first not closed, the second not opened, or both. A mark stands before each meant part."""
    for form in ("\\([^()/]*\\)/\\(([^()]*)\\)", "\\([^()/]*/\\(([^()]*)\\)", "\\([^()/]*\\)/([^()]*)\\)", "\\([^()/]*/([^()]*)\\)"):
        text = f"regexp_replace({text}, '{form}', '{keep}', 'g')"
    return text


def _cleaned(text: str) -> str:
    said = _corrected(_without_tags(f"regexp_replace({text}, '\\(\\(.*?\\)\\)+', ' ', 'g')"), "\\1")
    return f"trim(regexp_replace(regexp_replace(regexp_replace({said}, '\\([^()]*\\)', ' ', 'g'), '[()/]', ' ', 'g'), '{_SPACES}', ' ', 'g'), ' ')"


@query(f"WITH m AS (SELECT conv_id, turn, {_MARKED_SQL} AS t FROM conversations) SELECT conv_id, turn, {_cleaned('t')} AS cleaned, round(length({_cleaned('t')}) / nullif(length(t), 0), 6) AS length_ratio FROM m")
def clean_text(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", _marked().alias("t")).withColumn("cleaned", T.clean_text(F.col("t")))
    return rows.select("conv_id", "turn", "cleaned", F.round(T.length_ratio(F.col("cleaned"), F.col("t")), 6).alias("length_ratio"))


def _tags_sql(letters: str) -> str:
    """Tags directly behind another tag's slash are found by doubling the slashes."""
    return f"len(regexp_extract_all(replace(t, '/', '//'), '(?:^|[^A-Za-z])[{letters}{letters.upper()}]/'))::INTEGER"


@query(
    f"""WITH m AS (SELECT conv_id, turn, {_MARKED_SQL} AS t FROM conversations)
SELECT conv_id, turn, {_tags_sql('o')} AS n_o, {_tags_sql('n')} AS n_n, {_tags_sql('onblipfh')} AS n_tags, len(regexp_extract_all({_corrected('t', chr(7))}, '{chr(7)}'))::INTEGER AS n_corrections, regexp_matches(t, '\\(\\(') AS unintelligible FROM m"""
)
def tag_counts(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", _marked().alias("t"))
    t = F.col("t")
    return rows.select("conv_id", "turn", T.tag_count(t, "o").alias("n_o"), T.tag_count(t, "n").alias("n_n"), T.tag_total(t).alias("n_tags"), T.correction_count(t).alias("n_corrections"), t.rlike(r"\(\(").alias("unintelligible"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '[aeiou]'))::INTEGER AS n_syllables, round(len(regexp_extract_all(text, '[aeiou]')) / nullif(length(text) / 15.0, 0), 6) AS rate, length(text) <= 2 AS too_short FROM conversations")
def speaking_rate(spark, d):
    n = T.syllables(F.col("text"), "[aeiou]")
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("n_syllables"), F.round(n / F.nullif(F.length("text") / 15.0, F.lit(0.0)), 6).alias("rate"), T.too_short(F.col("text")).alias("too_short"))


@query("SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role END AS speaker_group, role AS stripped FROM conversations")
def speaker_groups(spark, d):
    name = F.concat("role", (F.col("turn") + 1).cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.speaker_group(name, ["user", "assistant"]).alias("speaker_group"), T.strip_number(name).alias("stripped"))


@query(f"SELECT o_orderkey, {LAB}[o_orderkey % 7 + 1] AS label, CASE WHEN {LAB}[o_orderkey % 7 + 1] = 'complaint' THEN 'service_use' ELSE {LAB}[o_orderkey % 7 + 1] END AS human FROM orders")
def label_normalize(spark, d):
    raw = F.concat(F.lit("  "), (F.col("o_orderkey") % 7 + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ". ").otherwise(") "), F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("o_orderkey") % 7 + 1).cast("int")), F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", T.normalise_label(raw).alias("label"), T.normalise_human_label(raw, "compl", "service_use").alias("human"))


_K = "(props::JSON->>'$.k')::INTEGER"


def _label(k):
    """A label by number, null for a null: element_at takes a null place for the last one here."""
    return F.when(k.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in LABELS]), k % 7 + 1))


_ANSWERS = [
    ('{"has_complaint": true, "label": "', '"}'),
    ('{"has_complaint": false, "label": "', '", "why": {"x": [1, 2]}}'),
    ('{"has_complaint": false, "label": "1. ', '"}'),
    ('{"has_complaint": "yes", "label": "', '"}'),
    ('{"has_complaint": false, "label": "', '"} and {more}'),
    ('{"has_complaint": null, "label": "', '"}'),
    ('{"label": "', '"}'),
    ("has_complaint: no, label: ", ""),
    ('{"has_complaint": null, "has_complaint": false, "label": "', '"}'),
    ('{"has_complaint": true, "sure": NaN, "label": "', '"}'),
]
_SAID_SQL = "'Answer:' || chr(10) || CASE i " + " ".join(f"WHEN {i} THEN '{a}' || label || '{b}'" for i, (a, b) in enumerate(_ANSWERS)) + " END || chr(10) || 'thanks'"


@query(
    f"""WITH k AS (SELECT event_id, {_K} AS k FROM events), l AS (SELECT event_id, k // 7 % 10 AS i, {LAB}[k % 7 + 1] AS label FROM k), s AS (SELECT event_id, replace(replace(regexp_extract({_SAID_SQL}, '(?s)\\{{.*\\}}'), 'null, "has_complaint": ', ''), ': NaN', ': 0') AS j FROM l),
p AS (SELECT event_id, coalesce(j <> '' AND CASE WHEN json_valid(j) THEN json_type(j, '$.has_complaint') = 'BOOLEAN' END, false) AS ok, j FROM s),
v AS (SELECT event_id, CASE WHEN ok THEN json_extract_string(j, '$.has_complaint') = 'true' END AS flag, CASE WHEN ok THEN json_extract_string(j, '$.label') END AS name FROM p)
SELECT event_id, flag, CASE WHEN flag THEN 'complaint' WHEN list_contains({LAB}, name) THEN name END AS label FROM v"""
)
def json_verdict_parse(spark, d):
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    label = _label(F.col("k"))
    bodies = F.array(*[F.concat(F.lit(a), label, F.lit(b)) for a, b in _ANSWERS])
    said = rows.select("event_id", F.concat(F.lit("Answer:\n"), F.element_at(bodies, F.floor(F.col("k") / 7).cast("int") % 10 + 1), F.lit("\nthanks")).alias("said"))
    v = T.parse_verdict(F.col("said"), "has_complaint", "label", LABELS, FOCUS)
    return said.select("event_id", v.alias("v")).select("event_id", "v.flag", "v.label")


_TAGGED = "CASE k % 5 WHEN 0 THEN 'so <c>' || label || '</c> or <c>x</c><f>' || k || ' </f>' WHEN 1 THEN '<c>' || chr(10) || '2. ' || label || chr(10) || '</c>' WHEN 2 THEN '<c>weather</c>' WHEN 3 THEN CASE WHEN k % 2 = 0 THEN ' ' END ELSE label END"
_STRIP = r"'^\s+|\s+$', '', 'g'"


@query(
    f"""WITH k AS (SELECT event_id, {_K} AS k FROM events), l AS (SELECT event_id, k, {LAB}[k % 7 + 1] AS label FROM k), t AS (SELECT event_id, {_TAGGED} AS t FROM l),
x AS (SELECT event_id, t, regexp_matches(t, '(?s)<c>.*?</c>') AS has, regexp_replace(regexp_replace(regexp_extract(t, '(?s)<c>(.*?)</c>', 1), '^\\s*\\d+[.)]\\s*', ''), {_STRIP}) AS label, regexp_replace(regexp_extract(t, '(?s)<f>(.*?)</f>', 1), {_STRIP}) AS f FROM t)
SELECT event_id, CASE WHEN list_contains({LAB}, label) THEN label END AS label, CASE WHEN t IS NULL THEN 'no response' WHEN NOT has THEN 'tag missing' WHEN NOT list_contains({LAB}, label) THEN 'out of domain' END AS error, CASE WHEN list_contains({LAB}, label) AND contains(t, '<f>') THEN f END AS f FROM x"""
)
def tag_parse(spark, d):
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, label = F.col("k"), _label(F.col("k"))
    text = F.when(k % 5 == 0, F.concat(F.lit("so <c>"), label, F.lit("</c> or <c>x</c><f>"), k.cast("string"), F.lit(" </f>"))).when(k % 5 == 1, F.concat(F.lit("<c>\n2. "), label, F.lit("\n</c>"))).when(k % 5 == 2, F.lit("<c>weather</c>")).when(k % 5 == 4, label).when(k % 2 == 0, F.lit(" "))
    return rows.select("event_id", text.alias("t")).select("event_id", T.parse_tagged(F.col("t"), "c", LABELS, "f").alias("v")).select("event_id", "v.*")


_SCORED = "CASE WHEN k % 9 = 7 THEN ' ' WHEN k % 9 = 8 THEN '<kind>3</kind> only' WHEN k % 18 = 5 THEN '<kind>-1</kind> and <fit>2</fit>' ELSE '<kind> ' || (k % 9) || ' </kind> and <fit>' || (k % 4 + 2) || '</fit>' END"


@query(
    f"""WITH k AS (SELECT event_id, {_K} AS k FROM events), t AS (SELECT event_id, {_SCORED} AS t FROM k), x AS (SELECT event_id, t, regexp_extract(t, '<kind>\\s*(\\d+)\\s*</kind>', 1) AS a, regexp_extract(t, '<fit>\\s*(\\d+)\\s*</fit>', 1) AS b FROM t),
y AS (SELECT *, coalesce(try_cast(a AS INTEGER) BETWEEN 1 AND 5 AND try_cast(b AS INTEGER) BETWEEN 1 AND 5, false) AS ok FROM x)
SELECT event_id, CASE WHEN ok THEN a::INTEGER END AS kind, CASE WHEN ok THEN b::INTEGER END AS fit,
CASE WHEN NOT regexp_matches(t, '\\S') THEN 'empty' WHEN a = '' OR b = '' THEN 'missing: ' || concat_ws(',', CASE WHEN a = '' THEN 'kind' END, CASE WHEN b = '' THEN 'fit' END) WHEN NOT ok THEN 'out of range: kind=' || a || ', fit=' || b END AS error FROM y"""
)
def two_score_parse(spark, d):
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")
    text = F.when(k % 9 == 7, " ").when(k % 9 == 8, "<kind>3</kind> only").when(k % 18 == 5, "<kind>-1</kind> and <fit>2</fit>").otherwise(F.concat(F.lit("<kind> "), (k % 9).cast("string"), F.lit(" </kind> and <fit>"), (k % 4 + 2).cast("string"), F.lit("</fit>")))
    return rows.select("event_id", text.alias("t")).select("event_id", T.parse_scores(F.col("t"), ["kind", "fit"]).alias("v")).select("event_id", "v.*")


@query(
    f"""WITH k AS (SELECT user_id, event_id, {_K} AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), t AS (SELECT user_id, event_id, k, {_SCORED} AS t FROM k),
x AS (SELECT *, regexp_extract(t, '<kind>\\s*(\\d+)\\s*</kind>', 1) AS a, regexp_extract(t, '<fit>\\s*(\\d+)\\s*</fit>', 1) AS b FROM t),
y AS (SELECT *, coalesce(try_cast(a AS INTEGER) BETWEEN 1 AND 5 AND try_cast(b AS INTEGER) BETWEEN 1 AND 5, false) AS ok FROM x)
SELECT user_id, event_id, CASE WHEN ok THEN a::INTEGER END AS kind, CASE WHEN ok THEN b::INTEGER END AS fit, CASE WHEN NOT regexp_matches(t, '\\S') THEN 'empty'
WHEN a = '' OR b = '' THEN 'missing: ' || concat_ws(',', CASE WHEN a = '' THEN 'kind' END, CASE WHEN b = '' THEN 'fit' END) WHEN NOT ok THEN 'out of range: kind=' || a || ', fit=' || b END AS error FROM y"""
)
def newest_scores_from_sql(spark, d):
    register_table_functions(spark)
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.when(k % 9 == 7, " ").when(k % 9 == 8, "<kind>3</kind> only").when(k % 18 == 5, "<kind>-1</kind> and <fit>2</fit>").otherwise(F.concat(F.lit("<kind> "), (k % 9).cast("string"), F.lit(" </kind> and <fit>"), (k % 4 + 2).cast("string"), F.lit("</fit>")))
    answers = table(spark, d, "events").select("user_id", "event_id", text.alias("response"))
    return spark.sql(
        "SELECT user_id, event_id, kind, fit, error FROM parse_answers(TABLE({answers}), kind => 'scores', tags => array('kind', 'fit'), request => 'user_id', batch => 'event_id')", answers=answers
    )


@query(
    """SELECT 'J_' || conv_id AS call_id, 'J' AS j_code, conv_id::VARCHAR AS s_code, 'talk' AS category, role AS speaker_type, i AS dialog_idx, CASE i WHEN 0 THEN turn / 2.0::DOUBLE END AS duration, CASE i WHEN 0 THEN text ELSE role END AS text
FROM conversations, (VALUES (0), (1)) v(i)"""
)
def utterances_from_sql(spark, d):
    register_table_functions(spark)
    speakers = F.array(F.struct(F.lit("s").alias("id"), F.lit("first of equal ids").alias("type")), F.struct(F.lit("s").alias("id"), F.col("role").alias("type")))
    said = F.struct(F.lit("s").alias("speaker"), (F.col("turn") / 2).alias("duration"), F.col("text").alias("text"))
    named = F.struct(F.lit("s").alias("speaker"), F.lit(None).cast("double").alias("duration"), F.col("role").alias("text"))
    data = F.struct(F.struct(F.lit("talk").alias("category"), speakers.alias("speakers")).alias("typeInfo"), F.array(said, named).alias("dialogs"))
    records = table(spark, d, "conversations").select(F.format_string("calls/J/%1$s/%1$s.json", F.col("conv_id").cast("string")).alias("path"), F.to_json(F.struct(data.alias("dataSet"))).alias("value"))
    return spark.sql("SELECT call_id, j_code, s_code, category, speaker_type, dialog_idx, duration, text FROM call_utterances(TABLE({records}))", records=records)


_WORDS = ["token", "license", "the ", "http"]


@query("WITH h AS (SELECT doc_id, list_filter(['token', 'license', 'the ', 'http'], lambda k: contains(text, k)) AS hits FROM documents) SELECT doc_id, len(hits)::INTEGER AS n_hits, array_to_string(hits, '|') AS joined FROM h")
def keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", T.keyword_hits(F.col("text"), _WORDS).alias("hits")).select("doc_id", F.size("hits").alias("n_hits"), F.array_join("hits", "|").alias("joined"))


@query("SELECT lang, round(avg(contains(text, 'token')::INTEGER), 6) AS token, round(avg(contains(text, 'license')::INTEGER), 6) AS license, count(*) AS n FROM documents GROUP BY lang")
def keyword_rates(spark, d):
    rate = lambda w: F.round(F.avg(F.contains("text", F.lit(w)).cast("int")), 6).alias(w)
    return table(spark, d, "documents").groupBy("lang").agg(rate("token"), rate("license"), F.count("*").alias("n"))


@query("SELECT doc_id, md5(replace(text, chr(10), ' / ')) AS line_md5 FROM documents")
def one_line_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.one_line(F.col("text")).cast("binary")).alias("line_md5"))


@query("WITH c AS (SELECT 'html' AS column_name, html AS cell FROM pages UNION ALL SELECT 'url', url FROM pages) SELECT column_name, count(*) FILTER (WHERE length(cell) > 60 AND regexp_matches(cell, 'the ')) AS n_suspect, max(length(cell))::INTEGER AS longest FROM c GROUP BY 1")
def leak_scan(spark, d):
    return governance.leak_scan(table(spark, d, "pages"), ["html", "url"], "the ")


@query(r"SELECT doc_id, pattern FROM (SELECT doc_id, unnest(['table', 'heading', 'email']) AS pattern, unnest([regexp_matches(text, ' \| '), regexp_matches(text, '###'), regexp_matches(text, '[A-Za-z]@[A-Za-z]')]) AS hit FROM documents) WHERE hit")
def markdown_scan(spark, d):
    return governance.pattern_scan(table(spark, d, "documents"), "doc_id", "text", {"table": r" \| ", "heading": "###", "email": "[A-Za-z]@[A-Za-z]"})


@query("SELECT conv_id, turn, ((role = 'user')::INTEGER) AS in_head, (contains(text, 'the')::INTEGER + contains(text, 'user')::INTEGER) AS in_transcript FROM conversations")
def prompt_leak_check(spark, d):
    prompt = F.concat(F.when(F.col("role") == "user", "about the rest").otherwise("about it"), F.lit(" [CALL] "), "text")
    head, tail = governance.prompt_leak(prompt, "[CALL]", ["the", "user"])
    return table(spark, d, "conversations").select("conv_id", "turn", head.alias("in_head"), tail.alias("in_transcript"))


@query("SELECT o_orderkey, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 9) AS h FROM (SELECT o_orderkey, (o_orderkey % 9 + 0.5)::DOUBLE / 10 AS p FROM orders)")
def probability_entropy(spark, d):
    p = (F.col("o_orderkey") % 9 + 0.5) / 10
    return table(spark, d, "orders").select("o_orderkey", F.round(T.entropy(F.array(p, 1 - p)), 9).alias("h"))


@query(
    f"""WITH k AS (SELECT event_id, {_K} AS k FROM events), t AS (SELECT event_id, 'rated 7 or ' || (k % 5) || ' of 9' AS digit, {LAB}[k % 7 + 1] || repeat(' ', 120) || CASE WHEN k % 2 = 0 THEN 'service_use' ELSE '' END AS said,
CASE k % 4 WHEN 0 THEN 'answer: ' || {LAB}[k % 7 + 1] || ', not refund_request' WHEN 1 THEN 'refund_request? <c> ' || {LAB}[k % 7 + 1] || ' </c>' WHEN 2 THEN 'refund_request <' || {LAB}[k % 7 + 1] || '>' ELSE 'it is ' || {LAB}[k % 7 + 1] END AS told,
CASE WHEN k % 3 = 0 THEN 'Keep' ELSE 'revert' END AS verdict FROM k),
m AS (SELECT *, regexp_extract(told, 'answer\\s*[:：]\\s*(\\w+)', 1) AS strict, regexp_extract(told, '(?s)<c>\\s*(.+?)\\s*</c>', 1) AS tagged FROM t)
SELECT event_id, try_cast(regexp_extract(digit, '[0-4]') AS INTEGER) AS digit, list_filter({LAB}, lambda x: contains(said, x))[1] AS anywhere,
coalesce(list_filter({LAB}, lambda x: contains(right(said, 100), x))[1], list_filter({LAB}, lambda x: contains(said, x))[1]) AS tail,
coalesce(CASE WHEN list_contains({LAB}, strict) THEN strict END, CASE WHEN list_contains({LAB}, tagged) THEN tagged END, list_filter({LAB}, lambda x: contains(told, '<' || x || '>'))[1], list_filter({LAB}, lambda x: contains(told, x))[1]) AS told, upper(verdict) AS verdict FROM m"""
)
def fallback_parsers(spark, d):
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")
    label = _label(k)
    digit = F.concat(F.lit("rated 7 or "), (k % 5).cast("string"), F.lit(" of 9"))
    said = F.concat(label, F.lit(" " * 120), F.when(k % 2 == 0, F.lit("service_use")).otherwise(F.lit("")))
    told = F.when(k % 4 == 0, F.concat(F.lit("answer: "), label, F.lit(", not refund_request"))).when(k % 4 == 1, F.concat(F.lit("refund_request? <c> "), label, F.lit(" </c>"))).when(k % 4 == 2, F.concat(F.lit("refund_request <"), label, F.lit(">"))).otherwise(F.concat(F.lit("it is "), label))
    verdict = F.concat(F.lit("So I would "), F.when(k % 3 == 0, "Keep").otherwise("revert"), F.lit(" it."))
    rows = rows.select("event_id", digit.alias("d"), said.alias("s"), told.alias("t"), verdict.alias("v"))
    return rows.select("event_id", T.first_digit(F.col("d")).alias("digit"), T.contained_label(F.col("s"), LABELS).alias("anywhere"), T.tail_label(F.col("s"), LABELS).alias("tail"), T.answer_label(F.col("t"), LABELS).alias("told"), T.keep_or_revert(F.col("v")))


@query(r"SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\f\r]'), lambda w: ceil(length(w) / 4.0)::INTEGER)), 0)::INTEGER AS n_tokens FROM documents")
def token_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.approximate_tokens(F.col("text")), F.lit(0)).alias("n_tokens"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(text, 'http') AND NOT (contains(text, 'token') OR contains(text, 'license'))) AS n_only_http, round(count(*) FILTER (WHERE contains(text, 'http') AND NOT (contains(text, 'token') OR contains(text, 'license'))) * 100 / count(*), 2) AS only_http, round(count(*) FILTER (WHERE contains(text, 'token') OR contains(text, 'license')) * 100 / count(*), 2) AS named FROM documents GROUP BY lang")
def keyword_boundary(spark, d):
    has = lambda w: F.coalesce(F.contains("text", F.lit(w)), F.lit(False))
    named = has("token") | has("license")
    share = lambda n: F.round(n * 100 / F.count("*"), 2)
    only = F.count_if(has("http") & ~named)
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), only.alias("n_only_http"), share(only).alias("only_http"), share(F.count_if(named)).alias("named"))
