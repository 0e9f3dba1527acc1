"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides train two models, one of allowed and one of blocked
URLs: Markov models of variable order with Witten-Bell smoothing, where each
context mixes its own estimate with that of the context one character shorter,
and contexts never seen fall through to it. A URL's score is the difference of
its two log-likelihoods per character. The threshold is calibrated on a fifth of
the decided URLs that the models don't see, at the best balanced accuracy.

DataFrame functions only. URLs are exploded to (context, next character) grams;
everything after that works on the distinct grams. Log-ratios are kept as whole
millionths, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import join_hot, materialise

ORDER = 4
#: Width of a calibration bin, in millionths of a nat per character, and the outermost bins.
BIN, FARTHEST = 10_000, 1_000
HELD_OUT = 5

RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null; equally long ones by name."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=False):
        site, _, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _grams(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per character (and the end) with its context: the last ORDER characters."""
    padded = F.concat(F.lit("^" * ORDER), F.coalesce("url", F.lit("")), F.lit("$"))
    chars = F.filter(F.split(padded, ""), lambda c: c != "")
    rows = pages.select(*keep, chars.alias("chars"))
    each = F.transform(F.sequence(F.lit(1), F.size("chars") - ORDER), lambda i: F.array_join(F.slice("chars", i, ORDER + 1), ""))
    return rows.select(*keep, F.explode(each).alias("gram"))


def _models(grams: DataFrame) -> DataFrame:
    """(gram, llr) for the distinct grams (gram, a, b): counts in allowed and blocked URLs."""
    level = grams
    counts = {ORDER: grams}
    for d in range(ORDER - 1, -1, -1):
        level = level.groupBy(F.expr(f"right(gram, {d + 1})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        counts[d] = level
    spread = counts[0].count() + 1  # distinct characters and one never seen
    known = None
    for d in range(ORDER + 1):
        s = counts[d].withColumn("ctx", F.expr(f"left(gram, {d})"))
        x = s.groupBy("ctx").agg(F.sum("a").alias("xa"), F.sum("b").alias("xb"), F.sum(F.expr("cast(a > 0 as long)")).alias("ta"), F.sum(F.expr("cast(b > 0 as long)")).alias("tb"))
        s = s.join(x, "ctx")
        if known is None:
            s = s.withColumns({"pa": F.lit(1.0) / spread, "pb": F.lit(1.0) / spread})
        else:
            s = s.withColumn("shorter", F.expr(f"right(gram, {d})")).join(known, "shorter")
        mixed = {f"q{y}": F.expr(f"case when x{y} > 0 then (n{y} + t{y} * p{y}) / (x{y} + t{y}) else p{y} end".replace(f"n{y}", y)) for y in "ab"}
        s = s.withColumns(mixed)
        known = s.select(F.col("gram").alias("shorter"), F.col("qa").alias("pa"), F.col("qb").alias("pb"))
    return known.select(F.col("shorter").alias("gram"), F.expr("cast(round(1000000 * (ln(pa) - ln(pb))) as long)").alias("llr"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Judge the urls of (page_id, url): page_id, host, path, rule, verdict.

    A rule fits its host and the host's subdomains if the path starts with the
    rule's; the longest wins. Other URLs get the models' verdict. Null urls count
    as empty text (host and path empty, judged by the models). Repeated
    rows are judged alike and count for training as often as they occur. If only
    one kind of URL can be calibrated on, the threshold is an even ratio. Other columns are ignored. An
    empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("given", F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules]))
    held = F.pmod(F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(HELD_OUT)) == 0
    rows = materialise(rows.withColumns({"held": held, "row": F.monotonically_increasing_id()}), "urls")
    counted = _grams(rows, ["given", "held"]).groupBy("gram").agg(
        F.sum(F.expr("cast(not held and given <=> 'allow' as long)")).alias("a"), F.sum(F.expr("cast(not held and given <=> 'block' as long)")).alias("b")
    )
    models = materialise(_models(materialise(counted, "grams")), "ratios")
    # Grams such as a scheme's are in every url.
    asked = join_hot(_grams(rows.where("given is null or held"), ["row"]), models, "gram", "row")
    place = f"cast(greatest(-{FARTHEST}, least({FARTHEST}, floor(sum(llr) / (count(*) * {BIN}.0)))) as int)"
    bins = materialise(asked.groupBy("row").agg(F.expr(place).alias("bin")), "bins")
    at = _threshold(rows.where("held and given is not null").join(bins, "row").groupBy("bin").agg(F.sum(F.expr("cast(given = 'allow' as long)")).alias("a"), F.sum(F.expr("cast(given = 'block' as long)")).alias("b")))
    judged = rows.join(bins, "row", "left").withColumn("verdict", F.coalesce("given", F.when(F.col("bin") >= at, "allow").otherwise("block")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _threshold(bins: DataFrame) -> int:
    """The bin from which URLs are allowed. ``bins`` has 2 * FARTHEST + 1 rows at most."""
    best, allow, block = (0.0, 0, 0), 0, 0
    rows = sorted(bins.collect(), key=lambda r: -r["bin"])
    all_a, all_b = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not all_a or not all_b:
        return 0
    for r in rows:
        allow, block = allow + r["a"], block + r["b"]
        # Compared as whole numbers: true positives a times all b, less false ones.
        best = max(best, (allow * all_b - block * all_a, -abs(r["bin"]), r["bin"]))
    return best[2]
