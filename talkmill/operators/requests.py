"""Requests for a labelling model: blocks, templates, grids, chunks and their checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.operators.packing import greedy_chunks  # noqa: F401  a part of planning requests


def utterance_block(df: DataFrame, keys: list[str], order: str, speaker: str, text: str, note: str | None = None, empty: str = "(no text)", name: str = "block") -> DataFrame:
    """Numbered lines of a window in order, with an optional note below each."""
    said = F.when(F.coalesce(F.trim(text), F.lit("")) == "", empty).otherwise(F.col(text))
    line = F.struct(F.col(order).alias("o"), F.col(speaker).alias("s"), said.alias("t"), (F.col(note) if note else F.lit(None).cast("string")).alias("n"))
    items = F.array_sort(F.collect_list(line))

    def render(x: Column, i: Column) -> Column:
        head = F.concat((i + 1).cast("string"), F.lit(". ["), x["s"], F.lit("] "), x["t"])
        return F.when(x["n"].isNull(), head).otherwise(F.concat(head, F.lit("\n   - "), x["n"]))

    return df.groupBy(*keys).agg(F.array_join(F.transform(items, render), "\n").alias(name))


def fill_template(template: str, **values: Column) -> Column:
    """Replace every {name} of a template."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def insert_at(prompt: Column, marker: str, text: Column) -> Column:
    """Insert text before the marker, which must occur exactly once."""
    once = (F.length(prompt) - F.length(F.replace(prompt, F.lit(marker), F.lit("")))) == len(marker)
    return F.when(once, F.replace(prompt, F.lit(marker), F.concat(text, F.lit(marker)))).otherwise(F.raise_error(F.lit("marker must occur once")).cast("string"))


def custom_id(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def request_grid(windows: DataFrame, conditions: dict[str, tuple[str, bool]], call: str = "call_id") -> DataFrame:
    """Every condition (its window version and whether notes are shown) of every window: one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(v).alias("version"), F.lit(a).alias("acoustic")) for c, (v, a) in conditions.items()])
    out = windows.withColumn("cell", F.explode(cells)).where("cell.version = window_version").select("*", "cell.condition", "cell.acoustic").drop("cell")
    return out.withColumn("custom_id", custom_id(F.col(call).cast("string"), F.col("condition"), F.concat(F.lit("N"), F.col("window_n").cast("string"))))


def versioned(templates: dict[str, str], version: Column, guides: dict[str, str], shows_notes: Column, **values: Column) -> Column:
    """The template of each row's version with its values and its guide; no guide where no notes are shown. An unknown version is an error."""
    out = F.raise_error(F.concat(F.lit("unknown version: "), F.coalesce(version, F.lit("null")))).cast("string")
    for name, template in templates.items():
        guide = F.when(shows_notes, F.lit(guides.get(name, ""))).otherwise("")
        out = F.when(version == name, fill_template(template, guide=guide, **values)).otherwise(out)
    return out


def structure_diff(ours: DataFrame, theirs: DataFrame, key: str, text: str, free: list[str]) -> DataFrame:
    """(key, n_changed, n_structural): lines that only one of two variants has, and those of them that don't begin with a ``free`` prefix."""
    lines = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\n")
    both = ours.select(key, F.col(text).alias("_a")).join(theirs.select(key, F.col(text).alias("_b")), key, "full_outer")
    changed = F.concat(F.array_except(lines("_a"), lines("_b")), F.array_except(lines("_b"), lines("_a")))
    fixed = F.filter(changed, lambda x: ~reduce(or_, [F.ltrim(x).startswith(p) for p in free], F.lit(False)))
    return both.select(key, F.size(changed).alias("n_changed"), F.size(fixed).alias("n_structural"))


def byte_equal(ours: DataFrame, theirs: DataFrame, key: str, column: str) -> DataFrame:
    """Counts of equal, different and missing texts of two request sets."""
    both = ours.select(key, F.col(column).alias("_a")).join(theirs.select(key, F.col(column).alias("_b")), key, "full_outer")
    return both.agg(F.count_if(F.expr("_a = _b")).alias("n_equal"), F.count_if(F.expr("_a <> _b")).alias("n_different"), F.count_if(F.expr("_a is null or _b is null")).alias("n_missing"))


def translated(df: DataFrame, translations: DataFrame, key: str, text: str) -> DataFrame:
    """Text from a translation table; a missing one stops the job."""
    out = df.join(translations.select(key, F.col("translation")), key, "left")
    checked = F.coalesce("translation", F.when(F.lit(True), F.raise_error(F.concat(F.lit("no translation of "), F.col(key).cast("string"))).cast("string")))
    return out.withColumn(text, checked).drop("translation")


def first_n_exact(df: DataFrame, call: str, order: str, n: int) -> DataFrame:
    """The first n rows of calls that have that many."""
    w = Window.partitionBy(call)
    return df.withColumns({"_r": F.row_number().over(w.orderBy(order)), "_c": F.count(F.lit(1)).over(w)}).where((F.col("_r") <= n) & (F.col("_c") >= n)).drop("_r", "_c")
