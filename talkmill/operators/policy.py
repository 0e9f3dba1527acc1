"""Label fusion, information-poor layers, triggers and decision policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.nulls import differs, same
from talkmill.operators.aggregate import distinct_across


def fuse_labels(base: DataFrame, gate: DataFrame, refined: DataFrame, key: str, focus: str) -> DataFrame:
    """(key, label, source) of three passes.

    ``base``: label; ``gate``: has_focus, gate_label; ``refined``: refined_label. A true gate
    gives the focus label (source 'gate'), a false one the refined, else the gate's label ('refined'); rows
    without either keep the base label ('base').
    """
    rows = base.select(key, F.col("label").alias("_base")).join(gate.select(key, "has_focus", "gate_label"), key, "left").join(refined.select(key, "refined_label"), key, "left")
    yes, no = F.col("has_focus"), F.col("has_focus") == F.lit(False)
    label = F.when(yes, focus).when(no, F.coalesce("refined_label", "gate_label")).otherwise(F.col("_base"))
    return rows.select(key, label.alias("label"), F.when(yes, "gate").when(no, "refined").otherwise("base").alias("source"))


def fallback_label(columns: dict[str, str]) -> tuple[Column, Column]:
    """(label, source): the first label that is there; ``columns``: source name -> column."""
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(s)) for s, c in columns.items()])
    return F.coalesce(*columns.values()), source


def relabel_targets(labels: DataFrame, gate: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Calls whose label is in question and whose gate said no."""
    no = gate.where(F.col("has_focus") == F.lit(False)).select(key)
    return labels.where(F.col("label").isin(wanted)).join(no, key, "left_semi")


def layer_flags(gold: Column, early: Column, late: Column, tokens: Column, short_cut: Column | float) -> dict[str, Column]:
    """unlock, shift, short, is_infopoor and layer of a call."""
    unlock = differs(early, gold) & same(late, gold)
    shift = differs(early, late)
    short = F.coalesce(tokens <= F.lit(short_cut), F.lit(False))
    poor = unlock | (shift & short)
    layer = F.when(~differs(early, gold), "already_correct").when(poor, "infopoor").otherwise("sufficient")
    return {"unlock": unlock, "shift": shift, "short": short, "is_infopoor": poor, "layer": layer}


def triggers(trajectory: list[str], early: str, late: str, uncertain: Column, short: Column) -> dict[str, Column]:
    """The six triggers over predictions of growing windows."""
    shift = differs(F.col(early), F.col(late))
    moves = distinct_across(trajectory) >= 2
    entropy = F.coalesce(uncertain, F.lit(False))
    return {"shift": shift, "trajectory": moves, "entropy": entropy, "combo": moves & entropy, "shift_not_short": shift & ~short, "trajectory_not_short": moves & ~short}


def hybrid(fired: Column, gate: Column, base: Column) -> Column:
    return F.when(F.coalesce(fired, F.lit(False)), gate).otherwise(base)


def override(probability: Column, cut: float, focus: str, base: Column) -> Column:
    return F.when(F.coalesce(probability > cut, F.lit(False)), F.lit(focus)).otherwise(base)


def _supported(strong: Column, neutral: Column, kept: Column, focus: str) -> Column:
    """The strong label; if it is the focus and a neutral label contradicts it, the latter, unless ``kept``."""
    contradicted = same(strong, F.lit(focus)) & F.coalesce(neutral != focus, F.lit(False))
    return F.when(contradicted & ~kept, neutral).otherwise(strong)


def verdict_gate(strong: Column, neutral: Column, verdict: Column, focus: str) -> Column:
    """A verifier's REVERT gives way to the neutral label; KEEP, no verdict or no neutral label don't."""
    return _supported(strong, neutral, ~same(verdict, F.lit("REVERT")), focus)


def score_gate(strong: Column, neutral: Column, score: Column, cut: int, focus: str, strong_first: bool = True) -> Column:
    """Keep a focus label that two models disagree on only if a score supports it.

    Strong first: without a score, or without a neutral label, the focus label stays. Neutral
    first: without a neutral label the strong one counts, without a score the neutral one.
    """
    if strong_first:
        return _supported(strong, neutral, F.coalesce(score >= cut, F.lit(True)), focus)
    supported = same(strong, F.lit(focus)) & F.coalesce(score >= cut, F.lit(False))
    return F.when(neutral.isNull(), strong).when(supported, F.lit(focus)).otherwise(neutral)


def reclassify(base: Column, second: Column, focus: str) -> Column:
    """A second pass over rows predicted as the focus class only."""
    return F.when(same(base, F.lit(focus)), F.coalesce(second, base)).otherwise(base)


def quality_split(score: Column, cut: int = 4) -> Column:
    return F.when(score >= cut, "good").when(score.isNotNull(), "bad")


def mean_of_present(*columns: Column) -> Column:
    """Mean over the columns that aren't null."""
    values = F.array_compact(F.array(*columns))
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def delta_status(before: Column, after: Column) -> Column:
    """What became of a problem: kept, resolved, newly arisen, none."""
    return F.when(before & after, "kept").when(before & ~after, "resolved").when(~before & after, "newly_arisen").otherwise("none")
