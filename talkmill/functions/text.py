"""Transcript cleaning, label normalising and answer parsing, as column functions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the tags that mark disfluency, and those counted one by one.
TAGS = "onblipfh"
MAIN_TAGS = "onbl"
#: Hangul syllables.
SYLLABLE = "[가-힣]"

LEADING_NUMBER = r"^\s*\d+[.)]\s*"

#: A part that could not be heard stands in two parentheses or more on a line; a remark in one.
UNHEARD, REMARK = r"(?d)\(\(.*?\)\)+", r"\([^()]*\)"
#: Whatever is left of marks, and white space as Python has it.
STRAY, BLANKS = r"[()/]", r"(?U)[\s\x1c-\x1f]+"


def correction(first_closed: bool, second_opened: bool) -> str:
    """The pattern of one form of a correction: what was said, a slash, what was meant, each in parentheses.

    Transcribers forget the first closing parenthesis, the second opening one, or both. What was said has
    neither parenthesis nor slash, what was meant (the group) no parenthesis.
    """
    said = r"\([^/()]*" + (r"\)" if first_closed else "")
    meant = (r"\(" if second_opened else "") + r"([^()]*)\)"
    return said + "/" + meant


#: The whole form first, then the damaged ones.
CORRECTIONS = [correction(closed, opened) for closed in (True, False) for opened in (True, False)]


def _tag(letters: str) -> str:
    return f"(?<![A-Za-z])[{letters.lower()}{letters.upper()}]/"


def clean_text(text: Column, tags: str = TAGS) -> Column:
    """Six ordered steps: unintelligible parts, tags, corrections, remarks, strays, blanks."""
    steps = [
        (UNHEARD, " "),
        (_tag(tags), " "),
        ("|".join(CORRECTIONS), "".join(f"${i}" for i in range(1, len(CORRECTIONS) + 1))),
        (REMARK, " "),
        (STRAY, " "),
        (BLANKS, " "),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def tag_count(text: Column, tag: str) -> Column:
    return F.regexp_count(text, F.lit(_tag(tag)))


def tag_total(text: Column, tags: str = TAGS) -> Column:
    """Tags of all letters."""
    return tag_count(text, tags)


def correction_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("|".join(CORRECTIONS)))


def length_ratio(cleaned: Column, raw: Column) -> Column:
    """What cleaning leaves of a text's length; null for an empty text."""
    return F.length(cleaned) / F.nullif(F.length(raw), F.lit(0))


def syllables(text: Column, pattern: str = SYLLABLE) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def too_short(text: Column, least: int = 2) -> Column:
    return F.length(text) <= least


def speaker_group(speaker: Column, groups: list[str]) -> Column:
    """The group a speaker's name starts with, else null."""
    found = F.regexp_extract(speaker, f"^({'|'.join(groups)})", 1)
    return F.when(found != "", found)


def strip_number(speaker: Column) -> Column:
    return F.regexp_replace(speaker, r"\d+$", "")


def normalise_label(label: Column) -> Column:
    """Without a leading ``3.`` or ``3)``, trimmed."""
    return F.regexp_replace(F.regexp_replace(label, LEADING_NUMBER, ""), r"^\s+|\s+$", "")


def normalise_human_label(label: Column, prefix: str, into: str) -> Column:
    label = normalise_label(label)
    return F.when(label.startswith(prefix), F.lit(into)).otherwise(label)


def parse_plain(answer: Column, domain: list[str]) -> Column:
    """struct(label, error) of an answer that is a bare label."""
    label = normalise_label(F.coalesce(answer, F.lit("")))
    ok = label.isin(domain)
    return F.struct(F.when(ok, label).alias("label"), F.when(label == "", "empty").when(~ok, "out of domain").alias("error"))


def parse_tagged(answer: Column, tag: str, domain: list[str], extra: str | None = None) -> Column:
    """struct(label, error[, extra]) of ``<tag>label</tag>``, also over several lines; the first tag counts.

    A null answer is no response; any other text without the tag lacks it. ``extra``
    names a second tag, whose trimmed content is returned where the label is sound.
    """
    text = F.coalesce(answer, F.lit(""))
    inside = lambda t: F.when(text.rlike(rf"(?s)<{t}>.*?</{t}>"), F.regexp_extract(text, rf"(?s)<{t}>(.*?)</{t}>", 1))
    has = inside(tag).isNotNull()
    label = normalise_label(inside(tag))
    ok = F.coalesce(label.isin(domain), F.lit(False))
    error = F.when(answer.isNull(), "no response").when(~has, "tag missing").when(~ok, "out of domain")
    out = [F.when(ok, label).alias("label"), error.alias("error")]
    if extra is not None:
        out.append(F.when(ok, F.regexp_replace(inside(extra), r"^\s+|\s+$", "")).alias(extra))
    return F.struct(*out)


def parse_verdict(answer: Column, flag: str, label: str, domain: list[str], forced: str) -> Column:
    """struct(flag, label) of the JSON object in an answer: all from the first to the last brace.

    Text that isn't one object, or a flag that isn't a boolean, fails the whole answer; a true
    flag forces a label; labels are compared as they stand, others than the domain's are null. Of a key
    given twice the last counts; NaN and infinities may stand where numbers do.
    """
    raw = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    # In a list, so that anything behind the object is seen.
    found = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), f"array<struct<`{flag}`:variant,`{label}`:variant>>", {"allowNonNumericNumbers": "true"})
    of = lambda name, kind, sql: F.when(F.schema_of_variant(F.get(found, F.lit(0))[name]) == kind, F.try_variant_get(F.get(found, F.lit(0))[name], "$", sql))
    value, name = of(flag, "BOOLEAN", "boolean"), of(label, "STRING", "string")
    sound = F.coalesce((raw != "") & (F.size(found) == 1) & value.isNotNull(), F.lit(False))
    return F.struct(F.when(sound, value).alias("flag"), F.when(sound & value, F.lit(forced)).when(sound & name.isin(domain), name).alias("label"))


def parse_scores(answer: Column, tags: list[str], low: int = 1, high: int = 5) -> Column:
    """struct(score for each tag, error): all whole numbers in range, or no score and why.

    Errors: 'empty', 'missing: ' and the tags that aren't there, 'out of range: ' and all scores.
    """
    text = F.coalesce(answer, F.lit(""))
    found = {t: F.regexp_extract(text, rf"<{t}>\s*(\d+)\s*</{t}>", 1) for t in tags}
    missing = F.array_join(F.array_compact(F.array(*[F.when(found[t] == "", F.lit(t)) for t in tags])), ",")
    value = {t: found[t].try_cast("int") for t in tags}
    fits = reduce(and_, [F.coalesce(value[t].between(low, high), F.lit(False)) for t in tags])
    said = F.concat_ws(", ", *[F.concat(F.lit(f"{t}="), found[t]) for t in tags])
    error = F.when(~text.rlike(r"\S"), "empty").when(missing != "", F.concat(F.lit("missing: "), missing)).when(~fits, F.concat(F.lit("out of range: "), said))
    return F.struct(*[F.when(fits, value[t]).alias(t) for t in tags], error.alias("error"))


def answer_label(answer: Column, domain: list[str], lead: str = "answer", tag: str = "c", tail: int = 100) -> Column:
    """The label an answer gives, looked for in falling order of strictness.

    ``lead: label``; ``<tag>label</tag>``; a tag named like a label; the last ``tail`` characters; anywhere.
    """
    names = "|".join(domain)
    pick = lambda pattern: F.nullif(F.regexp_extract(answer, pattern, 1), F.lit(""))
    strict = pick(rf"{lead}\s*[:：]\s*(\w+)")
    tagged = pick(rf"(?s)<{tag}>\s*(.+?)\s*</{tag}>")
    member = lambda x: F.when(x.isin(domain), x)
    named = F.get(F.filter(F.array(*[F.lit(d) for d in domain]), lambda d: F.contains(answer, F.concat(F.lit("<"), d, F.lit(">")))), F.lit(0))
    return F.coalesce(member(strict), member(tagged), named, tail_label(answer, domain, tail)) if names else F.lit(None).cast("string")


def first_digit(answer: Column, low: int = 0, high: int = 4) -> Column:
    return F.regexp_extract(answer, f"[{low}-{high}]", 0).try_cast("int")


def contained_label(answer: Column, domain: list[str]) -> Column:
    """The first label of the domain that occurs anywhere."""
    return F.get(F.filter(F.array(*[F.lit(d) for d in domain]), lambda d: F.contains(answer, d)), F.lit(0))


def tail_label(answer: Column, domain: list[str], tail: int = 100) -> Column:
    """The same, looked for in the last characters first."""
    return F.coalesce(contained_label(F.right(answer, F.lit(tail)), domain), contained_label(answer, domain))


def keep_or_revert(answer: Column) -> Column:
    return F.upper(F.regexp_extract(answer, r"(?i)\b(keep|revert)\b", 1)).alias("verdict")


def keyword_hits(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" / "))


def entropy(probabilities: Column) -> Column:
    """Shannon entropy in nats, probabilities clipped at 1e-12."""
    terms = F.transform(probabilities, lambda p: -F.greatest(p, F.lit(1e-12)) * F.log(F.greatest(p, F.lit(1e-12))))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def approximate_tokens(text: Column) -> Column:
    """Offline token estimate: words and punctuation marks, long words by four characters."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"(\w+|[^\w\s])"), F.lit(1)), F.lit(0), lambda a, w: a + F.ceil(F.length(w) / 4.0).cast("int"))


LEVELS = ["very_low", "low", "mid", "high", "very_high"]
METRICS = ["f0_mean", "f0_std", "e_mean_db", "e_std_db", "r_gold", "s_top_db30"]
_DEGREES = {
    "en": {"height": ["far below usual", "below usual", "usual", "above usual", "far above usual"], "speed": ["very slow", "slow", "usual", "quick", "very quick"]},
    "ko": {"height": ["아주 낮은 편", "낮은 편", "보통", "높은 편", "아주 높은 편"], "speed": ["아주 느린 편", "느린 편", "보통", "빠른 편", "아주 빠른 편"]},
}
_SUBJECTS = {
    "en": ["pitch", "pitch movement", "loudness", "loudness movement", "speech rate", "share of silence"],
    "ko": ["목소리 높이", "높이 변화", "크기", "크기 변화", "말 속도", "침묵 비율"],
}


def level_phrases(language: str) -> dict[str, dict[str, str]]:
    """For each metric, the phrase of each level."""
    out = {}
    for metric, subject in zip(METRICS, _SUBJECTS[language], strict=True):
        degrees = _DEGREES[language]["speed" if metric == "r_gold" else "height"]
        out[metric] = {level: f"{subject}: {degree}" for level, degree in zip(LEVELS, degrees, strict=True)}
    return out


def describe_levels(levels: dict[str, Column], phrases: dict[str, dict[str, str]], missing: str = "mid") -> Column:
    """One phrase for each metric and level; a null or unknown level reads as ``missing``."""
    parts = []
    for metric, level in levels.items():
        table = F.create_map(*[F.lit(x) for pair in phrases[metric].items() for x in pair])
        parts.append(F.coalesce(F.try_element_at(table, F.coalesce(level, F.lit(missing))), F.lit(phrases[metric][missing])))
    return F.concat_ws(", ", *parts)


def template_problems(a: dict[str, dict[str, str]], b: dict[str, dict[str, str]]) -> list[str]:
    """How two phrase tables differ in structure: order of metrics, levels of each."""
    out = [] if list(a) == list(b) else [f"metrics differ: {list(a)} and {list(b)}"]
    return out + [f"{m}: levels differ: {sorted(set(a[m]) ^ set(b[m]))}" for m in a if m in b and set(a[m]) != set(b[m])]
