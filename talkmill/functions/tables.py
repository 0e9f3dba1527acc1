"""Table functions for SQL: call records to utterances, answers to labels or scores.

:func:`register_table_functions` makes them known to a session::

    SELECT * FROM call_utterances(TABLE(records))
    SELECT * FROM call_utterances(TABLE(records), problems => true)
    SELECT * FROM parse_answers(TABLE(answers), kind => 'tagged', tags => array('c'), domain => array('yes', 'no'))
    SELECT * FROM parse_answers(TABLE(answers), kind => 'scores', tags => array('fit'), request => 'custom_id', batch => 'nth')

Their columns follow from the table and the constants they are called with, while the
query is analysed. Rows are those of ``sources.conversations.flatten_calls`` and of
the parsers in ``functions.text``; where built-in expressions serve, those are faster.
Rows stream through; a function that takes the newest answer holds one row of a request.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from talkmill.functions.text import LEADING_NUMBER
from talkmill.shipping import ship

#: Paths end in {J}/{S}/{S}.json; columns of an utterance beside the call's.
CODES = re.compile(r"([^/]+)/([^/]+)/\2\.json\Z")
SPEAKER = {"type": "speaker_type", "gender": "speaker_gender", "age": "speaker_age", "telephone_network": "telephone_network"}
UTTERANCE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("call_id", "j_code", "s_code", "category", "subcategory", "speaker_id", *SPEAKER.values())]
    + [T.StructField("dialog_idx", T.IntegerType()), T.StructField("audioPath", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("text", T.StringType())]
)
PROBLEM = T.StructType([T.StructField("path", T.StringType()), T.StructField("problem", T.StringType())])


def _table(argument: AnalyzeArgument, *needed: str) -> T.StructType:
    """The schema of a table argument that has the columns named."""
    if not argument.isTable or not isinstance(argument.dataType, T.StructType):
        raise ValueError("the first argument must be a table: TABLE(name)")
    if lacking := [c for c in needed if c not in argument.dataType.names]:
        raise ValueError(f"the table has no column {', '.join(lacking)}")
    return argument.dataType


def _constant(argument: AnalyzeArgument | None, name: str, default: Any = None) -> Any:
    if argument is None:
        return default
    if not argument.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return default if argument.value is None else argument.value


def _scalar(value: Any, what: str) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list | dict):
        raise ValueError(f"{what} is not a single value")
    return json.dumps(value)


def _members(value: Any, what: str) -> list[dict]:
    if not isinstance(value, list) or any(not isinstance(x, dict | None) for x in value):
        raise ValueError(f"{what} is not a list of objects")
    return [x or {} for x in value]


def utterances(path: str, body: str | None) -> list[tuple]:
    """The utterances of one record; ValueError says what is wrong with it."""
    try:
        # Numbers stand as they are written wherever a text is wanted.
        record = json.loads(body or "", parse_float=str, parse_int=str)
    except ValueError:
        raise ValueError(body or "no dialogs") from None
    data = record.get("dataSet") if isinstance(record, dict) else None
    if not isinstance(data, dict) or data.get("dialogs") is None:
        raise ValueError("no dialogs")
    info = data.get("typeInfo") or {}
    if not isinstance(info, dict):
        raise ValueError("typeInfo is not an object")
    found = CODES.search(path or "")
    codes = found.groups() if found else ("", "")
    speakers = {x.get("id"): x for x in _members(info.get("speakers") or [], "speakers") if x.get("id") is not None}
    call = ("_".join(codes), *codes, _scalar(info.get("category"), "category"), _scalar(info.get("subcategory"), "subcategory"))
    out = []
    for nth, d in enumerate(_members(data["dialogs"], "dialogs")):
        who = speakers.get(d.get("speaker"), {})
        length = _scalar(d.get("duration"), "duration")
        out.append((*call, _scalar(d.get("speaker"), "speaker"), *(_scalar(who.get(a), a) for a in SPEAKER), nth, _scalar(d.get("audioPath"), "audioPath"), None if length is None else float(length), _scalar(d.get("text"), "text")))
    return out


@dataclass
class Flattening(AnalyzeResult):
    problems: bool = False


class CallUtterances:
    """(path, value) to one row a dialog, or, with ``problems``, one row (path, problem) a record that can't be read.

    A null or empty value and a record without dialogs are problems; an empty list of dialogs has no rows.
    Other columns of the table are not looked at.
    """

    def __init__(self, analysed: Flattening) -> None:
        self.problems = analysed.problems

    @staticmethod
    def analyze(records: AnalyzeArgument, problems: AnalyzeArgument | None = None) -> Flattening:
        _table(records, "path", "value")
        wanted = bool(_constant(problems, "problems", False))
        return Flattening(schema=PROBLEM if wanted else UTTERANCE, problems=wanted)

    def eval(self, records: Row, problems: bool = False) -> Iterator[tuple]:
        try:
            rows = utterances(records["path"], records["value"])
        except ValueError as e:
            if self.problems:
                yield records["path"], str(e)
            return
        if not self.problems:
            yield from rows


def _search(pattern: str, text: str | None) -> re.Match | None:
    return re.search(pattern, text or "", re.ASCII | re.DOTALL)


def _label(text: str) -> str:
    return re.sub(r"^\s+|\s+\Z", "", re.sub(LEADING_NUMBER, "", text, count=1, flags=re.ASCII), flags=re.ASCII)


def read_plain(answer: str | None, tags: list[str], domain: list[str], low: int, high: int) -> tuple:
    label = _label(answer or "")
    return (label, None) if label in domain else (None, "out of domain" if label else "empty")


def read_tagged(answer: str | None, tags: list[str], domain: list[str], low: int, high: int) -> tuple:
    if answer is None:
        return None, "no response"
    inside = _search(f"<{tags[0]}>(.*?)</{tags[0]}>", answer)
    if inside is None:
        return None, "tag missing"
    label = _label(inside[1])
    return (label, None) if label in domain else (None, "out of domain")


def read_scores(answer: str | None, tags: list[str], domain: list[str], low: int, high: int) -> tuple:
    nothing = [None] * len(tags)
    if not _search(r"\S", answer):
        return *nothing, "empty"
    found = [_search(rf"<{t}>\s*(\d+)\s*</{t}>", answer) for t in tags]
    if missing := [t for t, m in zip(tags, found, strict=True) if m is None]:
        return *nothing, "missing: " + ",".join(missing)
    # The digits are compared, not what very many of them amount to.
    values = [int(m[1].lstrip("0")[:10] or 0) for m in found]
    if all(low <= v <= high for v in values):
        return *values, None
    return *nothing, "out of range: " + ", ".join(f"{t}={m[1]}" for t, m in zip(tags, found, strict=True))


READERS = {"plain": read_plain, "tagged": read_tagged, "scores": read_scores}


@dataclass
class Parsing(AnalyzeResult):
    kind: str = "plain"
    answer: str = "response"
    tags: list[str] = field(default_factory=list)
    domain: list[str] = field(default_factory=list)
    low: int = 1
    high: int = 5
    newest: bool = False


class ParseAnswers:
    """The table's columns, then ``label`` or a score for each tag, then ``error``.

    ``kind``: plain, tagged (the first of ``tags``) or scores (every tag, between ``low`` and ``high``).
    With ``request``, only the newest answer of a request counts: the last in order of ``batch``, then of
    the answer itself, nulls first; rows without a request are one request. New columns whose names
    the table has already get underscores behind them.
    """

    def __init__(self, analysed: Parsing) -> None:
        self.how, self.last = analysed, None

    @staticmethod
    def analyze(answers: AnalyzeArgument, kind: AnalyzeArgument, answer: AnalyzeArgument | None = None, tags: AnalyzeArgument | None = None, domain: AnalyzeArgument | None = None, low: AnalyzeArgument | None = None, high: AnalyzeArgument | None = None, request: AnalyzeArgument | None = None, batch: AnalyzeArgument | None = None) -> Parsing:
        kind, answer = _constant(kind, "kind"), _constant(answer, "answer", "response")
        tags, domain = list(_constant(tags, "tags", [])), list(_constant(domain, "domain", []))
        by, order = _constant(request, "request"), _constant(batch, "batch")
        schema = _table(answers, answer, *[c for c in (by, order) if c is not None])
        if kind not in READERS:
            raise ValueError(f"kind must be one of {', '.join(READERS)}")
        if kind != "plain" and not tags:
            raise ValueError(f"{kind} answers need tags")
        if order is not None and by is None:
            raise ValueError("batch orders the answers of a request: name the request's column too")
        taken, new = {c.lower() for c in schema.names}, []
        for name, of in [*([(t, T.IntegerType()) for t in tags] if kind == "scores" else [("label", T.StringType())]), ("error", T.StringType())]:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            new.append(T.StructField(name, of))
        quoted = lambda c: "`" + c.replace("`", "``") + "`"
        return Parsing(
            schema=T.StructType([*schema.fields, *new]),
            partitionBy=[PartitioningColumn(quoted(by))] if by is not None else [],
            orderBy=[OrderingColumn(quoted(c), ascending=True, overrideNullsFirst=True) for c in ([order] if order is not None else []) + [answer]] if by is not None else [],
            kind=kind, answer=answer, tags=tags, domain=domain, low=_constant(low, "low", 1), high=_constant(high, "high", 5), newest=by is not None,
        )

    def _read(self, row: Row) -> tuple:
        how = self.how
        return *row, *READERS[how.kind](row[how.answer], how.tags, how.domain, how.low, how.high)

    def eval(self, answers: Row, kind: str, answer: str | None = None, tags: list | None = None, domain: list | None = None, low: int | None = None, high: int | None = None, request: str | None = None, batch: str | None = None) -> Iterator[tuple]:
        if self.how.newest:
            self.last = answers
        else:
            yield self._read(answers)

    def terminate(self) -> Iterator[tuple]:
        if self.last is not None:
            yield self._read(self.last)


def register_table_functions(spark: SparkSession) -> None:
    """Make ``call_utterances`` and ``parse_answers`` known to the session's SQL."""
    ship(spark)
    spark.udtf.register("call_utterances", udtf(CallUtterances))
    spark.udtf.register("parse_answers", udtf(ParseAnswers))
