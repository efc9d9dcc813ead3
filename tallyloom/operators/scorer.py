"""Batch scoring with a user-supplied scorer, failures isolated case by case."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.constants import ABSTENTIONS, SUM_TOLERANCE
from tallyloom.schema import PREDICTION

EDGES = ("left", "top", "right", "bottom")


class Scorer(Protocol):
    """`predict` is required. `predict_batch` and `case_batch_size` are optional."""

    def predict(self, case: dict[str, Any]) -> list[dict[str, Any]]: ...


class UniformScorer:
    """The reference scorer: equal probability for every option."""

    def predict(self, case: dict[str, Any]) -> list[dict[str, Any]]:
        return [
            {
                "case_id": case["case_id"],
                "question_id": q["id"],
                "probabilities": {o["id"]: 1.0 / len(q["options"]) for o in q["options"]},
            }
            for q in case["questions"]
        ]


def _entries(probabilities: Any) -> dict[str, float]:
    return dict(probabilities)


def _check(case: dict[str, Any], answers: list[dict[str, Any]]) -> None:
    """Raise when the answers of one case cannot be recorded."""
    questions = {q["id"]: q for q in case["questions"]}
    if sorted(a["question_id"] for a in answers) != sorted(questions):
        raise ValueError("missing, duplicate or foreign questions")
    for answer in answers:
        if answer["case_id"] != case["case_id"]:
            raise ValueError("foreign case")
        outcomes = [answer.get(k) for k in ("probabilities", "box", "error", "abstention")]
        if sum(o is not None for o in outcomes) != 1:
            raise ValueError("exactly one outcome is required")
        question = questions[answer["question_id"]]
        probabilities, box = outcomes[0], outcomes[1]
        if (probabilities is not None and question["task"] == "box") or (
            box is not None and question["task"] != "box"
        ):
            raise ValueError("outcome does not fit the task")
        if box is not None:
            b = box if isinstance(box, dict) else box.asDict()
            if not all(isinstance(b.get(k), (int, float)) and 0 <= b[k] <= 1 for k in EDGES):
                raise ValueError("box edge out of range")
            if b["left"] >= b["right"] or b["top"] >= b["bottom"]:
                raise ValueError("box edges out of order")
        if outcomes[3] is not None and outcomes[3] not in ABSTENTIONS:
            raise ValueError("unknown abstention")
        if probabilities is not None:
            p = _entries(probabilities)
            if set(p) != {o["id"] for o in question["options"]}:
                raise ValueError("options differ")
            if not all(0 <= v <= 1 for v in p.values()):
                raise ValueError("probability out of range")
            if abs(sum(p.values()) - 1) > SUM_TOLERANCE:
                raise ValueError("probabilities do not sum to one")


def _attempt(scorer: Scorer, cases: list[dict[str, Any]]) -> Iterator[tuple[dict, Any]]:
    """(case, answers or exception); a failed batch is retried one case at a time."""
    batch = getattr(scorer, "predict_batch", None)
    if batch is not None:
        try:
            answers = batch(cases)
            if len(answers) != len(cases):
                raise ValueError("missing or duplicate cases")
        except Exception:  # noqa: BLE001 - the retry below isolates the failing case
            answers = None
        if answers is not None:
            yield from zip(cases, answers, strict=True)
            return
    for case in cases:
        try:
            yield case, scorer.predict(case)
        except Exception as problem:  # noqa: BLE001 - recorded as error rows
            yield case, problem


def _rows(case: dict[str, Any], outcome: Any) -> Iterable[dict[str, Any]]:
    try:
        if isinstance(outcome, Exception):
            raise outcome
        _check(case, outcome)
        return outcome
    except Exception as problem:  # noqa: BLE001 - only the class is kept, messages may leak data
        name = type(problem).__name__
        return [
            {"case_id": case["case_id"], "question_id": q["id"], "error": name}
            for q in case["questions"]
        ]


def score_cases(
    cases: DataFrame, scorer: Callable[[], Scorer], passed_through: tuple[str, ...] = ()
) -> DataFrame:
    """Predictions for target-free cases (see `inference_view`).

    The scorer is built once per task and receives bounded groups taken from Arrow batches;
    partitions of `cases` are the unit of parallelism and of retry. `passed_through` names
    extra string columns (such as benchmark_id) copied to the output, never to the scorer.
    """
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in passed_through] + list(PREDICTION.fields)
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = scorer()
        size = getattr(active, "case_batch_size", 1) if hasattr(active, "predict_batch") else 1
        for batch in batches:
            records = iter(batch.to_pylist())
            out = []
            while group := list(islice(records, size)):
                extras = [{c: r.pop(c) for c in passed_through} for r in group]
                for extra, (case, outcome) in zip(extras, _attempt(active, group), strict=True):
                    for row in _rows(case, outcome):
                        p = row.get("probabilities")
                        values = list(_entries(p).items()) if p is not None else None
                        out.append({**row, **extra, "probabilities": values})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return cases.mapInArrow(run, schema)
