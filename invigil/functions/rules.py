"""Ordered validation: the first rule that fails decides the verdict of a row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invigil.messages import message
from invigil.schema import TABLES
from invigil.session import stage

ERROR = "error_code"
TEXT = "error_message"

Rule = tuple[str, Column]


class Outcome(NamedTuple):
    """A batch of requests after validation."""

    accepted: DataFrame
    rejected: DataFrame


def first_failing_rule(rules: Iterable[Rule]) -> Column:
    """Code of the first rule whose condition is true, NULL when none is.

    A condition that is NULL does not fail, as in a plain ``if``.
    """
    rules = list(rules)
    if not rules:
        return F.lit(None).cast("string")
    (code, bad), rest = rules[0], rules[1:]
    return reduce(lambda chain, rule: chain.when(rule[1], F.lit(rule[0])), rest, F.when(bad, F.lit(code)))


def message_of(code: Column, codes: Iterable[str]) -> Column:
    return first_failing_text((code == c, message(c)) for c in dict.fromkeys(codes))


def first_failing_text(cases: Iterable[tuple[Column, str]]) -> Column:
    cases = list(cases)
    if not cases:
        return F.lit(None).cast("string")
    start = F.when(cases[0][0], F.lit(cases[0][1]))
    return reduce(lambda chain, case: chain.when(case[0], F.lit(case[1])), cases[1:], start)


def judge(requests: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``requests`` plus ``error_code``; one projection, no action."""
    return requests.withColumn(ERROR, first_failing_rule(rules))


def with_messages(judged: DataFrame, codes: Iterable[str]) -> DataFrame:
    return judged.withColumn(TEXT, message_of(F.col(ERROR), codes))


def split(judged: DataFrame, codes: Iterable[str], request_key: str = "req_id") -> Outcome:
    """The verdicts, settled by one job, as accepted requests and rejected ones with messages."""
    judged = stage(judged, "verdicts")
    accepted = judged.where(F.col(ERROR).isNull()).drop(ERROR)
    rejected = with_messages(judged.where(F.col(ERROR).isNotNull()), codes).select(request_key, ERROR, TEXT)
    return Outcome(accepted, rejected)


def violates_required(table: str, columns: Iterable[str]) -> Rule:
    """I-15 for the named columns of rows about to be stored in ``table``."""
    bad = F.lit(False)
    for name in columns:
        column = TABLES[table].column(name)
        if column.required:
            bad = bad | F.col(name).isNull()
        if column.length:
            bad = bad | F.coalesce(F.length(name) > column.length, F.lit(False))
    return "I-15", bad


def violates_checks(table: str, columns: Iterable[str]) -> Rule:
    """I-11 for rows about to be stored: every CHECK that needs only ``columns``."""
    have, spec = set(columns), TABLES[table]
    bad = F.lit(False)
    for check in spec.checks:
        if {c for c in spec.names if c in check.sql} <= have:
            bad = bad | F.coalesce(F.expr(f"NOT ({check.sql})"), F.lit(False))
    return "I-11", bad
