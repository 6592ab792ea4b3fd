"""What a change of one table makes wrong in others.

A rule is checked when rows of its own table change; moving, lowering, retyping or removing a row that those rest on leaves
them behind.  Here the changed rows' keys are carried down to the rule's rows, by semi joins along the references, and only the
rows reached are audited: the cost follows what rests on the change, not the size of the tables.

The rows to start from are those of the parent before and after the change, so that a row that was removed or now
points elsewhere is followed both ways.  Rows in between are those after the change.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invigil.operators.audits import AUDITS, SUBJECT
from invigil.schema import TABLES
from invigil.sources.tables import Tables


@dataclass(frozen=True)
class Step:
    """Rows of ``child`` whose ``columns`` equal ``parents`` of a row reached before."""

    child: str
    columns: tuple[str, ...]
    parents: tuple[str, ...]


@dataclass(frozen=True)
class Path:
    """How a change of ``watched`` columns of ``parent`` (or a row that comes or goes) reaches the rows of ``rule``."""

    rule: str
    parent: str
    watched: tuple[str, ...]
    steps: tuple[Step, ...]


def _path(rule: str, parent: str, watched: str, *steps: str) -> Path:
    """A step is written ``Child: column = parent's column, ...``."""
    found = []
    for step in steps:
        child, conditions = step.split(": ")
        pairs = [pair.split(" = ") for pair in conditions.split(", ")]
        found.append(Step(child, tuple(p[0] for p in pairs), tuple(p[1] for p in pairs)))
    return Path(rule, parent, tuple(watched.split()), tuple(found))


_EXAMS = "Exam: Exm_AsgId = Asg_Id"
_ON_PAPER = "ExamQuestion: EQ_ExmId = Exm_Id"
PATHS = [
    _path("I-1", "Track", "Trk_BrId", "Student: St_TrkId = Trk_Id"),
    _path("I-2", "Track", "Trk_BrId", "Exam: Exm_TrkId = Trk_Id"),
    _path("I-3", "Student", "St_IntId St_BrId St_TrkId", "StudentExam: SE_StId = St_Id"),
    _path("I-3", "Exam", "Exm_IntId Exm_BrId Exm_TrkId", "StudentExam: SE_ExmId = Exm_Id"),
    _path("I-4", "Question", "Q_CrsId", "ExamQuestion: EQ_QId = Q_Id"),
    _path("I-4", "Exam", "Exm_AsgId", _ON_PAPER),
    _path("I-4", "CourseAssignment", "Asg_CrsId", _EXAMS, _ON_PAPER),
    _path("I-5", "Course", "Crs_MaxDeg", "CourseAssignment: Asg_CrsId = Crs_Id", _EXAMS, _ON_PAPER),
    _path("I-5", "CourseAssignment", "Asg_CrsId", _EXAMS, _ON_PAPER),
    _path("I-5", "Exam", "Exm_AsgId", _ON_PAPER),
    _path("I-6", "CourseAssignment", "Asg_CrsId Asg_InsId", "Question: Q_CrsId = Asg_CrsId, Q_CreatedBy = Asg_InsId"),
    _path("I-7", "Question", "Q_Type", "TFQuestion: TF_QId = Q_Id"),
    _path("I-8", "Question", "Q_Type", "TextQuestion: Txt_QId = Q_Id"),
    _path("I-9", "Question", "Q_Type", "MCQChoice: Ch_QId = Q_Id"),
    _path("I-10", "Question", "Q_Type", "StudentAnswer: Ans_QId = Q_Id"),
    _path("I-10", "MCQChoice", "Ch_QId", "StudentAnswer: Ans_ChoiceId = Ch_Id"),
    _path("I-10", "StudentExam", "SE_ExmId", "StudentAnswer: Ans_SEId = SE_Id"),
    _path("I-10", "ExamQuestion", "EQ_ExmId EQ_QId", "StudentExam: SE_ExmId = EQ_ExmId", "StudentAnswer: Ans_SEId = SE_Id"),
]
assert all(path.steps[-1].child == SUBJECT[path.rule] for path in PATHS)


def changed_rows(before: Tables, after: Tables, parent: str, watched: Iterable[str]) -> DataFrame:
    """Rows of ``parent``, as they were and as they are, that came, went or differ in a watched column."""
    key = TABLES[parent].key
    columns = list(dict.fromkeys([key, *watched]))
    old, new = (tables[parent].select(*columns) for tables in (before, after))
    others = new.select(*[F.col(c).alias(f"_{c}") for c in columns])
    both = old.join(others, F.col(key) == F.col(f"_{key}"), "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    sides = F.array(F.struct(*columns), F.struct(*[F.col(f"_{c}").alias(c) for c in columns]))
    return both.where(~same).select(F.inline(sides)).where(F.col(key).isNotNull())


def resting_on(rows: DataFrame, path: Path, tables: Tables) -> DataFrame:
    """The rows of the path's rule that ``rows`` of its parent reach."""
    for step in path.steps:
        renamed = rows.select(*[F.col(p).alias(f"_{p}") for p in step.parents])
        same = [F.col(c) == F.col(f"_{p}") for c, p in zip(step.columns, step.parents)]
        rows = tables[step.child].join(renamed, same, "left_semi")
    return rows


def stale(before: Tables, after: Tables, parent: str, rules: Iterable[str] | None = None) -> DataFrame:
    """``(rule, key, message)`` of rows that rest on changed rows of ``parent`` and break a rule now."""
    found = None
    for path in PATHS:
        if path.parent == parent and (rules is None or path.rule in rules):
            subject = resting_on(changed_rows(before, after, parent, path.watched), path, after)
            part = AUDITS[path.rule](after, subject)
            found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError(f"no rule rests on {parent}")
    return found
