"""The seventeen assessment tables, described once as data.

Everything that needs to know a column, a key or a constraint (readers, audits,
request operators) reads it from ``TABLES``.  Nothing is inferred from files.

A column is written ``name:type``; ``!`` marks NOT NULL and a number after a string
type is its declared length.  Times of day are LONG microseconds, surrogate keys are
LONG, and credential columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "time": T.LongType(),
    "string": T.StringType(),
    "degree": T.DecimalType(5, 2),
}

DEGREE = _TYPES["degree"]
TOTAL = T.DecimalType(10, 2)


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    required: bool
    length: int | None


@dataclass(frozen=True)
class Check:
    """A CHECK rule: a row violates it when ``sql`` is false; NULL passes."""

    name: str
    sql: str


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    columns: tuple[Column, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, str] = field(default_factory=dict)
    checks: tuple[Check, ...] = ()

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, _TYPES[c.type], True) for c in self.columns])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


def _column(spec: str) -> Column:
    name, kind = spec.split(":")
    base, bang, length = kind.partition("!")
    if not bang:
        base, _, length = kind.partition("?")
    return Column(name, base, bool(bang), int(length) if length else None)


def _table(name, columns, unique=(), references=None, checks=()):
    cols = tuple(_column(c) for c in columns.split())
    return Table(
        name,
        cols[0].name,
        cols,
        tuple(tuple(u.split()) for u in unique),
        references or {},
        tuple(Check(*c) for c in checks),
    )


# Table names, column names, types, keys and constraint conditions.
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        _table("Admin", "Adm_Id:long! Adm_User:string!50 Adm_Name:string!100", ["Adm_User"]),
        _table("TrainingManager", "Mgr_Id:long! Mgr_User:string!50 Mgr_Name:string!100", ["Mgr_User"]),
        _table(
            "Instructor",
            "Ins_Id:long! Ins_User:string!50 Ins_Name:string!100 Ins_Email:string!100 Ins_Phone:string?20",
            ["Ins_User", "Ins_Email"],
        ),
        _table("Branch", "Br_Id:long! Br_Name:string!100 Br_Location:string?200", ["Br_Name"]),
        _table("Intake", "Int_Id:long! Int_Name:string!50 Int_StartDate:date!", ["Int_Name"]),
        _table(
            "Course",
            "Crs_Id:long! Crs_Name:string!100 Crs_Desc:string Crs_MaxDeg:degree! Crs_MinDeg:degree!",
            ["Crs_Name"],
            checks=[("Crs_Degrees", "Crs_MinDeg >= 0 AND Crs_MinDeg <= Crs_MaxDeg")],
        ),
        _table(
            "Track",
            "Trk_Id:long! Trk_Name:string!100 Trk_BrId:long!",
            ["Trk_Name Trk_BrId"],
            {"Trk_BrId": "Branch"},
        ),
        _table(
            "Student",
            "St_Id:long! St_User:string!50 St_Name:string!100 St_Email:string!100 St_Phone:string?20 "
            "St_BrId:long! St_TrkId:long! St_IntId:long!",
            ["St_User", "St_Email"],
            {"St_BrId": "Branch", "St_TrkId": "Track", "St_IntId": "Intake"},
        ),
        _table(
            "CourseAssignment",
            "Asg_Id:long! Asg_CrsId:long! Asg_InsId:long! Asg_Year:int!",
            ["Asg_CrsId Asg_Year"],
            {"Asg_CrsId": "Course", "Asg_InsId": "Instructor"},
        ),
        _table(
            "Question",
            "Q_Id:long! Q_CrsId:long! Q_Type:string!10 Q_Text:string! Q_CreatedBy:long!",
            (),
            {"Q_CrsId": "Course", "Q_CreatedBy": "Instructor"},
            [("Q_Type", "Q_Type IN ('MCQ', 'TF', 'Text')")],
        ),
        _table(
            "MCQChoice",
            "Ch_Id:long! Ch_QId:long! Ch_Text:string!500 Ch_Correct:bool!",
            (),
            {"Ch_QId": "Question"},
        ),
        _table("TFQuestion", "TF_QId:long! TF_Correct:bool!", (), {"TF_QId": "Question"}),
        _table("TextQuestion", "Txt_QId:long! Txt_BestAnswer:string!", (), {"Txt_QId": "Question"}),
        _table(
            "Exam",
            "Exm_Id:long! Exm_AsgId:long! Exm_Type:string!20 Exm_IntId:long! Exm_BrId:long! Exm_TrkId:long! "
            "Exm_Start:datetime! Exm_End:datetime! Exm_TotalTime:int! Exm_Allowance:string?500",
            (),
            {"Exm_AsgId": "CourseAssignment", "Exm_IntId": "Intake", "Exm_BrId": "Branch", "Exm_TrkId": "Track"},
            [
                ("Exm_Type", "Exm_Type IN ('Exam', 'Corrective')"),
                ("Exm_Times", "Exm_End > Exm_Start"),
                ("Exm_TotalTime", "Exm_TotalTime > 0"),
            ],
        ),
        _table(
            "ExamQuestion",
            "EQ_Id:long! EQ_ExmId:long! EQ_QId:long! EQ_Degree:degree!",
            ["EQ_ExmId EQ_QId"],
            {"EQ_ExmId": "Exam", "EQ_QId": "Question"},
            [("EQ_Degree", "EQ_Degree > 0")],
        ),
        _table(
            "StudentExam",
            "SE_Id:long! SE_ExmId:long! SE_StId:long! SE_Date:date! SE_Start:time! SE_End:time! SE_Result:degree",
            ["SE_ExmId SE_StId"],
            {"SE_ExmId": "Exam", "SE_StId": "Student"},
            [
                ("SE_Times", "SE_End > SE_Start"),
                ("SE_Result", "SE_Result IS NULL OR SE_Result >= 0"),
            ],
        ),
        _table(
            "StudentAnswer",
            "Ans_Id:long! Ans_SEId:long! Ans_QId:long! Ans_ChoiceId:long Ans_BoolAns:bool Ans_TextAns:string "
            "Ans_Correct:bool Ans_Degree:degree Ans_Comment:string?500",
            ["Ans_SEId Ans_QId"],
            {"Ans_SEId": "StudentExam", "Ans_QId": "Question", "Ans_ChoiceId": "MCQChoice"},
            [("Ans_Degree", "Ans_Degree IS NULL OR Ans_Degree >= 0")],
        ),
    )
}

# The three question types.
MCQ, TF, TEXT = "MCQ", "TF", "Text"
