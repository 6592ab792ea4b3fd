from __future__ import annotations

import datetime as dt
import os
import sys
import uuid
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from invigil.functions.clock import MICROS_PER_HOUR, MICROS_PER_MINUTE  # noqa: E402
from invigil.schema import TABLES  # noqa: E402
from invigil.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def at(hour: int, minute: int = 0) -> int:
    return hour * MICROS_PER_HOUR + minute * MICROS_PER_MINUTE


def moment(hour: int, minute: int = 0, day: int = 8) -> dt.datetime:
    return dt.datetime(2027, 3, day, hour, minute)


DAY = dt.date(2027, 3, 8)
D = Decimal

# A school of crafts: three branches with a track each, three courses, two intakes.  Baking is
# examined in the morning and, for those who come again, in the afternoon; Pia sits both.
# By hand: the morning gives 25 + 15 + 0 = 40, the afternoon so far nothing.
SEED = {
    "Admin": [(1, "root", "Rhea")],
    "TrainingManager": [(1, "lead", "Lars")],
    "Instructor": [
        (1, "kim", "Kim", "kim@example.org", "4411"),
        (2, "lou", "Lou", "lou@example.org", None),
        (3, "mo", "Mo", "mo@example.org", None),
    ],
    "Branch": [(1, "Harbour", "Pier 4"), (2, "Hill", None), (3, "Mill", None)],
    "Intake": [(1, "March", dt.date(2027, 3, 1)), (2, "July", dt.date(2027, 7, 1))],
    "Course": [
        (1, "Baking", "Bread and rolls", D("90.00"), D("45.00")),
        (2, "Sailing", None, D("60.00"), D("30.00")),
        (3, "Weaving", None, D("40.00"), D("20.00")),
    ],
    "Track": [(1, "Bread", 1), (2, "Ropes", 2), (3, "Cloth", 3)],
    "Student": [
        (1, "p1", "Pia", "p1@example.org", None, 1, 1, 1),
        (2, "p2", "Quin", "p2@example.org", "4422", 1, 1, 1),
        (3, "p3", "Rob", "p3@example.org", None, 2, 2, 2),
        (4, "p4", "Sol", "p4@example.org", None, 3, 3, 1),
    ],
    "CourseAssignment": [(1, 1, 1, 2027), (2, 2, 2, 2027), (3, 3, 3, 2027)],
    "Question": [
        (1, 1, "Text", "How long does dough rest?", 1),
        (2, 1, "MCQ", "Which flour has the most gluten?", 1),
        (3, 1, "TF", "Yeast is alive.", 1),
        (4, 1, "MCQ", "Which shelf of the oven is hottest?", 1),
        (5, 2, "TF", "Port is on the left.", 2),
        (6, 2, "MCQ", "Which knot makes a loop?", 2),
        (7, 1, "Text", "Why is salt added?", 1),
        (8, 3, "Text", "What does a shuttle carry?", 3),
    ],
    "MCQChoice": [
        (1, 2, "rye", False), (2, 2, "wheat", True), (3, 2, "rice", False),
        (4, 6, "bowline", True), (5, 6, "reef knot", False),
    ],
    "TFQuestion": [(3, True), (5, True)],
    "TextQuestion": [(1, "Until it has doubled."), (7, "It slows the yeast."), (8, "The weft.")],
    "Exam": [
        (1, 1, "Exam", 1, 1, 1, moment(10), moment(12), 100, None),
        (2, 1, "Corrective", 1, 1, 1, moment(13), moment(16), 150, "Scales"),
        (3, 2, "Exam", 2, 2, 2, moment(10), moment(11), 45, None),
    ],
    "ExamQuestion": [
        (1, 1, 1, D(25)), (2, 1, 2, D(15)), (3, 1, 3, D(30)),
        (4, 2, 1, D(12)), (5, 2, 2, D(8)), (6, 2, 7, D("6.50")),
        (7, 3, 6, D(20)),
    ],
    "StudentExam": [(1, 1, 1, DAY, at(10), at(12), None), (2, 2, 1, DAY, at(13), at(16), None)],
    "StudentAnswer": [
        (1, 1, 1, None, None, " Until it  has DOUBLED.", None, None, None),
        (2, 1, 2, 2, None, None, None, None, None),
        (3, 1, 3, None, False, None, None, None, None),
        (4, 2, 2, 3, None, None, None, None, None),
    ],
}


def frame(spark, table: str, rows):
    """A small table handed over as Arrow, so that its size is known and it can be broadcast."""
    struct = TABLES[table].struct
    schema = to_arrow_schema(struct)
    columns = list(zip(*rows)) or [[]] * len(struct)
    arrays = [pa.array([D(v) if isinstance(v, int) and pa.types.is_decimal(f.type) else v for v in c], f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema), struct)


@pytest.fixture(scope="session")
def seed(spark):
    return {name: frame(spark, name, rows) for name, rows in SEED.items()}


def codes(rejected) -> dict:
    return {r.req_id: r.error_code for r in rejected.collect()}
