"""Tables laid out by range, so that a search for a stretch of them skips the rest.

Rows are dealt to files by ranges of their sort key and sorted in each; the smallest and largest
key of every file (and of every row group in it) then stand in its footer, and a filter on the key reaches the scan and skips
what lies outside.  The number of files follows the number of rows.  A task writes as many files as its rows fill: Spark samples
every range at the driver, so there are far fewer ranges than small files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invigil.sources.tables import Tables, conform, replace

ROWS_PER_FILE = 4_000_000
#: Rows that one task sorts, where files are smaller; it writes several files then.
ROWS_PER_TASK = 250_000

#: The day of an exam's start, as a column of laid-out exams and of their questions.
EXAM_DAY = {"Exam": "Exm_Day", "ExamQuestion": "EQ_Day"}


def write_ranged(df: DataFrame, path: str, *keys: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write ``df`` by ranges of ``keys`` and return the table that was written."""
    n_ranges = max(1, -(-df.count() // max(rows_per_file, ROWS_PER_TASK)))
    ranged = df.repartitionByRange(n_ranges, *keys).sortWithinPartitions(*keys)
    ranged.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lay_out_exams(tables: Tables, root: str, rows_per_file: int = ROWS_PER_FILE) -> Tables:
    """``tables`` with exams, and exam questions, by the day of the exam's start, which both carry along.

    Questions without an exam have no day and lie apart from the others.
    """
    on, of = EXAM_DAY["Exam"], EXAM_DAY["ExamQuestion"]
    exams = conform(tables["Exam"], "Exam").withColumn(on, F.col("Exm_Start").cast("date"))
    exams = write_ranged(exams, f"{root}/Exam", on, "Exm_Id", rows_per_file=rows_per_file)
    days = exams.select(F.col("Exm_Id").alias("_exam"), F.col(on).alias(of))
    questions = conform(tables["ExamQuestion"], "ExamQuestion").join(days, F.col("EQ_ExmId") == F.col("_exam"), "left").drop("_exam")
    questions = write_ranged(questions, f"{root}/ExamQuestion", of, "EQ_ExmId", rows_per_file=rows_per_file)
    return replace(tables, Exam=exams, ExamQuestion=questions)
