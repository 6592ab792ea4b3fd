"""Request batches and rule-breaking tables, derived from the given files.

Formulas are fixed and integer only; ``oracle_inputs`` states them again in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invigil.functions.clock import MICROS_PER_HOUR, at_time
from invigil.schema import MCQ, TABLES, TEXT, TF
from invigil.sources.star import Star, every, files
from invigil.sources.tables import Tables, conform, replace

UNKNOWN = 9999


def _days_from(first: str, offset: Column, hour: int) -> Column:
    return at_time(F.date_add(F.lit(first).cast("date"), offset.cast("int")), F.lit(hour * MICROS_PER_HOUR))


# -- request batches ---------------------------------------------------------------------


def question_requests(t: Star) -> DataFrame:
    q = t.Question.join(t.file("part").select(F.col("p_partkey").alias("Q_Id"), "p_size"), "Q_Id")
    return q.select(
        F.col("Q_Id").alias("req_id"),
        "Q_CrsId",
        F.when(every(10, F.col("p_size")), "Essay").otherwise(F.col("Q_Type")).alias("Q_Type"),
        F.when(~every(61, F.col("Q_Id")), F.col("Q_Text")).alias("Q_Text"),
        "Q_CreatedBy",
    )


def random_exam_requests(t: Star) -> DataFrame:
    c = F.col("St_Id")
    start = _days_from("2024-03-01", c % 28, 9)
    return t.Student.select(
        c.alias("req_id"),
        F.when(every(19, c), UNKNOWN).otherwise(1 + c % 175).cast("long").alias("Exm_AsgId"),
        F.when(every(83, c), "Quiz").when(every(4, c), "Corrective").otherwise("Exam").alias("Exm_Type"),
        F.when(every(89, c), 99).otherwise(F.col("St_IntId")).cast("long").alias("Exm_IntId"),
        F.col("St_BrId").cast("long").alias("Exm_BrId"),
        F.col("St_TrkId").cast("long").alias("Exm_TrkId"),
        start.alias("Exm_Start"),
        F.timestamp_add("HOUR", F.when(every(31, c), -1).otherwise(3), start).alias("Exm_End"),
        F.when(every(37, c), 0).otherwise(90).cast("int").alias("Exm_TotalTime"),
        F.lit(None).cast("string").alias("Exm_Allowance"),
        F.when(every(23, c), -1).when(every(43, c), 60).otherwise(c % 4).cast("int").alias("n_mcq"),
        F.when(every(47, c), 60).otherwise(c % 3).cast("int").alias("n_tf"),
        F.when(every(53, c), 60).otherwise(c % 2).cast("int").alias("n_text"),
        F.when(every(29, c), 0)
        .when(every(41, c), 40)
        .when(every(43, c) | every(47, c) | every(53, c), 0.5)
        .otherwise(5)
        .cast("decimal(5,2)")
        .alias("degree"),
    )


def manual_exam_requests(t: Star) -> DataFrame:
    o = F.col("o_orderkey")
    start = _days_from("2024-02-01", o % 28, 9)
    return t.file("orders").join(t.Student, F.col("o_custkey") == F.col("St_Id")).select(
        o.alias("req_id"),
        F.when(every(71, o), UNKNOWN).otherwise(1 + o % 175).cast("long").alias("Exm_AsgId"),
        F.when(every(103, o), "Quiz").when(every(4, o), "Corrective").otherwise("Exam").alias("Exm_Type"),
        F.col("St_IntId").cast("long").alias("Exm_IntId"),
        F.col("St_BrId").cast("long").alias("Exm_BrId"),
        F.col("St_TrkId").cast("long").alias("Exm_TrkId"),
        start.alias("Exm_Start"),
        F.timestamp_add("HOUR", F.when(every(107, o), 0).otherwise(3), start).alias("Exm_End"),
        F.lit(90).alias("Exm_TotalTime"),
        F.lit("Books").alias("Exm_Allowance"),
    )


def manual_exam_lists(t: Star) -> DataFrame:
    return t.keep("manual_exam_list", lambda: _manual_exam_lists(t))


def _manual_exam_lists(t: Star) -> DataFrame:
    o = F.col("l_orderkey")
    line = t.file("lineitem").select(
        o.alias("req_id"),
        (o % 175 % 25 + 1).alias("crs"),
        (o * 7 + F.col("l_linenumber") - 1).alias("place"),
        "l_partkey",
        "l_suppkey",
        (F.col("l_quantity").cast("int") * F.lit("0.60").cast("decimal(3,2)")).cast("decimal(5,2)").alias("degree"),
    )
    ranked = t.ranked.select("Q_CrsId", "rn", "Q_Id")
    raw = F.when(~every(43, F.col("l_suppkey")), F.col("Q_Id"))
    line = line.join(t.pool, F.col("crs") == F.col("pool_crs"), "left").withColumn("at", F.col("place") % F.col("pool_size"))
    return line.join(ranked, (F.col("crs") == F.col("Q_CrsId")) & (F.col("at") == F.col("rn")), "left").select(
        "req_id", F.coalesce(raw, "l_partkey").alias("QId"), "degree"
    )


def seat_requests(t: Star) -> DataFrame:
    s, start = F.col("SE_Id"), F.col("SE_Start")
    return t.StudentExam.select(
        s.alias("req_id"),
        (F.col("SE_ExmId") + F.when(every(59, s), 100000).otherwise(0)).cast("long").alias("SE_ExmId"),
        "SE_StId",
        "SE_Date",
        (start - F.when(every(67, s), MICROS_PER_HOUR).otherwise(0)).alias("SE_Start"),
        F.when(every(61, s), start).otherwise(F.col("SE_End")).alias("SE_End"),
    )


def _orders(t: Star, status: str, key: str) -> DataFrame:
    return t.file("orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias(key))


def seats_already(t: Star) -> Tables:
    """Seats of open orders are there already."""
    return replace(t, StudentExam=t["StudentExam"].join(_orders(t, "P", "SE_Id"), "SE_Id", "left_semi"))


def _submissions(t: Star) -> DataFrame:
    """Everything sent in, derived once for the batch and for the answers where these are not there yet."""
    return t.Submission if t.has("latest") and not t.has("submitted") else t.submitted


def answer_requests(t: Star) -> DataFrame:
    return t.keep("answer_request", lambda: _answer_requests(t), dense=True)


#: Input bytes per file of submissions that come in, and the fewest files.
INCOMING_BYTES = 128 << 20
LEAST_INCOMING = 9


def incoming(t: Star) -> str:
    """The folder of ``answer_requests`` as they come in: the same rows in files of some size.

    A micro-batch takes a number of files and reads the seats and questions anew, so files that shrink
    as tasks become more would multiply that.
    """
    n_bytes = sum(size for _, size, _ in files(t.spark, f"{t.sf_dir}/lineitem.parquet"))
    n_files = max(LEAST_INCOMING, -(-n_bytes // INCOMING_BYTES))
    t.keep("answer_incoming", lambda: answer_requests(t).coalesce(n_files), dense=True)
    return t.path("answer_incoming")


def _answer_requests(t: Star) -> DataFrame:
    sup = F.col("l_suppkey")
    req = F.concat_ws(
        "-",
        "Ans_SEId",
        "pos",
        F.date_format("l_shipdate", "yyyyMMdd"),
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("long"),
        F.round(F.col("l_extendedprice") * 100).cast("long"),
    )
    return _submissions(t).select(
        req.alias("req_id"),
        "submitted_at",
        (F.col("Ans_SEId") + F.when(every(43, sup, 3), 1_000_000_000).otherwise(0)).cast("long").alias("Ans_SEId"),
        "Ans_QId",
        "Ans_ChoiceId",
        "Ans_BoolAns",
        "Ans_TextAns",
    )


def some_answers(t: Star) -> Tables:
    """Seats of finished orders have answers, with grades from an earlier run.

    Submissions may crowd on one seat, so the seats are read plainly.
    """
    _submissions(t)
    old = t["StudentAnswer"].join(_orders(t, "F", "Ans_SEId"), "Ans_SEId", "left_semi")
    graded = old.withColumn("Ans_Correct", every(2, F.col("Ans_Id"))).withColumn("Ans_Degree", F.lit(1))
    seats = conform(t.plain("StudentExam"), "StudentExam")
    return replace(t, StudentAnswer=conform(graded, "StudentAnswer"), StudentExam=seats)


def marks(t: Star) -> DataFrame:
    return t.latest.where(F.col("q_type") == TEXT).select(
        F.col("Ans_Id").alias("req_id"),
        (F.col("Ans_Id") + F.when(every(43, F.col("l_suppkey"), 3), 10_000_000_000).otherwise(0)).alias("Ans_Id"),
        (F.col("l_quantity").cast("int") * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(5,2)").alias("degree"),
        F.concat(F.lit("mark "), F.col("l_quantity").cast("int")).alias("comment"),
    )


def grade_requests(t: Star) -> DataFrame:
    o = F.col("o_orderkey")
    return t.file("orders").select(
        o.alias("req_id"), (o + F.when(every(43, o, 3), 1_000_000_000).otherwise(0)).cast("long").alias("SE_Id")
    )


def branch_requests(t: Star) -> DataFrame:
    s = F.col("s_suppkey")
    name = F.concat(F.lit("Branch "), F.floor(s / 2).cast("string"))
    return t.file("supplier").select(
        s.alias("req_id"),
        F.when(every(11, s), F.lit(None))
        .when(every(13, s), F.repeat(F.lit("x"), F.lit(101)))
        .when(every(7, s), "ASIA")
        .when(every(17, s), F.concat(name, F.lit(" ")))
        .otherwise(name)
        .alias("Br_Name"),
        F.concat(F.lit("Loc "), s).alias("Br_Location"),
    )


def more_branches(t: Star) -> Tables:
    s = F.col("s_suppkey")
    sites = t.file("supplier").select(
        (s + 100).alias("Br_Id"), F.concat(F.lit("Site "), s).alias("Br_Name"), F.lit(None).alias("Br_Location")
    )
    return replace(t, Branch=t["Branch"].unionByName(conform(sites, "Branch")))


def branch_changes(t: Star) -> DataFrame:
    c, n = F.col("c_custkey"), t.n_suppliers
    return t.file("customer").select(
        c.alias("req_id"),
        (100 + c % (n + 5)).alias("Br_Id"),
        F.when(every(5, c), F.concat(F.lit("Site "), (c % n).cast("string")))
        .when(every(5, c, 1), F.concat(F.lit("Name "), (c % 50).cast("string")))
        .otherwise(F.concat(F.lit("Name "), c.cast("string")))
        .alias("Br_Name"),
        F.concat(F.lit("L"), c).alias("Br_Location"),
    )


def track_requests(t: Star) -> DataFrame:
    c = F.col("c_custkey")
    return t.file("customer").select(
        c.alias("req_id"),
        F.when(every(10, c), "NATION_1").otherwise(F.concat(F.lit("Track "), (c % 300).cast("string"))).alias("Trk_Name"),
        (c % 7 + 1).alias("Trk_BrId"),
    )


def more_tracks(t: Star) -> Tables:
    s = F.col("s_suppkey")
    tracks = t.file("supplier").select(
        (s + 1000).alias("Trk_Id"), F.concat(F.lit("T "), s).alias("Trk_Name"), (s % 5 + 1).alias("Trk_BrId")
    )
    return replace(t, Track=t["Track"].unionByName(conform(tracks, "Track")))


def track_changes(t: Star) -> DataFrame:
    c, n = F.col("c_custkey"), t.n_suppliers
    return t.file("customer").select(
        c.alias("req_id"),
        (1000 + c % (n + 3)).alias("Trk_Id"),
        F.when(every(4, c), F.concat(F.lit("T "), (c % n).cast("string")))
        .otherwise(F.concat(F.lit("U "), (c % 97).cast("string")))
        .alias("Trk_Name"),
        (c % 6 + 1).alias("Trk_BrId"),
    )


def intake_requests(t: Star) -> DataFrame:
    c = F.col("c_custkey")
    return t.file("customer").select(
        c.alias("req_id"),
        F.when(every(10, c), F.col("c_mktsegment"))
        .when(every(37, c), F.repeat(F.lit("y"), F.lit(51)))
        .otherwise(F.concat(F.lit("Intake "), F.floor(c / 3).cast("string")))
        .alias("Int_Name"),
        F.when(~every(31, c), F.date_add(F.lit("2025-01-01").cast("date"), (c % 365).cast("int"))).alias("Int_StartDate"),
    )


def student_requests(t: Star) -> DataFrame:
    c = F.col("St_Id")
    return t.Student.select(
        c.alias("req_id"),
        F.when(every(41, c), F.concat(F.lit("st_"), (c + 1).cast("string")))
        .when(every(3, c), F.concat(F.lit("new_"), (c % 100).cast("string")))
        .otherwise(F.concat(F.lit("new_"), c.cast("string")))
        .alias("St_User"),
        "St_Name",
        F.concat(F.lit("m"), F.when(every(5, c), c % 70).otherwise(c).cast("string"), F.lit("@example.org")).alias("St_Email"),
        "St_Phone",
        F.col("St_BrId").cast("long").alias("St_BrId"),
        F.col("St_TrkId").cast("long").alias("St_TrkId"),
        F.when(every(89, c), 99).otherwise(F.col("St_IntId")).cast("long").alias("St_IntId"),
    )


def student_changes(t: Star) -> DataFrame:
    o = F.col("o_orderkey")
    mail = (
        F.when(every(6, o), F.concat(F.lit("st_"), (o % 150).cast("string")))
        .when(every(6, o, 1), F.concat(F.lit("dup"), (o % 200).cast("string")))
        .otherwise(F.concat(F.lit("e"), o.cast("string")))
    )
    return t.file("orders").join(t.Student, F.col("o_custkey") == F.col("St_Id")).select(
        o.alias("req_id"),
        (F.col("o_custkey") + F.when(every(53, o), 10_000_000).otherwise(0)).cast("long").alias("St_Id"),
        F.concat(F.lit("N"), o).alias("St_Name"),
        F.concat(mail, F.lit("@example.org")).alias("St_Email"),
        F.lit(None).cast("string").alias("St_Phone"),
        F.col("St_BrId").cast("long").alias("St_BrId"),
        F.col("St_TrkId").cast("long").alias("St_TrkId"),
        F.when(every(89, o), 99).otherwise(F.col("St_IntId")).cast("long").alias("St_IntId"),
    )


# -- rule-breaking tables ----------------------------------------------------------------


def _swap(t: Tables, name: str, df: DataFrame) -> dict:
    return replace(t, **{name: conform(df, name)})


def bad_exams(t: Tables) -> Tables:
    branch = F.when(every(499, F.col("Exm_Id")), F.col("Exm_BrId") % 5 + 1).otherwise(F.col("Exm_BrId"))
    return _swap(t, "Exam", t["Exam"].withColumn("Exm_BrId", branch))


def bad_exam_questions(t: Tables, part: DataFrame) -> Tables:
    n = part.agg(F.count("*")).scalar()
    hit = every(97, F.col("EQ_ExmId") + F.col("EQ_QId"))
    moved = F.when(hit, (F.col("EQ_QId") + 1) % n).otherwise(F.col("EQ_QId"))
    return _swap(t, "ExamQuestion", t["ExamQuestion"].withColumn("EQ_QId", moved))


def _odd_questions(t: Star, kind: str, rest: int) -> DataFrame:
    return t.Question.where((F.col("Q_Type") == kind) & every(13, F.col("Q_Id"), rest))


def bad_tf(t: Star) -> Tables:
    more = _odd_questions(t, MCQ, 0).select(F.col("Q_Id").alias("TF_QId"), F.lit(False).alias("TF_Correct"))
    return _swap(t, "TFQuestion", t["TFQuestion"].unionByName(more))


def bad_text(t: Star) -> Tables:
    more = _odd_questions(t, TF, 1).select(F.col("Q_Id").alias("Txt_QId"), F.lit("x").alias("Txt_BestAnswer"))
    return _swap(t, "TextQuestion", t["TextQuestion"].unionByName(more))


def bad_choices(t: Star) -> Tables:
    q = F.col("Ch_QId")
    second = every(13, q, 3) & (F.col("Ch_Id") % 4 == (q + 1) % 4)
    choices = t["MCQChoice"].withColumn("Ch_Correct", F.col("Ch_Correct") | second)
    more = _odd_questions(t, TEXT, 2).select(
        (F.col("Q_Id") * 4).alias("Ch_Id"), F.col("Q_Id").alias("Ch_QId"), F.lit("x").alias("Ch_Text"),
        F.lit(False).alias("Ch_Correct"),
    )
    return _swap(t, "MCQChoice", choices.unionByName(more))


def bad_answers(t: Star) -> Tables:
    sup = F.col("l_suppkey")
    text = F.when(every(13, sup, 5) & (F.col("q_type") != TEXT), "x").otherwise(F.col("Ans_TextAns"))
    moved = F.when(every(17, sup, 4), F.col("Ans_QId") + 1).otherwise(F.col("Ans_QId"))
    return _swap(t, "StudentAnswer", t.latest.withColumn("Ans_TextAns", text).withColumn("Ans_QId", moved))


def broken_checks(t: Star) -> Tables:
    def when(key: str, n: int, column: str, value: Column) -> Column:
        return F.when(every(n, F.col(key)), value).otherwise(F.col(column))

    changed = {
        **_swap_one(t, "Course", "Crs_MinDeg", when("Crs_Id", 7, "Crs_MinDeg", F.col("Crs_MaxDeg") + 1)),
        **_swap_one(t, "Question", "Q_Type", when("Q_Id", 71, "Q_Type", F.lit("Essay"))),
        **_swap_one(t, "ExamQuestion", "EQ_Degree", when("EQ_Id", 73, "EQ_Degree", F.lit(0))),
        **_swap_one(t, "StudentExam", "SE_Result", when("SE_Id", 79, "SE_Result", F.lit(-1))),
        **_swap_one(t, "StudentAnswer", "Ans_Degree", when("Ans_Id", 83, "Ans_Degree", F.lit(-1))),
    }
    return replace(t, **changed)


def _swap_one(t: Star, table: str, column: str, value: Column) -> dict:
    return {table: conform(t[table].withColumn(column, value), table)}


SMALL = ("Admin", "TrainingManager", "Branch", "Intake", "Course", "Track")


def broken_keys(t: Star) -> Tables:
    """Some rows twice under one id, some again under another id, one set per unique key."""
    out = {}
    for name, spec in TABLES.items():
        rows, key = t[name], F.col(spec.key)
        n = 3 if name in SMALL else 59
        out[name] = rows.unionByName(rows.where(every(n, key)))
        for u in range(1, len(spec.unique) + 1):
            again = rows.where(every(n, key, u)).withColumn(spec.key, key + 1_000_000_000_000 * u)
            out[name] = out[name].unionByName(again)
    return out


def broken_references(t: Star) -> Tables:
    out = dict(t)
    for name, spec in TABLES.items():
        rows = t[name]
        for j, column in enumerate(spec.references, start=1):
            if column != spec.key:
                away = F.when(every(37 + 4 * j, F.col(spec.key), j), F.col(column) + 1_000_000_000_000)
                rows = rows.withColumn(column, away.otherwise(F.col(column)))
            else:
                rows = rows.withColumn(column, F.when(every(41, F.col(column), 1), -F.col(column) - 1).otherwise(F.col(column)))
        if spec.references:
            out[name] = rows
    return out


def broken_values(t: Star) -> Tables:
    out = {}
    for name, spec in TABLES.items():
        key = F.col(spec.key)
        columns = [key]
        for i, c in enumerate(spec.columns):
            if i == 0:
                continue
            value = F.when(every(47, key, i), F.lit(None)) if c.required else None
            if c.length:
                long = F.repeat(F.lit("x"), F.lit(c.length + 1))
                value = value.when(every(43, key, i), long) if value is not None else F.when(every(43, key, i), long)
            columns.append(F.col(c.name) if value is None else value.otherwise(F.col(c.name)).alias(c.name))
        out[name] = t[name].select(*columns)
    return out

