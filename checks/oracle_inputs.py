"""Request batches, their verdicts and rule-breaking tables in SQL."""

from __future__ import annotations

from checks.oracle_tables import CTES, cte
from invigil.messages import message
from invigil.schema import TABLES

# Subquery of each table.
SUBQUERY = {
    "Admin": "t_admin",
    "TrainingManager": "t_manager",
    "Instructor": "t_instructor",
    "Branch": "t_branch",
    "Intake": "t_intake",
    "Course": "t_course",
    "Track": "t_track",
    "Student": "t_student",
    "CourseAssignment": "t_assignment",
    "Question": "t_question",
    "MCQChoice": "t_choice",
    "TFQuestion": "t_tf",
    "TextQuestion": "t_text",
    "Exam": "t_exam",
    "ExamQuestion": "t_examquestion",
    "StudentExam": "t_seat",
    "StudentAnswer": "t_answer",
}


def texts(codes: str) -> str:
    """``error_message`` for the blank-separated codes."""
    cases = " ".join(f"WHEN '{c}' THEN '{message(c)}'" for c in codes.split())
    return f"CASE error_code {cases} END AS error_message"


def rejected(judged: str, codes: str) -> str:
    return f"SELECT req_id, error_code, {texts(codes)} FROM {judged} WHERE error_code IS NOT NULL"


def replayed(number: int, key: str, value: str, table: str) -> None:
    """``j<number>``: the requests of ``j<number>a``, one after the other, each on what those before it left.

    ``holders`` says which row holds each value that more than one row ever wants or has.
    """
    n = number
    cte(f"a{n}", f"SELECT *, {value} AS wanted, {key} AS own FROM j{n}a WHERE there AND code IS NULL")
    cte(
        f"v{n}",
        f"""
SELECT wanted, row_number() OVER (ORDER BY wanted) AS k, min(own) FILTER (held) AS holder
FROM (SELECT wanted, own, false AS held FROM a{n} UNION ALL SELECT {value}, {key}, true FROM {table}) u
WHERE wanted IN (SELECT wanted FROM a{n}) GROUP BY wanted HAVING count(DISTINCT own) > 1""",
    )
    cte(f"q{n}", f"SELECT a.req_id, a.own, v.k, row_number() OVER (ORDER BY a.req_id) AS turn FROM a{n} a LEFT JOIN v{n} v ON v.wanted = a.wanted")
    cte(
        f"s{n}",
        f"""
SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS req_id, false AS ok, (SELECT list(holder ORDER BY k) FROM v{n}) AS holders
UNION ALL
SELECT turn, req_id, free, CASE WHEN free THEN list_transform(holders, lambda h, i: CASE WHEN i = k THEN own WHEN h = own THEN NULL ELSE h END)
    ELSE holders END
FROM (SELECT q{n}.*, holders, k IS NULL OR coalesce(holders[k], own) = own AS free FROM s{n} JOIN q{n} ON q{n}.turn = s{n}.turn + 1) q""",
    )
    cte(
        f"j{n}",
        f"""
SELECT a.*, CASE WHEN code IS NULL AND NOT ok THEN 'I-12' ELSE code END AS error_code
FROM j{n}a a LEFT JOIN (SELECT req_id, ok FROM s{n}) s ON s.req_id = a.req_id""",
    )


NORM = "rtrim(regexp_replace(translate(lower(trim({})), chr(9) || chr(10) || chr(13), '   '), ' {{2,}}', ' ', 'g'))"

# -- questions ---------------------------------------------------------------------------

cte(
    "r1",
    """
SELECT Q_Id AS req_id, Q_CrsId, CASE WHEN p_size % 10 = 0 THEN 'Essay' ELSE Q_Type END AS Q_Type,
       CASE WHEN Q_Id % 61 <> 0 THEN Q_Text END AS Q_Text, Q_CreatedBy
FROM t_question JOIN part ON p_partkey = Q_Id""",
)
cte(
    "j1",
    """
SELECT *, CASE
  WHEN NOT EXISTS (SELECT 1 FROM t_assignment WHERE Asg_CrsId = Q_CrsId AND Asg_InsId = Q_CreatedBy) THEN '50001'
  WHEN Q_Type NOT IN ('MCQ', 'TF', 'Text') THEN '50002'
  WHEN Q_Text IS NULL THEN 'I-15' END AS error_code
FROM r1""",
)
cte(
    "new1",
    """
SELECT (SELECT max(Q_Id) FROM t_question) + row_number() OVER (ORDER BY req_id) AS Q_Id, Q_CrsId, Q_Type, Q_Text, Q_CreatedBy
FROM j1 WHERE error_code IS NULL""",
)

# -- random exams ------------------------------------------------------------------------

cte(
    "r2",
    """
SELECT St_Id AS req_id, CASE WHEN St_Id % 19 = 0 THEN 9999 ELSE 1 + St_Id % 175 END AS Exm_AsgId,
       CASE WHEN St_Id % 83 = 0 THEN 'Quiz' WHEN St_Id % 4 = 0 THEN 'Corrective' ELSE 'Exam' END AS Exm_Type,
       CASE WHEN St_Id % 89 = 0 THEN 99 ELSE St_IntId END AS Exm_IntId, St_BrId AS Exm_BrId, St_TrkId AS Exm_TrkId,
       TIMESTAMP '2024-03-01 09:00:00' + to_days(CAST(St_Id % 28 AS INTEGER)) AS Exm_Start,
       TIMESTAMP '2024-03-01 09:00:00' + to_days(CAST(St_Id % 28 AS INTEGER))
         + CASE WHEN St_Id % 31 = 0 THEN INTERVAL '-1 hour' ELSE INTERVAL '3 hour' END AS Exm_End,
       CAST(CASE WHEN St_Id % 37 = 0 THEN 0 ELSE 90 END AS INTEGER) AS Exm_TotalTime, CAST(NULL AS VARCHAR) AS Exm_Allowance,
       CASE WHEN St_Id % 23 = 0 THEN -1 WHEN St_Id % 43 = 0 THEN 60 ELSE St_Id % 4 END AS n_mcq,
       CASE WHEN St_Id % 47 = 0 THEN 60 ELSE St_Id % 3 END AS n_tf,
       CASE WHEN St_Id % 53 = 0 THEN 60 ELSE St_Id % 2 END AS n_text,
       CAST(CASE WHEN St_Id % 29 = 0 THEN 0 WHEN St_Id % 41 = 0 THEN 40
                 WHEN St_Id % 43 = 0 OR St_Id % 47 = 0 OR St_Id % 53 = 0 THEN 0.5 ELSE 5 END AS DECIMAL(5,2)) AS degree
FROM t_student""",
)
cte("pool", "SELECT Q_CrsId, Q_Type, count(*) AS size FROM t_question GROUP BY ALL")
cte(
    "j2",
    """
SELECT *, CASE
  WHEN Asg_Id IS NULL THEN '50010'
  WHEN n_mcq < 0 OR n_tf < 0 OR n_text < 0 THEN '50011'
  WHEN degree <= 0 THEN '50012'
  WHEN Exm_Start >= Exm_End THEN '50013'
  WHEN Exm_TotalTime <= 0 THEN '50014'
  WHEN n_mcq + n_tf + n_text = 0 THEN '50015'
  WHEN (n_mcq + n_tf + n_text) * degree > Crs_MaxDeg THEN '50016'
  WHEN coalesce((SELECT size FROM pool p WHERE p.Q_CrsId = Asg_CrsId AND Q_Type = 'MCQ'), 0) < n_mcq THEN '50017'
  WHEN coalesce((SELECT size FROM pool p WHERE p.Q_CrsId = Asg_CrsId AND Q_Type = 'TF'), 0) < n_tf THEN '50018'
  WHEN coalesce((SELECT size FROM pool p WHERE p.Q_CrsId = Asg_CrsId AND Q_Type = 'Text'), 0) < n_text THEN '50019'
  WHEN Exm_Type NOT IN ('Exam', 'Corrective') THEN 'I-11'
  WHEN Exm_IntId NOT IN (SELECT Int_Id FROM t_intake) THEN 'I-14'
  WHEN Exm_BrId <> (SELECT Trk_BrId FROM t_track WHERE Trk_Id = Exm_TrkId) THEN 'I-2' END AS error_code
FROM r2 LEFT JOIN t_assignment ON Asg_Id = Exm_AsgId LEFT JOIN t_course c ON c.Crs_Id = Asg_CrsId""",
)
cte("r2d", "SELECT * REPLACE (0 AS n_tf, 0 AS n_text, CAST(1 AS DECIMAL(5,2)) AS degree) FROM r2")
cte("j2d", CTES["j2"].replace("FROM r2 ", "FROM r2d "))
cte(
    "new2",
    """
SELECT (SELECT max(Exm_Id) FROM t_exam) + row_number() OVER (ORDER BY req_id) AS Exm_Id, *
FROM j2 WHERE error_code IS NULL""",
)
cte(
    "want2",
    """
SELECT req_id, Exm_Id, degree, w.Q_CrsId, w.Q_Type, n, size, '7-' || req_id || '-' || w.Q_Type AS draw_seed
FROM (SELECT req_id, Exm_Id, degree, Asg_CrsId AS Q_CrsId, 'MCQ' AS Q_Type, n_mcq AS n FROM new2
      UNION ALL SELECT req_id, Exm_Id, degree, Asg_CrsId, 'TF', n_tf FROM new2
      UNION ALL SELECT req_id, Exm_Id, degree, Asg_CrsId, 'Text', n_text FROM new2) w
JOIN pool ON pool.Q_CrsId = w.Q_CrsId AND pool.Q_Type = w.Q_Type WHERE n > 0""",
)
def _permuted(at: str) -> str:
    """One step of the network on a table of ``up`` by ``across`` cells."""
    cell = f"{{'up': {at} // wide, 'across': {at} % wide}}"
    for turn in range(4):
        own, other, limit = ("up", "across", "high") if turn % 2 == 0 else ("across", "up", "wide")
        number = f"CAST('0x' || substr(md5(draw_seed || '-{turn}-' || c.{other}), 1, 15) AS BIGINT) % {limit}"
        moved = f"'{own}': (c.{own} + {number}) % {limit}, '{other}': c.{other}"
        order = moved if own == "up" else f"'up': c.up, 'across': (c.across + {number}) % {limit}"
        cell = f"list_transform([{cell}], lambda c: {{{order}}})[1]"
    return f"list_transform([{cell}], lambda c: c.up * wide + c.across)[1]"


cte(
    "cells2",
    """
SELECT *, CAST(ceil(size / high) AS BIGINT) AS wide
FROM (SELECT *, CAST(ceil(sqrt(size)) AS BIGINT) AS high, unnest(range(CAST(n AS BIGINT))) AS place FROM want2)""",
)
cte(
    "draw2",
    f"""
SELECT Exm_Id, degree, Q_CrsId, Q_Type, draw_seed, size, high, wide, {_permuted("place")} AS spot FROM cells2
UNION ALL
SELECT Exm_Id, degree, Q_CrsId, Q_Type, draw_seed, size, high, wide, {_permuted("spot")} FROM draw2 WHERE spot >= size""",
)
cte(
    "eq2",
    """
SELECT Exm_Id AS EQ_ExmId, q.Q_Id AS EQ_QId, degree AS EQ_Degree
FROM (SELECT Exm_Id, degree, Q_CrsId, Q_Type, spot + 1 AS num FROM draw2 WHERE spot < size) d
JOIN (SELECT *, row_number() OVER (PARTITION BY Q_CrsId, Q_Type ORDER BY Q_Id) AS num FROM t_question) q
  ON q.Q_CrsId = d.Q_CrsId AND q.Q_Type = d.Q_Type AND q.num = d.num""",
)

# -- manual exams ------------------------------------------------------------------------

cte(
    "r3",
    """
SELECT o_orderkey AS req_id, CASE WHEN o_orderkey % 71 = 0 THEN 9999 ELSE 1 + o_orderkey % 175 END AS Exm_AsgId,
       CASE WHEN o_orderkey % 103 = 0 THEN 'Quiz' WHEN o_orderkey % 4 = 0 THEN 'Corrective' ELSE 'Exam' END AS Exm_Type,
       St_IntId AS Exm_IntId, St_BrId AS Exm_BrId, St_TrkId AS Exm_TrkId,
       TIMESTAMP '2024-02-01 09:00:00' + to_days(CAST(o_orderkey % 28 AS INTEGER)) AS Exm_Start,
       TIMESTAMP '2024-02-01 09:00:00' + to_days(CAST(o_orderkey % 28 AS INTEGER))
         + CASE WHEN o_orderkey % 107 = 0 THEN INTERVAL '0 hour' ELSE INTERVAL '3 hour' END AS Exm_End,
       CAST(90 AS INTEGER) AS Exm_TotalTime, 'Books' AS Exm_Allowance
FROM orders JOIN t_student ON o_custkey = St_Id""",
)
cte(
    "l3",
    """
SELECT l_orderkey AS req_id, coalesce(CASE WHEN l_suppkey % 43 <> 0 THEN Q_Id END, l_partkey) AS QId,
       CAST(CAST(l_quantity AS INTEGER) * 0.60 AS DECIMAL(5,2)) AS degree
FROM lineitem LEFT JOIN t_ranked ON Q_CrsId = l_orderkey % 175 % 25 + 1 AND rn = (l_orderkey * 7 + l_linenumber - 1) % pool""",
)
cte(
    "j3",
    """
SELECT *, CASE
  WHEN Asg_Id IS NULL THEN '50100'
  WHEN (SELECT sum(l.degree) FROM l3 l WHERE l.req_id = r3.req_id) > Crs_MaxDeg THEN '50101'
  WHEN EXISTS (SELECT 1 FROM l3 l LEFT JOIN t_question q ON q.Q_Id = l.QId
               WHERE l.req_id = r3.req_id AND (q.Q_Id IS NULL OR q.Q_CrsId <> Asg_CrsId)) THEN '50102'
  WHEN Exm_Type NOT IN ('Exam', 'Corrective') OR Exm_End <= Exm_Start THEN 'I-11'
  WHEN Exm_BrId <> (SELECT Trk_BrId FROM t_track WHERE Trk_Id = Exm_TrkId) THEN 'I-2'
  WHEN r3.req_id IN (SELECT req_id FROM l3 GROUP BY req_id, QId HAVING count(*) > 1) THEN 'I-12' END AS error_code
FROM r3 LEFT JOIN t_assignment ON Asg_Id = Exm_AsgId LEFT JOIN t_course c ON c.Crs_Id = Asg_CrsId""",
)
cte(
    "new3",
    """
SELECT (SELECT max(Exm_Id) FROM t_exam) + row_number() OVER (ORDER BY req_id) AS Exm_Id, *
FROM j3 WHERE error_code IS NULL""",
)

_HEADER = "Exm_Id, Exm_AsgId, Exm_Type, Exm_IntId, Exm_BrId, Exm_TrkId, Exm_Start, Exm_End, Exm_TotalTime, Exm_Allowance"
cte("all_exam", f"SELECT {_HEADER} FROM t_exam UNION ALL SELECT {_HEADER} FROM new3")
cte(
    "all_eq",
    """
SELECT EQ_Id, EQ_ExmId, EQ_QId, EQ_Degree FROM t_examquestion
UNION ALL SELECT (SELECT max(EQ_Id) FROM t_examquestion) + row_number() OVER (ORDER BY Exm_Id, QId), Exm_Id, QId, l3.degree
FROM new3 JOIN l3 ON l3.req_id = new3.req_id""",
)

# -- seats -------------------------------------------------------------------------------

cte(
    "r4",
    """
SELECT SE_Id AS req_id, SE_ExmId + CASE WHEN SE_Id % 59 = 0 THEN 100000 ELSE 0 END AS SE_ExmId, SE_StId, SE_Date,
       SE_Start - CASE WHEN SE_Id % 67 = 0 THEN 3600000000 ELSE 0 END AS SE_Start,
       CASE WHEN SE_Id % 61 = 0 THEN SE_Start ELSE SE_End END AS SE_End
FROM t_seat""",
)
cte("seated", "SELECT * FROM t_seat WHERE SE_Id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
cte(
    "j4a",
    """
SELECT r4.*, CASE
  WHEN Exm_Id IS NULL THEN '50200'
  WHEN NOT EXISTS (SELECT 1 FROM t_student WHERE St_Id = SE_StId AND St_IntId = Exm_IntId AND St_BrId = Exm_BrId
                   AND St_TrkId = Exm_TrkId) THEN '50201'
  WHEN SE_End <= SE_Start THEN '50202'
  WHEN CAST(Exm_Start AS DATE) <> SE_Date OR SE_Start < epoch_us(Exm_Start) % 86400000000
       OR SE_End > epoch_us(Exm_End) % 86400000000 THEN '50203'
  WHEN EXISTS (SELECT 1 FROM seated s WHERE s.SE_ExmId = r4.SE_ExmId AND s.SE_StId = r4.SE_StId) THEN 'I-12' END AS code
FROM r4 LEFT JOIN t_exam ON Exm_Id = SE_ExmId""",
)
cte(
    "j4",
    """
SELECT * EXCLUDE (code, place), CASE WHEN code IS NULL AND place > 1 THEN 'I-12' ELSE code END AS error_code
FROM (SELECT *, row_number() OVER (PARTITION BY SE_ExmId, SE_StId, code IS NULL ORDER BY req_id) AS place FROM j4a)""",
)

# -- answers -----------------------------------------------------------------------------

cte(
    "r5",
    """
SELECT concat_ws('-', Ans_SEId, pos, strftime(l_shipdate, '%Y%m%d'), l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
                 CAST(round(l_extendedprice * 100) AS BIGINT)) AS req_id,
       submitted_at, Ans_SEId + CASE WHEN l_suppkey % 43 = 3 THEN 1000000000 ELSE 0 END AS Ans_SEId,
       Ans_QId, Ans_ChoiceId, Ans_BoolAns, Ans_TextAns
FROM t_submission""",
)
cte(
    "j5",
    """
SELECT r5.*, CASE
  WHEN SE_Id IS NULL THEN '50500'
  WHEN CAST(submitted_at AS DATE) <> SE_Date OR epoch_us(submitted_at) % 86400000000 NOT BETWEEN SE_Start AND SE_End
    THEN '50501'
  WHEN Q_Id IS NULL THEN 'I-14'
  WHEN Ans_ChoiceId IS NOT NULL AND Ch_Id IS NULL THEN 'I-14'
  WHEN EQ_Id IS NULL THEN 'I-10a'
  WHEN Q_Type = 'MCQ' AND Ch_QId <> Ans_QId THEN 'I-10b'
  WHEN (Q_Type <> 'MCQ' AND Ans_ChoiceId IS NOT NULL) OR (Q_Type <> 'TF' AND Ans_BoolAns IS NOT NULL)
    OR (Q_Type <> 'Text' AND Ans_TextAns IS NOT NULL) THEN 'I-10c' END AS error_code
FROM r5 LEFT JOIN t_seat ON SE_Id = Ans_SEId
LEFT JOIN t_question ON Q_Id = Ans_QId
LEFT JOIN t_choice ON Ch_Id = Ans_ChoiceId
LEFT JOIN t_examquestion ON EQ_ExmId = SE_ExmId AND EQ_QId = Ans_QId""",
)
cte(
    "base5",
    """
SELECT Ans_Id, Ans_SEId, Ans_QId, Ans_ChoiceId, Ans_BoolAns, Ans_TextAns, Ans_Id % 2 = 0 AS Ans_Correct,
       CAST(1 AS DECIMAL(5,2)) AS Ans_Degree, Ans_Comment
FROM t_answer WHERE Ans_SEId IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
cte(
    "last5",
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Ans_SEId, Ans_QId ORDER BY submitted_at DESC, req_id DESC) AS age
               FROM j5 WHERE error_code IS NULL) WHERE age = 1""",
)
cte(
    "saved5",
    """
SELECT b.Ans_Id, b.Ans_SEId, b.Ans_QId,
       CASE WHEN l.age = 1 THEN l.Ans_ChoiceId ELSE b.Ans_ChoiceId END AS Ans_ChoiceId,
       CASE WHEN l.age = 1 THEN l.Ans_BoolAns ELSE b.Ans_BoolAns END AS Ans_BoolAns,
       CASE WHEN l.age = 1 THEN l.Ans_TextAns ELSE b.Ans_TextAns END AS Ans_TextAns,
       b.Ans_Correct, b.Ans_Degree, b.Ans_Comment
FROM base5 b LEFT JOIN last5 l ON l.Ans_SEId = b.Ans_SEId AND l.Ans_QId = b.Ans_QId
UNION ALL
SELECT (SELECT max(Ans_Id) FROM base5) + row_number() OVER (ORDER BY Ans_SEId, Ans_QId), Ans_SEId, Ans_QId, Ans_ChoiceId,
       Ans_BoolAns, Ans_TextAns, NULL, NULL, NULL
FROM last5 l WHERE NOT EXISTS (SELECT 1 FROM base5 b WHERE l.Ans_SEId = b.Ans_SEId AND l.Ans_QId = b.Ans_QId)""",
)

# -- marks -------------------------------------------------------------------------------

cte(
    "r7",
    """
SELECT Ans_Id AS req_id, Ans_Id + CASE WHEN l_suppkey % 43 = 3 THEN 10000000000 ELSE 0 END AS Ans_Id,
       CAST(CAST(l_quantity AS INTEGER) * 0.25 AS DECIMAL(5,2)) AS degree, 'mark ' || CAST(l_quantity AS INTEGER) AS comment
FROM t_latest WHERE q_type = 'Text'""",
)
cte(
    "j7",
    """
SELECT r7.*, Ans_SEId, EQ_Degree, CASE WHEN EQ_Id IS NULL THEN '50400' WHEN degree < 0 OR degree > EQ_Degree THEN '50401' END AS error_code
FROM r7 LEFT JOIN (SELECT Ans_Id, Ans_SEId, EQ_Id, EQ_Degree FROM t_answer JOIN t_seat ON SE_Id = Ans_SEId
                   JOIN t_examquestion ON EQ_ExmId = SE_ExmId AND EQ_QId = Ans_QId) a ON a.Ans_Id = r7.Ans_Id""",
)
cte(
    "marked",
    """
SELECT g.Ans_Id, g.Ans_SEId, g.Ans_QId, a.Ans_TextAns,
       CASE WHEN j.req_id IS NULL THEN g.Ans_Correct WHEN j.degree = j.EQ_Degree THEN true WHEN j.degree = 0 THEN false END AS Ans_Correct,
       CASE WHEN j.req_id IS NULL THEN g.Ans_Degree ELSE j.degree END AS Ans_Degree, j.comment AS Ans_Comment
FROM graded g JOIN t_answer a ON a.Ans_Id = g.Ans_Id
LEFT JOIN (SELECT * FROM j7 WHERE error_code IS NULL) j ON j.Ans_Id = g.Ans_Id""",
)
cte(
    "marked_seat",
    """
SELECT SE_Id, CAST(CASE WHEN SE_Id IN (SELECT Ans_SEId FROM j7 WHERE error_code IS NULL)
            THEN (SELECT coalesce(sum(Ans_Degree), 0) FROM marked WHERE Ans_SEId = SE_Id) ELSE FinalResult END
            AS DECIMAL(5,2)) AS SE_Result
FROM results""",
)

# -- dimensions --------------------------------------------------------------------------

cte(
    "r8",
    """
SELECT s_suppkey AS req_id, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN repeat('x', 101)
  WHEN s_suppkey % 7 = 0 THEN 'ASIA' WHEN s_suppkey % 17 = 0 THEN 'Branch ' || (s_suppkey // 2) || ' '
  ELSE 'Branch ' || (s_suppkey // 2) END AS Br_Name, 'Loc ' || s_suppkey AS Br_Location
FROM supplier""",
)
cte(
    "j8",
    """
SELECT * EXCLUDE (code, place), CASE WHEN code IS NULL AND place > 1 THEN 'I-12' ELSE code END AS error_code
FROM (SELECT *, row_number() OVER (PARTITION BY rtrim(Br_Name), code IS NULL ORDER BY req_id) AS place
  FROM (SELECT *, CASE WHEN Br_Name IS NULL OR length(Br_Name) > 100 THEN 'I-15'
                       WHEN rtrim(Br_Name) IN (SELECT Br_Name FROM t_branch) THEN 'I-12' END AS code FROM r8))""",
)
cte(
    "big_branch",
    "SELECT * FROM t_branch UNION ALL SELECT s_suppkey + 100, 'Site ' || s_suppkey, NULL FROM supplier",
)
cte(
    "r9",
    """
SELECT c_custkey AS req_id, 100 + c_custkey % ((SELECT n FROM nsup) + 5) AS Br_Id,
       CASE WHEN c_custkey % 5 = 0 THEN 'Site ' || (c_custkey % (SELECT n FROM nsup))
            WHEN c_custkey % 5 = 1 THEN 'Name ' || (c_custkey % 50) ELSE 'Name ' || c_custkey END AS Br_Name,
       'L' || c_custkey AS Br_Location
FROM customer""",
)
cte(
    "j9a",
    """
SELECT r9.*, b.Br_Id IS NOT NULL AS there, CAST(NULL AS VARCHAR) AS code
FROM r9 LEFT JOIN big_branch b ON b.Br_Id = r9.Br_Id""",
)
replayed(9, "Br_Id", "Br_Name", "big_branch")
cte(
    "r10",
    """
SELECT c_custkey AS req_id, CASE WHEN c_custkey % 10 = 0 THEN 'NATION_1' ELSE 'Track ' || (c_custkey % 300) END AS Trk_Name,
       c_custkey % 7 + 1 AS Trk_BrId
FROM customer""",
)
cte(
    "j10",
    """
SELECT * EXCLUDE (code, place), CASE WHEN code IS NULL AND place > 1 THEN 'I-12' ELSE code END AS error_code
FROM (SELECT *, row_number() OVER (PARTITION BY Trk_Name, Trk_BrId, code IS NULL ORDER BY req_id) AS place
  FROM (SELECT *, CASE WHEN Trk_BrId NOT IN (SELECT Br_Id FROM t_branch) THEN '50600'
                       WHEN EXISTS (SELECT 1 FROM t_track t WHERE t.Trk_Name = r10.Trk_Name AND t.Trk_BrId = r10.Trk_BrId)
                       THEN 'I-12' END AS code FROM r10))""",
)
cte(
    "big_track",
    "SELECT * FROM t_track UNION ALL SELECT s_suppkey + 1000, 'T ' || s_suppkey, s_suppkey % 5 + 1 FROM supplier",
)
cte(
    "r11",
    """
SELECT c_custkey AS req_id, 1000 + c_custkey % ((SELECT n FROM nsup) + 3) AS Trk_Id,
       CASE WHEN c_custkey % 4 = 0 THEN 'T ' || (c_custkey % (SELECT n FROM nsup)) ELSE 'U ' || (c_custkey % 97) END AS Trk_Name,
       c_custkey % 6 + 1 AS Trk_BrId
FROM customer""",
)
cte(
    "j11a",
    """
SELECT r11.*, b.Trk_Id IS NOT NULL AS there,
       CASE WHEN b.Trk_Id IS NOT NULL AND r11.Trk_BrId = 6 THEN 'I-14' END AS code
FROM r11 LEFT JOIN big_track b ON b.Trk_Id = r11.Trk_Id""",
)
replayed(11, "Trk_Id", "Trk_Name || '|' || Trk_BrId", "big_track")
cte(
    "r12",
    """
SELECT c_custkey AS req_id, CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment WHEN c_custkey % 37 = 0 THEN repeat('y', 51)
         ELSE 'Intake ' || (c_custkey // 3) END AS Int_Name,
       CASE WHEN c_custkey % 31 <> 0 THEN CAST(DATE '2025-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE) END AS Int_StartDate
FROM customer""",
)
cte(
    "j12",
    """
SELECT * EXCLUDE (code, place), CASE WHEN code IS NULL AND place > 1 THEN 'I-12' ELSE code END AS error_code
FROM (SELECT *, row_number() OVER (PARTITION BY Int_Name, code IS NULL ORDER BY req_id) AS place
  FROM (SELECT *, CASE WHEN Int_StartDate IS NULL OR length(Int_Name) > 50 THEN 'I-15'
                       WHEN Int_Name IN (SELECT Int_Name FROM t_intake) THEN 'I-12' END AS code FROM r12))""",
)
cte(
    "r13",
    """
SELECT St_Id AS req_id, CASE WHEN St_Id % 41 = 0 THEN 'st_' || (St_Id + 1) WHEN St_Id % 3 = 0 THEN 'new_' || (St_Id % 100)
         ELSE 'new_' || St_Id END AS St_User, St_Name,
       'm' || CASE WHEN St_Id % 5 = 0 THEN St_Id % 70 ELSE St_Id END || '@example.org' AS St_Email, St_Phone, St_BrId, St_TrkId,
       CASE WHEN St_Id % 89 = 0 THEN 99 ELSE St_IntId END AS St_IntId
FROM t_student""",
)
cte(
    "c13",
    """
SELECT *, CASE WHEN St_IntId NOT IN (SELECT Int_Id FROM t_intake) THEN 'I-14'
    WHEN St_BrId <> (SELECT Trk_BrId FROM t_track WHERE Trk_Id = St_TrkId) THEN 'I-1'
    WHEN St_User IN (SELECT St_User FROM t_student) OR St_Email IN (SELECT St_Email FROM t_student) THEN 'I-12' END AS code
FROM r13""",
)
cte("q13", "SELECT *, row_number() OVER (ORDER BY req_id) AS turn FROM c13 WHERE code IS NULL")
# One request after the other, with everything taken so far.
cte(
    "s13",
    """
SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS req_id, false AS ok,
       CAST([] AS VARCHAR[]) AS users, CAST([] AS VARCHAR[]) AS mails
UNION ALL
SELECT q.turn, q.req_id, free, CASE WHEN free THEN list_append(users, q.St_User) ELSE users END,
       CASE WHEN free THEN list_append(mails, q.St_Email) ELSE mails END
FROM (SELECT q13.*, users, mails, NOT list_contains(users, q13.St_User) AND NOT list_contains(mails, q13.St_Email) AS free
      FROM s13 JOIN q13 ON q13.turn = s13.turn + 1) q""",
)
cte(
    "j13",
    """
SELECT c.*, CASE WHEN code IS NULL AND NOT ok THEN 'I-12' ELSE code END AS error_code
FROM c13 c LEFT JOIN (SELECT req_id, ok FROM s13) s ON s.req_id = c.req_id""",
)
cte(
    "r14",
    """
SELECT o_orderkey AS req_id, o_custkey + CASE WHEN o_orderkey % 53 = 0 THEN 10000000 ELSE 0 END AS St_Id,
       'N' || o_orderkey AS St_Name,
       CASE WHEN o_orderkey % 6 = 0 THEN 'st_' || (o_orderkey % 150) WHEN o_orderkey % 6 = 1 THEN 'dup' || (o_orderkey % 200)
            ELSE 'e' || o_orderkey END || '@example.org' AS St_Email, CAST(NULL AS VARCHAR) AS St_Phone, St_BrId, St_TrkId,
       CASE WHEN o_orderkey % 89 = 0 THEN 99 ELSE St_IntId END AS St_IntId
FROM orders JOIN t_student s ON s.St_Id = o_custkey""",
)
cte(
    "j14a",
    """
SELECT r14.*, s.St_Id IS NOT NULL AS there, CASE WHEN s.St_Id IS NULL THEN NULL
    WHEN r14.St_IntId NOT IN (SELECT Int_Id FROM t_intake) THEN 'I-14'
    WHEN r14.St_BrId <> Trk_BrId THEN 'I-1' END AS code
FROM r14 LEFT JOIN t_student s ON s.St_Id = r14.St_Id LEFT JOIN t_track ON Trk_Id = r14.St_TrkId""",
)
replayed(14, "St_Id", "St_Email", "t_student")

# -- rule-breaking tables ----------------------------------------------------------------

cte("exam_bad", "SELECT * REPLACE (CASE WHEN Exm_Id % 499 = 0 THEN Exm_BrId % 5 + 1 ELSE Exm_BrId END AS Exm_BrId) FROM all_exam")
cte(
    "eq_bad",
    """
SELECT * REPLACE (CASE WHEN (EQ_ExmId + EQ_QId) % 97 = 0 THEN (EQ_QId + 1) % (SELECT count(*) FROM part) ELSE EQ_QId END AS EQ_QId)
FROM all_eq""",
)
cte(
    "choice_bad",
    """
SELECT Ch_Id, Ch_QId, Ch_Correct OR (Ch_QId % 13 = 3 AND Ch_Id % 4 = (Ch_QId + 1) % 4) AS Ch_Correct FROM t_choice
UNION ALL SELECT Q_Id * 4, Q_Id, false FROM t_question WHERE Q_Type = 'Text' AND Q_Id % 13 = 2""",
)
cte(
    "answer_bad",
    """
SELECT * REPLACE (CASE WHEN l_suppkey % 13 = 5 AND q_type <> 'Text' THEN 'x' ELSE Ans_TextAns END AS Ans_TextAns,
                  CASE WHEN l_suppkey % 17 = 4 THEN Ans_QId + 1 ELSE Ans_QId END AS Ans_QId)
FROM t_latest""",
)


def _columns(name: str, changed: dict[str, str]) -> str:
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in TABLES[name].names)


SMALL = ("Admin", "TrainingManager", "Branch", "Intake", "Course", "Track")


def unique_sql() -> str:
    parts = []
    for name, spec in TABLES.items():
        n, source, key = (3 if name in SMALL else 59), SUBQUERY[name], spec.key
        sets = [f"SELECT {_columns(name, {})} FROM {source}"]
        sets.append(f"SELECT {_columns(name, {})} FROM {source} WHERE {key} % {n} = 0")
        for u in range(1, len(spec.unique) + 1):
            shifted = {key: f"{key} + 1000000000000 * {u}"}
            sets.append(f"SELECT {_columns(name, shifted)} FROM {source} WHERE {key} % {n} = {u}")
        rows = " UNION ALL ".join(sets)
        for columns in [(key,), *spec.unique]:
            shown = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
            parts.append(
                f"SELECT '{name}' AS table_name, '{' '.join(columns)}' AS key_columns, {shown} AS key_value, "
                f"count(*) AS n_rows FROM ({rows}) GROUP BY {', '.join(columns)} HAVING count(*) > 1"
            )
    return " UNION ALL ".join(parts)


def _broken_reference(name: str) -> str:
    spec, changed = TABLES[name], {}
    for j, column in enumerate(spec.references, start=1):
        if column == spec.key:
            changed[column] = f"CASE WHEN {column} % 41 = 1 THEN -{column} - 1 ELSE {column} END"
        else:
            changed[column] = f"CASE WHEN {spec.key} % {37 + 4 * j} = {j} THEN {column} + 1000000000000 ELSE {column} END"
    return f"SELECT {_columns(name, changed)} FROM {SUBQUERY[name]}"


def reference_sql() -> str:
    parts = []
    for name, spec in TABLES.items():
        for column, target in spec.references.items():
            key = TABLES[target].key
            parts.append(
                f"SELECT '{name}' AS table_name, '{column}' AS column_name, '{target}' AS target, "
                f"CAST({spec.key} AS BIGINT) AS key, CAST({column} AS BIGINT) AS value FROM ({_broken_reference(name)}) "
                f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM ({_broken_reference(target)}))"
            )
    return " UNION ALL ".join(parts)


def value_sql() -> str:
    parts = []
    for name, spec in TABLES.items():
        source, key = SUBQUERY[name], spec.key
        for i, c in enumerate(spec.columns):
            head = f"SELECT '{name}' AS table_name, CAST({key} AS BIGINT) AS key, '{c.name}"
            if c.required and i:
                parts.append(f"{head} is missing' AS problem FROM {source} WHERE {key} % 47 = {i}")
            if c.length:
                not_null = f" AND {key} % 47 <> {i}" if c.required else ""
                parts.append(f"{head} is too long' AS problem FROM {source} WHERE {key} % 43 = {i}{not_null}")
    return " UNION ALL ".join(parts)
