"""The derived assessment tables in SQL, as named subqueries for the oracle."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
# Subqueries that others use several times: worked out once.
HEAVY = dict.fromkeys(["t_slot", "t_seat", "t_submission", "t_latest", "t_answer", "graded", "results"], "MATERIALIZED ")


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_tables(body: str) -> str:
    """``body`` with every named subquery it needs, in order of definition."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} AS {HEAVY.get(name, '')}(\n{CTES[name]}\n)" for name in CTES if name in needed]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


cte("nsup", "SELECT count(*) AS n FROM supplier")
cte("nround", "SELECT count(*) // 10000 + 1 AS n FROM part")
cte(
    "t_admin",
    "SELECT s_suppkey AS Adm_Id, 'admin_' || s_suppkey AS Adm_User, s_name AS Adm_Name FROM supplier WHERE s_suppkey % 50 = 0",
)
cte(
    "t_manager",
    "SELECT s_suppkey AS Mgr_Id, 'manager_' || s_suppkey AS Mgr_User, s_name AS Mgr_Name FROM supplier WHERE s_suppkey % 50 = 1",
)
cte(
    "t_instructor",
    """
SELECT s_suppkey AS Ins_Id, 'ins_' || s_suppkey AS Ins_User, s_name AS Ins_Name,
       'ins_' || s_suppkey || '@example.org' AS Ins_Email,
       CASE WHEN s_suppkey % 4 <> 0 THEN '010' || s_suppkey END AS Ins_Phone
FROM supplier""",
)
cte(
    "t_branch",
    "SELECT CAST(r_regionkey + 1 AS BIGINT) AS Br_Id, r_name AS Br_Name, 'Region ' || r_regionkey AS Br_Location FROM region",
)
cte(
    "t_track",
    """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS Trk_Id, n_name AS Trk_Name, CAST(n_regionkey + 1 AS BIGINT) AS Trk_BrId
FROM nation""",
)
cte(
    "t_intake",
    """
SELECT CAST(row_number() OVER (ORDER BY s) AS BIGINT) AS Int_Id, s AS Int_Name,
       CAST(DATE '2023-01-01' + CAST((row_number() OVER (ORDER BY s) - 1) * 30 AS INTEGER) AS DATE) AS Int_StartDate
FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)""",
)
cte(
    "t_student",
    """
SELECT c_custkey AS St_Id, 'st_' || c_custkey AS St_User, c_name AS St_Name,
       'st_' || c_custkey || '@example.org' AS St_Email,
       CASE WHEN c_custkey % 3 <> 0 THEN '011' || c_custkey END AS St_Phone,
       CASE WHEN c_custkey % 97 = 0 THEN Trk_BrId % 5 + 1 ELSE Trk_BrId END AS St_BrId,
       Trk_Id AS St_TrkId, Int_Id AS St_IntId
FROM customer JOIN t_track ON c_nationkey + 1 = Trk_Id JOIN t_intake ON c_mktsegment = Int_Name""",
)
cte(
    "t_course",
    """
SELECT id AS Crs_Id, p_brand AS Crs_Name, CASE WHEN id % 2 <> 0 THEN 'About ' || p_brand END AS Crs_Desc,
       CAST(60 + id % 5 * 10 AS DECIMAL(5,2)) AS Crs_MaxDeg, CAST((60 + id % 5 * 10) * 0.5 AS DECIMAL(5,2)) AS Crs_MinDeg
FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS id FROM part)""",
)
cte(
    "t_assignment",
    """
SELECT (y - 1995) * 25 + Crs_Id AS Asg_Id, Crs_Id AS Asg_CrsId, (Crs_Id * 7 + y) % (SELECT n FROM nsup) AS Asg_InsId,
       CAST(y AS INTEGER) AS Asg_Year
FROM t_course, range(1995, 2002) r(y)""",
)
cte(
    "t_question",
    """
SELECT p_partkey AS Q_Id, CAST(substr(p_brand, 7) AS BIGINT) AS Q_CrsId,
       CASE p_size % 3 WHEN 0 THEN 'MCQ' WHEN 1 THEN 'TF' ELSE 'Text' END AS Q_Type, p_name AS Q_Text,
       (CAST(substr(p_brand, 7) AS BIGINT) * 7 + 1995 + CASE WHEN p_partkey % 53 = 0 THEN 8 ELSE p_partkey % 7 END)
         % (SELECT n FROM nsup) AS Q_CreatedBy
FROM part""",
)
cte(
    "t_choice",
    """
SELECT Q_Id * 4 + k AS Ch_Id, Q_Id AS Ch_QId, Q_Text || ' ' || k AS Ch_Text, k = Q_Id % 4 AS Ch_Correct
FROM t_question, range(0, 4) r(k) WHERE Q_Type = 'MCQ'""",
)
cte("t_tf", "SELECT Q_Id AS TF_QId, Q_Id % 2 = 0 AS TF_Correct FROM t_question WHERE Q_Type = 'TF'")
cte("t_text", "SELECT Q_Id AS Txt_QId, Q_Text AS Txt_BestAnswer FROM t_question WHERE Q_Type = 'Text'")
cte(
    "t_exam",
    """
SELECT Exm_Id, Crs_Id, Exm_Id % 7 * 25 + Crs_Id AS Exm_AsgId,
       CASE WHEN Exm_Id % 401 = 0 THEN 'Quiz' WHEN Exm_Id % 4 = 0 THEN 'Corrective' ELSE 'Exam' END AS Exm_Type,
       Int_Id AS Exm_IntId, Trk_BrId AS Exm_BrId, Trk_Id AS Exm_TrkId,
       TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(Exm_Id % 30 AS INTEGER)) AS Exm_Start,
       TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(Exm_Id % 30 AS INTEGER))
         + CASE WHEN Exm_Id % 211 = 0 THEN INTERVAL '-1 hour' ELSE INTERVAL '4 hour' END AS Exm_End,
       CAST(CASE WHEN Exm_Id % 307 = 0 THEN 0 ELSE 120 END AS INTEGER) AS Exm_TotalTime,
       CASE WHEN Exm_Id % 2 <> 0 THEN 'Calculator' END AS Exm_Allowance
FROM (SELECT r * 3125 + ((Crs_Id - 1) * 25 + Trk_Id - 1) * 5 + Int_Id - 1 AS Exm_Id, *
      FROM t_course, t_track, t_intake, (SELECT unnest(range(0, n)) AS r FROM nround))""",
)
cte(
    "t_ranked",
    """
SELECT *, row_number() OVER (PARTITION BY Q_CrsId ORDER BY Q_Id) - 1 AS rn, count(*) OVER (PARTITION BY Q_CrsId) AS pool
FROM t_question""",
)
cte(
    "t_slot",
    """
SELECT Exm_Id * 8 + pos AS EQ_Id, Exm_Id AS EQ_ExmId, Q_Id AS EQ_QId,
       CAST(5 + Q_Id % 4 * 2.5 AS DECIMAL(5,2)) AS EQ_Degree, pos, least(7, pool) AS paper, Q_Type, Q_Text
FROM t_exam, range(1, 8) r(pos) JOIN t_ranked ON Crs_Id = Q_CrsId AND (Exm_Id * 7 + pos - 1) % pool = rn
WHERE pos <= pool""",
)
cte("t_examquestion", "SELECT EQ_Id, EQ_ExmId, EQ_QId, EQ_Degree FROM t_slot")
cte(
    "t_seat",
    """
SELECT o_orderkey AS SE_Id, exm AS SE_ExmId, o_custkey AS SE_StId,
       CAST(DATE '2024-01-01' + CAST(exm % 30 AS INTEGER) AS DATE) AS SE_Date,
       (540 + o_orderkey % 60) * 60000000 AS SE_Start,
       (540 + o_orderkey % 60 + CASE WHEN o_orderkey % 503 = 0 THEN 0 ELSE 120 END) * 60000000 AS SE_End,
       CAST(NULL AS DECIMAL(5,2)) AS SE_Result
FROM (SELECT *, (o_orderkey // 25) % (SELECT n FROM nround) * 3125 + (o_orderkey % 25 * 25 + St_TrkId - 1) * 5
               + CASE WHEN o_orderkey % 101 = 0 THEN St_IntId % 5 ELSE St_IntId - 1 END AS exm
      FROM orders JOIN t_student ON o_custkey = St_Id)""",
)
cte(
    "t_submission",
    """
SELECT l_orderkey AS Ans_SEId, pos, EQ_QId AS Ans_QId,
       CASE WHEN l_suppkey % 11 <> 0 AND Q_Type = 'MCQ' THEN
         CASE WHEN l_suppkey % 37 = 1 THEN (EQ_QId + 1) * 4 ELSE EQ_QId * 4 + l_partkey % 4 END END AS Ans_ChoiceId,
       CASE WHEN l_suppkey % 11 <> 0 AND Q_Type = 'TF' THEN l_returnflag = 'A' END AS Ans_BoolAns,
       CASE WHEN l_suppkey % 11 <> 0 AND Q_Type = 'Text' THEN
         CASE WHEN l_linestatus = 'F' THEN '  ' || upper(replace(Q_Text, ' ', '   ')) || ' '
              ELSE 'wrong ' || Q_Text END END AS Ans_TextAns,
       Q_Type AS q_type,
       CAST(SE_Date AS TIMESTAMP) + to_microseconds(SE_Start + l_partkey % 150 * 60000000) AS submitted_at,
       l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM lineitem JOIN t_seat ON l_orderkey = SE_Id JOIN t_slot ON SE_ExmId = EQ_ExmId AND (l_linenumber - 1) % paper + 1 = pos""",
)
cte(
    "t_latest",
    """
SELECT Ans_SEId * 8 + pos AS Ans_Id, * FROM (
  SELECT *, row_number() OVER (PARTITION BY Ans_SEId, Ans_QId
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS age
  FROM t_submission) WHERE age = 1""",
)
cte(
    "t_answer",
    """
SELECT Ans_Id, Ans_SEId, Ans_QId, Ans_ChoiceId, Ans_BoolAns, Ans_TextAns, CAST(NULL AS BOOLEAN) AS Ans_Correct,
       CAST(NULL AS DECIMAL(5,2)) AS Ans_Degree, CAST(NULL AS VARCHAR) AS Ans_Comment
FROM t_latest""",
)
cte(
    "norm_text",
    r"""
SELECT Txt_QId, Txt_BestAnswer,
       rtrim(regexp_replace(translate(lower(trim(Txt_BestAnswer)), chr(9) || chr(10) || chr(13), '   '), ' {2,}', ' ', 'g')) AS best
FROM t_text""",
)
cte(
    "graded",
    r"""
SELECT Ans_Id, Ans_SEId, Ans_QId,
       CASE WHEN EQ_QId IS NULL THEN Ans_Correct
            WHEN Txt_QId IS NOT NULL THEN coalesce(given = best, false)
            WHEN TF_QId IS NOT NULL THEN coalesce(TF_Correct = Ans_BoolAns, false)
            WHEN Ch_Id IS NOT NULL THEN Ch_Correct ELSE Ans_Correct END AS Ans_Correct,
       CAST(CASE WHEN EQ_QId IS NULL THEN Ans_Degree
            WHEN Txt_QId IS NOT NULL THEN CASE WHEN given = best THEN EQ_Degree ELSE 0 END
            WHEN TF_QId IS NOT NULL THEN CASE WHEN TF_Correct = Ans_BoolAns THEN EQ_Degree ELSE 0 END
            WHEN Ch_Id IS NOT NULL THEN CASE WHEN Ch_Correct THEN EQ_Degree ELSE 0 END
            ELSE Ans_Degree END AS DECIMAL(5,2)) AS Ans_Degree
FROM (SELECT *, rtrim(regexp_replace(translate(lower(trim(Ans_TextAns)), chr(9) || chr(10) || chr(13), '   '), ' {2,}', ' ', 'g')) AS given
      FROM t_answer) a
LEFT JOIN t_seat ON SE_Id = Ans_SEId
LEFT JOIN t_examquestion ON EQ_ExmId = SE_ExmId AND EQ_QId = Ans_QId
LEFT JOIN t_choice ON Ch_Id = Ans_ChoiceId
LEFT JOIN t_tf ON TF_QId = Ans_QId
LEFT JOIN norm_text ON Txt_QId = Ans_QId""",
)
cte(
    "results",
    """
SELECT SE_Id, CAST(coalesce(sum(Ans_Degree), 0) AS DECIMAL(5,2)) AS FinalResult
FROM t_seat LEFT JOIN graded ON Ans_SEId = SE_Id GROUP BY SE_Id""",
)
