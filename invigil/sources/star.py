"""Assessment tables derived from the commercial star-schema Parquet files.

Every row of every assessment table is computed from rows of the given files by fixed
integer formulas, so the data grows with the files and any engine can derive the same
rows.  Some formulas break a rule on purpose; ``DirtyStar`` breaks all of them.

Tables are built on demand.  ``Star`` alone only declares them; ``stored`` gives a Star that
writes each table the first time it is asked for, once per application and input folder, to
the shared scratch folder.  Queries then run on typed Parquet tables whose true size Catalyst
knows, so it broadcasts what is small and shuffles what is not without any hint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invigil.functions.clock import MICROS_PER_MINUTE, at_time
from invigil.functions.numbering import running_total
from invigil.schema import MCQ, TABLES, TEXT, TF
from invigil.session import new_folder, writing
from invigil.sources.tables import conform, write_bucketed

# Schemas of the given files.
FILES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}

FIRST_YEAR, LAST_YEAR = 1995, 2001
BRANCHES, TRACKS, INTAKES, COURSES = 5, 25, 5, 25
#: Questions on a paper, where a course has as many.
PAPER = 7
#: Parts for which the exams are held once more, so that papers reach the whole pool at any size.
PARTS_PER_ROUND = 10_000
ROUND = COURSES * TRACKS * INTAKES


def scan(spark: SparkSession, sf_dir: str, name: str, *spread_by: str) -> DataFrame:
    """Typed scan of one given file or folder of files.

    Input that comes in fewer splits than there are cores is spread by ``spread_by``, the
    columns that tell its rows apart.  That
    exchange moves less than one split per core; larger input is left where it is.
    """
    df = spark.read.schema(FILES[name]).parquet(f"{sf_dir}/{name}.parquet")
    if spread_by:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores, *spread_by)
    return df


def every(n: int, key: Column, rest: int = 0) -> Column:
    """True on one in ``n`` keys."""
    return key % n == rest


def _course_of(brand: str) -> Column:
    return F.substring(F.col(brand), 7, 10).cast("long")


def kept(function: Callable[[Star], DataFrame] | None = None, *, bucket: str | None = None, dense: bool = False):
    """A derived table that a stored Star writes once and reads back; ``bucket`` names the
    column by which a fact is laid out, so that joins on it need no exchange."""

    def wrap(derive):
        def get(self: Star) -> DataFrame:
            return self.keep(derive.__name__, lambda: derive(self), bucket, dense)

        get.__doc__ = derive.__doc__
        return cached_property(get)

    return wrap(function) if function else wrap


#: Compressed input per bucket of a stored fact, and the fewest buckets.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 8
#: Compressed input per partition of an exchange, and the most bytes of a scan's split and of small partitions that AQE puts together.
PARTITION_INPUT = 4 << 20
PARTITION_BYTES = 16 << 20

# Where each (application, input folder) keeps its tables and from which files, and which are complete.
_FOLDERS: dict[tuple[str, str], tuple[str, tuple]] = {}
_COMPLETE: dict[str, T.StructType] = {}
_WRITING = RLock()


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the data files at ``path``, in any store Spark can read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    found = [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in store.listStatus(where) if f.isFile()]
    return sorted(f for f in found if not f[0].rsplit("/", 1)[-1].startswith(("_", ".")))


def stored(spark: SparkSession, sf_dir: str) -> Star:
    """The tables derived from the files as they are now; what came of older files is dropped."""
    place = (spark.sparkContext.applicationId, sf_dir)
    version = tuple(f for name in FILES for f in files(spark, f"{sf_dir}/{name}.parquet"))
    with _WRITING:
        folder, known = _FOLDERS.get(place, (None, None))
        if folder and known != version:
            forget(spark, folder)
            folder = None
        if not folder:
            folder = new_folder(spark, "star")
            _FOLDERS[place] = (folder, version)
    size_exchanges(spark, sum(size for path, size, _ in version if "/documents.parquet" not in path))
    return Star(spark, sf_dir, folder)


def size_exchanges(spark: SparkSession, n_bytes: int) -> None:
    """Let the partitions of an exchange follow the input, so that a task sorts or holds as much at any size.

    The session's own number stays the least one, and AQE puts small partitions together, but not to more
    than ``PARTITION_BYTES``: rows take some ten times that in memory.  The same holds for the splits of a scan,
    whose rows a task may have to hold as well, where it combines them before an exchange.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, -(-n_bytes // PARTITION_INPUT))))
    for most in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(most)) > PARTITION_BYTES:
            spark.conf.set(most, f"{PARTITION_BYTES}b")


def forget(spark: SparkSession, folder: str) -> None:
    """Drop the tables and files that a stored Star left in ``folder``."""
    prefix = folder.rsplit("/", 1)[-1].replace("-", "_") + "_"
    for table in spark.catalog.listTables():
        if table.name.startswith(prefix):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    for path in [p for p in _COMPLETE if p.startswith(folder + "/")]:
        del _COMPLETE[path]
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Star(Mapping):
    """The seventeen assessment tables over one folder of star-schema files."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str | None = None):
        self.spark, self.sf_dir, self.folder = spark, sf_dir, folder
        self._tables: dict[str, DataFrame] = {}

    def keep(self, name: str, derive: Callable[[], DataFrame], bucket: str | None = None, dense: bool = False) -> DataFrame:
        """``derive()``, or in a stored Star the table it was written to the first time.

        What an attempt that failed left behind is overwritten by the next one.
        """
        if self.folder is None:
            return derive()
        path = self.path(name)
        table = f"{self.folder.rsplit('/', 1)[-1]}_{name}".replace("-", "_")
        with _WRITING:
            if path not in _COMPLETE:
                df = derive()
                if bucket:
                    write_bucketed(df, table, path, bucket, self.n_buckets)
                else:
                    with writing(df, dense) as writer:
                        writer.mode("overwrite").parquet(path)
                _COMPLETE[path] = df.schema
        return self.spark.table(table) if bucket else self.spark.read.schema(_COMPLETE[path]).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        """True where a table is written already."""
        return self.folder is not None and self.path(name) in _COMPLETE

    def plain(self, name: str) -> DataFrame:
        """A bucketed table read as plain files.

        For joins with rows of which one key may hold a large share: both sides are exchanged
        then, and Spark can split the partition of that key.
        """
        table = getattr(self, name)
        if self.folder is None:
            return table
        return self.spark.read.schema(_COMPLETE[self.path(name)]).parquet(self.path(name))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if name not in self._tables:
            self._tables[name] = conform(getattr(self, name), name)
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def file(self, name: str, *spread_by: str) -> DataFrame:
        return scan(self.spark, self.sf_dir, name, *spread_by)

    @cached_property
    def n_buckets(self) -> int:
        """How many buckets all facts have, so that they can meet: a property of the stored tables.

        One for every ``BUCKET_BYTES`` of the largest input, at least ``LEAST_BUCKETS``; neither the
        session's partitions nor its cores play a part, so a bucket keeps its size as data grow.
        """
        return max(LEAST_BUCKETS, -(-sum(size for _, size, _ in files(self.spark, f"{self.sf_dir}/lineitem.parquet")) // BUCKET_BYTES))

    @cached_property
    def n_suppliers(self) -> Column:
        return self.file("supplier").agg(F.count("*")).scalar()

    @cached_property
    def n_rounds(self) -> Column:
        """How many times every exam is held; grows with the question pool."""
        return (F.floor(self.file("part").agg(F.count("*")).scalar() / PARTS_PER_ROUND) + 1).cast("long")

    # -- accounts and dimensions -------------------------------------------------------

    @cached_property
    def Admin(self) -> DataFrame:
        supplier = self.file("supplier").where(every(50, F.col("s_suppkey")))
        return supplier.select(
            F.col("s_suppkey").alias("Adm_Id"),
            F.concat(F.lit("admin_"), "s_suppkey").alias("Adm_User"),
            F.col("s_name").alias("Adm_Name"),
        )

    @cached_property
    def TrainingManager(self) -> DataFrame:
        supplier = self.file("supplier").where(every(50, F.col("s_suppkey"), 1))
        return supplier.select(
            F.col("s_suppkey").alias("Mgr_Id"),
            F.concat(F.lit("manager_"), "s_suppkey").alias("Mgr_User"),
            F.col("s_name").alias("Mgr_Name"),
        )

    @cached_property
    def Instructor(self) -> DataFrame:
        key = F.col("s_suppkey")
        user = F.concat(F.lit("ins_"), key)
        return self.file("supplier").select(
            key.alias("Ins_Id"),
            user.alias("Ins_User"),
            F.col("s_name").alias("Ins_Name"),
            F.concat(user, F.lit("@example.org")).alias("Ins_Email"),
            F.when(~every(4, key), F.concat(F.lit("010"), key)).alias("Ins_Phone"),
        )

    @cached_property
    def Branch(self) -> DataFrame:
        return self.file("region").select(
            (F.col("r_regionkey") + 1).alias("Br_Id"),
            F.col("r_name").alias("Br_Name"),
            F.concat(F.lit("Region "), "r_regionkey").alias("Br_Location"),
        )

    @cached_property
    def Track(self) -> DataFrame:
        return self.file("nation").select(
            (F.col("n_nationkey") + 1).alias("Trk_Id"),
            F.col("n_name").alias("Trk_Name"),
            (F.col("n_regionkey") + 1).alias("Trk_BrId"),
        )

    @kept
    def Intake(self) -> DataFrame:
        # Numbers the distinct names, of which there are a few, not the customers.
        names = self.file("customer").select(F.col("c_mktsegment").alias("Int_Name")).where("Int_Name is not null").distinct()
        place = F.row_number().over(Window.orderBy("Int_Name")) - 1
        return (
            names.withColumn("place", place)
            .select(
                (F.col("place") + 1).alias("Int_Id"),
                "Int_Name",
                F.date_add(F.lit("2023-01-01").cast("date"), F.col("place") * 30).alias("Int_StartDate"),
            )
        )

    @kept
    def Student(self) -> DataFrame:
        key = F.col("c_custkey")
        user = F.concat(F.lit("st_"), key)
        moved = F.when(every(97, key), F.col("Trk_BrId") % BRANCHES + 1).otherwise(F.col("Trk_BrId"))
        return (
            self.file("customer")
            .join(self.Track, F.col("c_nationkey") + 1 == F.col("Trk_Id"))
            .join(self.Intake, F.col("c_mktsegment") == F.col("Int_Name"))
            .select(
                key.alias("St_Id"),
                user.alias("St_User"),
                F.col("c_name").alias("St_Name"),
                F.concat(user, F.lit("@example.org")).alias("St_Email"),
                F.when(~every(3, key), F.concat(F.lit("011"), key)).alias("St_Phone"),
                moved.alias("St_BrId"),
                F.col("Trk_Id").alias("St_TrkId"),
                F.col("Int_Id").alias("St_IntId"),
            )
        )

    @kept
    def Course(self) -> DataFrame:
        crs, top = F.col("Crs_Id"), 60 + F.col("Crs_Id") % 5 * 10
        return (
            self.file("part")
            .groupBy("p_brand")
            .agg(_course_of("p_brand").alias("Crs_Id"))
            .select(
                crs,
                F.col("p_brand").alias("Crs_Name"),
                F.when(~every(2, crs), F.concat(F.lit("About "), "p_brand")).alias("Crs_Desc"),
                top.cast(T.DecimalType(5, 2)).alias("Crs_MaxDeg"),
                (top / 2).cast(T.DecimalType(5, 2)).alias("Crs_MinDeg"),
            )
        )

    @kept
    def CourseAssignment(self) -> DataFrame:
        crs, year = F.col("Crs_Id"), F.col("year")
        return self.Course.select(crs, F.explode(F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))).alias("year")).select(
            ((year - FIRST_YEAR) * COURSES + crs).alias("Asg_Id"),
            crs.alias("Asg_CrsId"),
            ((crs * 7 + year) % self.n_suppliers).alias("Asg_InsId"),
            year.alias("Asg_Year"),
        )

    # -- question bank -----------------------------------------------------------------

    @kept
    def Question(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size") % 3
        turn = F.when(every(53, key), F.lit(8)).otherwise(key % 7)
        return self.file("part").select(
            key.alias("Q_Id"),
            _course_of("p_brand").alias("Q_CrsId"),
            F.when(size == 0, MCQ).when(size == 1, TF).otherwise(TEXT).alias("Q_Type"),
            F.col("p_name").alias("Q_Text"),
            ((_course_of("p_brand") * 7 + FIRST_YEAR + turn) % self.n_suppliers).alias("Q_CreatedBy"),
        )

    @kept
    def MCQChoice(self) -> DataFrame:
        q, place = F.col("Q_Id"), F.col("place")
        return (
            self.Question.where(F.col("Q_Type") == MCQ)
            .select(q, "Q_Text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
            .select(
                (q * 4 + place).alias("Ch_Id"),
                q.alias("Ch_QId"),
                F.concat("Q_Text", F.lit(" "), place).alias("Ch_Text"),
                (place == q % 4).alias("Ch_Correct"),
            )
        )

    @cached_property
    def TFQuestion(self) -> DataFrame:
        q = F.col("Q_Id")
        return self.Question.where(F.col("Q_Type") == TF).select(q.alias("TF_QId"), every(2, q).alias("TF_Correct"))

    @cached_property
    def TextQuestion(self) -> DataFrame:
        return self.Question.where(F.col("Q_Type") == TEXT).select(
            F.col("Q_Id").alias("Txt_QId"), F.col("Q_Text").alias("Txt_BestAnswer")
        )

    # -- exams and seats ---------------------------------------------------------------

    @kept
    def Exam(self) -> DataFrame:
        """One exam per round, course, track and intake, spelled out from the course alone."""
        exm, crs = F.col("Exm_Id"), F.col("Crs_Id")
        per_course = TRACKS * INTAKES
        rounds = F.explode(F.sequence(F.lit(0).cast("long"), self.n_rounds - 1))
        begin = at_time(F.date_add(F.lit("2024-01-01").cast("date"), (exm % 30).cast("int")), F.lit(9 * 60 * MICROS_PER_MINUTE))
        hours = F.when(every(211, exm), F.lit(-1)).otherwise(F.lit(4))
        return (
            self.Course.select(crs, rounds.alias("round"))
            .select(crs, "round", F.explode(F.sequence(F.lit(0), F.lit(per_course - 1))).alias("seq"))
            .select(
                crs,
                (F.col("round") * ROUND + (crs - 1) * per_course + F.col("seq")).alias("Exm_Id"),
                (F.floor(F.col("seq") / INTAKES) + 1).alias("Exm_TrkId"),
                (F.col("seq") % INTAKES + 1).alias("Exm_IntId"),
            )
            .join(self.Track, F.col("Exm_TrkId") == F.col("Trk_Id"))
            .select(
                exm,
                crs,
                (exm % 7 * COURSES + crs).alias("Exm_AsgId"),
                F.when(every(401, exm), "Quiz").when(every(4, exm), "Corrective").otherwise("Exam").alias("Exm_Type"),
                "Exm_IntId",
                F.col("Trk_BrId").alias("Exm_BrId"),
                "Exm_TrkId",
                begin.alias("Exm_Start"),
                F.timestamp_add("HOUR", hours, begin).alias("Exm_End"),
                F.when(every(307, exm), 0).otherwise(120).alias("Exm_TotalTime"),
                F.when(~every(2, exm), F.lit("Calculator")).alias("Exm_Allowance"),
            )
        )

    @kept
    def pool(self) -> DataFrame:
        """``(pool_crs, pool_size)``: how many questions each course has."""
        return self.Question.groupBy(F.col("Q_CrsId").alias("pool_crs")).agg(F.count("*").alias("pool_size"))

    @kept
    def ranked(self) -> DataFrame:
        """All questions, numbered in their course from 0 by id, without a window over a course."""
        return running_total(self.Question, "Q_Id", "rn", within=["Q_CrsId"])

    @kept
    def slots(self) -> DataFrame:
        """Exam questions with their place on the paper, 1 to 7 or to the size of a smaller pool.

        A paper is a stretch of the course's questions; exam after exam takes the next one, around
        the whole pool.
        """
        exm, q, size = F.col("Exm_Id"), F.col("Q_Id"), F.col("pool_size")
        places = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PAPER).cast("long"), size)))
        papers = self.Exam.select(exm, "Crs_Id").join(self.pool, F.col("Crs_Id") == F.col("pool_crs"))
        papers = papers.select(exm, "Crs_Id", "pool_size", places.alias("pos"))
        papers = papers.withColumn("at", (exm * PAPER + F.col("pos") - 1) % size)
        return papers.join(self.ranked, (F.col("Crs_Id") == F.col("Q_CrsId")) & (F.col("at") == F.col("rn"))).select(
            (exm * 8 + F.col("pos")).alias("EQ_Id"),
            exm.alias("EQ_ExmId"),
            q.alias("EQ_QId"),
            (5 + q % 4 * F.lit(2.5).cast(T.DecimalType(3, 1))).cast(T.DecimalType(5, 2)).alias("EQ_Degree"),
            "pos",
            "Q_Type",
            "Q_Text",
        )

    @cached_property
    def ExamQuestion(self) -> DataFrame:
        return self.slots

    @kept(bucket="SE_Id")
    def StudentExam(self) -> DataFrame:
        key = F.col("o_orderkey")
        intake = F.when(every(101, key), F.col("St_IntId") % INTAKES).otherwise(F.col("St_IntId") - 1)
        held = F.floor(key / COURSES).cast("long") % self.n_rounds
        exam = held * ROUND + (key % COURSES * TRACKS + F.col("St_TrkId") - 1) * INTAKES + intake
        begin = (540 + key % 60) * MICROS_PER_MINUTE
        return (
            self.file("orders")
            .join(self.Student, F.col("o_custkey") == F.col("St_Id"))
            .withColumn("SE_ExmId", exam)
            .select(
                key.alias("SE_Id"),
                "SE_ExmId",
                F.col("o_custkey").alias("SE_StId"),
                F.date_add(F.lit("2024-01-01").cast("date"), (F.col("SE_ExmId") % 30).cast("int")).alias("SE_Date"),
                begin.alias("SE_Start"),
                F.when(every(503, key), begin).otherwise(begin + 120 * MICROS_PER_MINUTE).alias("SE_End"),
            )
        )

    # -- answers -----------------------------------------------------------------------

    @cached_property
    def Submission(self) -> DataFrame:
        """Everything students sent in, several times per question at will.

        A line goes to the question at its number on the paper, around the paper: none is lost.
        """
        lineitem = self.file("lineitem", "l_orderkey", *_LINE)
        # Flags, not texts, and one time, not its parts, are exchanged.
        lineitem = lineitem.select(
            "l_orderkey",
            "l_linenumber",
            *_LINE,
            (F.col("l_linestatus") == "F").alias("shouts"),
            (F.col("l_returnflag") == "A").alias("says"),
        )
        q, sup = F.col("EQ_QId"), F.col("l_suppkey")
        given = ~every(11, sup)
        choice = F.when(every(37, sup, 1), (q + 1) * 4).otherwise(q * 4 + F.col("l_partkey") % 4)
        shouted = F.concat(F.lit("  "), F.upper(F.replace("Q_Text", F.lit(" "), F.lit("   "))), F.lit(" "))
        text = F.when(F.col("shouts"), shouted).otherwise(F.concat(F.lit("wrong "), "Q_Text"))
        seats = self.plain("StudentExam").select("SE_Id", "SE_ExmId", "SE_Date", "SE_Start")
        course = F.floor(F.col("SE_ExmId") / (TRACKS * INTAKES)).cast("long") % COURSES + 1
        paper = F.least(F.lit(PAPER).cast("long"), F.col("pool_size"))
        return (
            lineitem.join(seats, F.col("l_orderkey") == F.col("SE_Id"))
            .join(self.pool, course == F.col("pool_crs"))
            .withColumn("line_pos", (F.col("l_linenumber") - 1) % paper + 1)
            .withColumn("submitted_at", F.timestamp_add("MINUTE", F.col("l_partkey") % 150, at_time(F.col("SE_Date"), F.col("SE_Start"))))
            .join(self.slots, (F.col("SE_ExmId") == F.col("EQ_ExmId")) & (F.col("line_pos") == F.col("pos")))
            .select(
                F.col("l_orderkey").alias("Ans_SEId"),
                "pos",
                q.alias("Ans_QId"),
                F.when(given & (F.col("Q_Type") == MCQ), choice).alias("Ans_ChoiceId"),
                F.when(given & (F.col("Q_Type") == TF), F.col("says")).alias("Ans_BoolAns"),
                F.when(given & (F.col("Q_Type") == TEXT), text).alias("Ans_TextAns"),
                F.col("Q_Type").alias("q_type"),
                "submitted_at",
                *_LINE,
            )
        )

    @kept(dense=True)
    def submitted(self) -> DataFrame:
        """``Submission``, written once, for a batch whose submissions are read beside the answers that come of them."""
        return self.Submission

    @kept(bucket="Ans_SEId")
    def latest(self) -> DataFrame:
        """The last submission per seat and place: a maximum, combined before any exchange, so
        that a seat with a large share of all submissions is no burden to one task."""
        order = [F.col(c) for c in _LINE[:5]]
        rest = ["Ans_QId", "Ans_ChoiceId", "Ans_BoolAns", "Ans_TextAns", "q_type"]
        row = F.max(F.struct(*order, *rest)).alias("row")
        submissions = self.submitted if self.has("submitted") else self.Submission
        return (
            submissions.groupBy("Ans_SEId", "pos")
            .agg(row)
            .select(
                (F.col("Ans_SEId") * 8 + F.col("pos")).alias("Ans_Id"),
                "Ans_SEId",
                "pos",
                # What only told which submission is the last is neither exchanged again nor stored.
                *[f"row.{c}" for c in ["l_suppkey", "l_quantity", *rest]],
            )
        )

    @cached_property
    def StudentAnswer(self) -> DataFrame:
        return self.latest


# Columns that order submissions: date, part, supplier, quantity, price.
_LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
