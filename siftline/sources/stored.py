"""Stored side tables: feedback history, learned patterns, candidates, test-case manifests."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as T

FEEDBACK_SCHEMA = """detection_id string, vulnerability_type string, code_snippet string, file_path string, language string,
was_correct boolean, user_notes string, original_confidence double, detection_method string, timestamp string"""

PATTERN_SCHEMA = """map<string, array<struct<code_example: string, confidence_boost: double, confidence_penalty: double,
confirmations: bigint, first_seen: string, last_seen: string>>>"""


def save_feedback(feedback: DataFrame, path: str) -> None:
    """Feedback history as JSON lines, appended so that no history is rewritten."""
    feedback.write.mode("append").json(path)


def load_feedback(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """Feedback history with typed timestamps; ``one_document`` reads a file that is one JSON array."""
    raw = spark.read.schema(FEEDBACK_SCHEMA).option("multiLine", one_document).json(path)
    return raw.withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


def patterns_document(patterns: DataFrame) -> DataFrame:
    """One (type, JSON document) row per pattern; readers join the documents of a type, so no type is gathered in one row."""
    fields = ["code_example", "confidence_boost", "confidence_penalty", "confirmations", "first_seen", "last_seen"]
    present = [F.col(f) if f in patterns.columns else F.lit(None).alias(f) for f in fields]
    entry = F.struct(*present)
    return patterns.select("vulnerability_type", F.to_json(F.create_map("vulnerability_type", F.array(entry))).alias("document"))


def patterns_from_documents(documents: DataFrame) -> DataFrame:
    """Map-of-lists documents back to one row per pattern."""
    parsed = documents.select(F.from_json("document", PATTERN_SCHEMA).alias("m"))
    return parsed.select(F.explode("m").alias("vulnerability_type", "entries")).select("vulnerability_type", F.inline("entries"))


def history_from_document(documents: DataFrame) -> DataFrame:
    """{type: {correct, total}} documents as rows."""
    parsed = documents.select(F.from_json("document", "map<string, struct<correct: bigint, total: bigint>>").alias("m"))
    return parsed.select(F.explode("m").alias("vulnerability_type", "counts")).select("vulnerability_type", "counts.*")


def history_document(totals: DataFrame) -> DataFrame:
    """One (JSON document) row per type of its right and all records."""
    counts = F.struct(F.col("correct").cast("bigint").alias("correct"), F.col("total").cast("bigint").alias("total"))
    return totals.select(F.to_json(F.create_map("vulnerability_type", counts)).alias("document"))


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system Spark knows it by."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions under a path, found by Spark's marker of a finished write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return []
    names = [f.getPath() for f in system.listStatus(hadoop) if f.getPath().getName().startswith("version=")]
    done = [n.getName() for n in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in done)


def save_documents(documents: DataFrame, path: str) -> int:
    """Write JSON documents as the next version under ``path``; readers never see a half-written one."""
    spark = documents.sparkSession
    version = max(_versions(spark, path), default=-1) + 1
    documents.select("document").write.mode("overwrite").text(f"{path}/version={version}")
    return version


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the last finished version; none where nothing was saved."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], "document string")
    return spark.read.text(f"{path}/version={versions[-1]}").withColumnRenamed("value", "document")


CANDIDATE_SCHEMA = """id long, candidate_id string, anomaly_score double, similar_count long, risk_assessment string,
predicted_cwe string, confidence double"""


def candidates_document(candidates: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in CANDIDATE_SCHEMA.split(",")]
    return candidates.select(F.to_json(F.struct(*names)).alias("document"))


def candidates_from_documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json("document", CANDIDATE_SCHEMA).alias("c")).select("c.*")


MANIFEST_SCHEMA = "_id string, _cwe string, _language string, _url string, _VALUE string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of an XML manifest whose CWE is one of the mapped ones; none in a file without any."""
    raw = spark.read.format("xml").option("rowTag", "testcase").schema(MANIFEST_SCHEMA).load(path)
    cases = raw.select(
        *[F.coalesce(f"_{c}", F.lit("")).alias(c) for c in ["id", "cwe", "language", "url"]],
        F.coalesce("_VALUE", F.lit("")).alias("description"))
    return relevant_cases(cases)


def relevant_cases(cases: DataFrame) -> DataFrame:
    return cases.filter(T.contains_any(F.col("cwe"), list(fixed.CWE_TYPE)))


def case_from_xml(rows: DataFrame, column: str) -> DataFrame:
    """Test cases held as one XML element per row."""
    parsed = rows.select(F.from_xml(column, MANIFEST_SCHEMA).alias("c"))
    return relevant_cases(parsed.select(
        *[F.coalesce(F.col("c")[f"_{c}"], F.lit("")).alias(c) for c in ["id", "cwe", "language", "url"]],
        F.coalesce(F.col("c")["_VALUE"], F.lit("")).alias("description")))
