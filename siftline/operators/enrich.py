"""Explanations written by a model: prompts, parsing, caching and their effect on findings."""
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as T

EXPLANATION_SCHEMA = ", ".join(f"{f} string" for f in fixed.EXPLANATION_FIELDS) + ", references array<string>"


def prompt(code, kind, severity, line, language) -> Column:
    """The request for one finding, with all of its code."""
    shape = "{\n" + ",\n".join(f'    "{k}": {json.dumps(v)}' for k, v in fixed.PROMPT_FIELDS.items()) + "\n}"
    return F.concat(
        F.lit(fixed.PROMPT_OPENING), language,
        F.lit(" code with a detected "), kind, F.lit(" vulnerability:\n\n```"), language, F.lit("\n"), code,
        F.lit("\n```\n\nVulnerability Details:\n- Type: "), kind, F.lit("\n- Severity: "), severity, F.lit("\n- Line: "),
        line.cast("string"),
        F.lit(fixed.PROMPT_REQUEST + shape + fixed.PROMPT_CLOSING),
    )


def parse_answer(answer: Column) -> Column:
    """The JSON object in a model's answer: fences dropped, else the widest braces; null when neither parses."""
    stripped = T.strip(answer)
    fenced = F.regexp_replace(F.get(F.split(stripped, "```"), 1), "^json", "")
    body = F.when(F.startswith(stripped, F.lit("```")), fenced).otherwise(F.regexp_replace(stripped, "```$", ""))
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)

    def parsed(text):
        checked = F.try_parse_json(text)
        is_object = F.schema_of_variant(checked).startswith("OBJECT")
        return F.when(is_object, F.from_json(text, EXPLANATION_SCHEMA))

    return F.coalesce(parsed(T.strip(body)), parsed(braces))


def fallback(kind: Column, severity: Column) -> Column:
    """The explanation used when none is available."""
    return F.struct(
        F.concat(severity, F.lit(" severity based on pattern analysis")).alias("severity_assessment"),
        F.concat(F.lit("A "), kind, F.lit(fixed.FALLBACK_DETAIL)).alias("detailed_explanation"),
        F.lit(fixed.FALLBACK_ATTACK).alias("attack_scenario"),
        F.lit(fixed.FALLBACK_IMPACT).alias("business_impact"),
        F.lit(fixed.FALLBACK_RECOMMENDATION).alias("fix_recommendation"),
        F.lit(fixed.FALLBACK_EXAMPLE).alias("secure_code_example"),
        F.array(F.lit(fixed.FALLBACK_REFERENCE)).alias("references"),
    )


def with_explanation(findings: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Add the cached explanation of each finding if it is younger than a day, else the fallback.

    ``cache`` has (cache_key, cached_at, explanation struct); the freshest entry of a key counts.
    """
    key = T.finding_key(F.col("code_snippet"), F.col("name"), F.col("line_start"))
    fresh = cache.filter(F.col("cached_at") > as_of - F.expr("INTERVAL 24 HOURS"))
    newest = fresh.groupBy("cache_key").agg(F.max_by("explanation", "cached_at").alias("explanation"))
    joined = findings.withColumn("cache_key", key).join(newest, "cache_key", "left")
    return joined.select(
        *findings.columns, "cache_key", F.col("explanation").isNotNull().alias("from_cache"),
        F.coalesce("explanation", fallback(F.col("name"), F.col("severity"))).alias("explanation"))


def enriched(explained: DataFrame) -> DataFrame:
    """Findings raised by their explanation: text appended, fix replaced, confidence up a tenth."""
    e = F.col("explanation")
    text = F.concat(
        F.coalesce("ai_explanation", F.lit("None")), F.lit(fixed.ENRICHED_OPENING), e["detailed_explanation"],
        F.lit(fixed.ENRICHED_ATTACK), e["attack_scenario"], F.lit(fixed.ENRICHED_RISK), e["business_impact"])
    return explained.withColumn("ai_explanation", text).withColumn("fix_suggestion", e["fix_recommendation"]).withColumn(
        "confidence", F.least(F.col("confidence") * 1.1, F.lit(0.99)))


def ask(rows: DataFrame, load_client, prompt_column: str = "prompt", partitions: int | None = None) -> DataFrame:
    """Send prompts to a client that is opened once per task; ``partitions`` bounds the parallel clients.

    ``load_client()`` returns a function from a prompt to an answer.  A failing call gives a null
    answer, which later becomes the fallback, and its message in ``error``.
    """
    columns = rows.columns

    def run(batches):
        client = load_client()

        def one(text):
            try:
                return client(text), None
            except Exception as error:
                return None, f"{type(error).__name__}: {error}"

        for batch in batches:
            given = [one(t) for t in batch[prompt_column]]
            yield batch[columns].assign(answer=[a for a, _ in given], error=[e for _, e in given])

    source = rows.repartition(partitions) if partitions else rows
    return source.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", answer string, error string")


ANSWER_SCHEMA = "cache_key string, cached_at timestamp_ntz, answer string, error string"


def answers(spark, path: str) -> DataFrame:
    """The table of answers at ``path``, empty where none was given yet."""
    from ..sources.stored import folder_exists

    return spark.read.schema(ANSWER_SCHEMA).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], ANSWER_SCHEMA)


def ask_through_cache(findings: DataFrame, path: str, load_client, as_of: Column, partitions: int | None = None) -> DataFrame:
    """Findings with their explanation; the client is asked once for each key that has no answer of the last day.

    Answers are written back before they are read, so a second run asks nothing; a failed call is written too and is
    asked again, and shows the fallback until then.
    """
    spark = findings.sparkSession
    keyed = findings.withColumn("cache_key", T.finding_key(F.col("code_snippet"), F.col("name"), F.col("line_start")))
    fresh = answers(spark, path).filter(F.col("answer").isNotNull() & (F.col("cached_at") > as_of - F.expr("INTERVAL 24 HOURS")))
    request = prompt(F.col("code_snippet"), F.col("name"), F.col("severity"), F.col("line_start"), F.col("language"))
    missing = keyed.select("cache_key", request.alias("prompt")).dropDuplicates(["cache_key"]).join(fresh.select("cache_key").distinct(), "cache_key", "left_anti")
    given = ask(missing, load_client, partitions=partitions).select("cache_key", as_of.cast("timestamp_ntz").alias("cached_at"), "answer", "error")
    given.write.mode("append").parquet(path)
    cache = answers(spark, path).filter("answer IS NOT NULL").select("cache_key", "cached_at", parse_answer(F.col("answer")).alias("explanation"))
    return with_explanation(findings, cache.filter("explanation IS NOT NULL"), as_of)
