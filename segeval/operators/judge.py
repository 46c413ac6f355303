"""Tables around a judge model: requests to send, results to read, scores to join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segeval.functions.judging import extract_score, render_prompt
from segeval.scratch import materialize

MODES = ("reference_based", "reference_free")
RESULT_SCHEMA = (
    "custom_id string, result struct<type: string, message: struct<content: array<struct<text: string>>>, error: string>"
)
# Outcomes a batch service reports.
STATUSES = ("succeeded", "errored", "processing", "canceled", "expired")


@dataclass(frozen=True)
class JudgeSettings:
    """What a request says besides the texts. ``prompt`` holds {source}, {hypothesis} and, if used, {reference}."""

    mode: str
    prompt: str
    model: str
    system: str = ""
    examples: str = ""
    max_tokens: int = 1000
    temperature: int = 0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unsupported evaluation mode: {self.mode}")


def custom_id(mode: str, row_id: Column) -> Column:
    """Request id that ends in the row's id."""
    return F.concat(F.lit(f"eval_{mode}_"), row_id.cast("string"))


def judge_requests(
    df: DataFrame,
    settings: JudgeSettings,
    row_id: str = "row_id",
    source: str = "sourceText",
    hypothesis: str = "targetText",
    reference: str = "referenceText",
) -> DataFrame:
    """``(custom_id, request)``: one JSON request per row.

    A row that lacks a needed text gets a request that asks for 0.
    """
    texts = {"source": F.col(source), "hypothesis": F.col(hypothesis)}
    if settings.mode == "reference_based":
        texts["reference"] = F.col(reference)
    prompt = render_prompt(settings.prompt, **texts)
    complete = prompt.isNotNull()
    for value in texts.values():
        complete = complete & value.isNotNull()
    key = custom_id(settings.mode, F.col(row_id))

    def block(value: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), value.alias("text"))

    def request(max_tokens: int, temperature: int, system: str, content: Column) -> Column:
        message = F.struct(F.lit("user").alias("role"), content.alias("content"))
        params = F.struct(
            F.lit(settings.model).alias("model"),
            F.lit(max_tokens).alias("max_tokens"),
            F.lit(temperature).alias("temperature"),
            F.lit(system).alias("system"),
            F.array(message).alias("messages"),
        )
        return F.to_json(F.struct(key.alias("custom_id"), params.alias("params")))

    blocks = F.array(block(F.lit(settings.examples)), block(prompt))
    full = request(settings.max_tokens, settings.temperature, settings.system, blocks)
    placeholder = request(10, 0, "Return 0", F.lit("0"))
    return df.select(key.alias("custom_id"), F.when(complete, full).otherwise(placeholder).alias("request"))


def parse_results(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(custom_id, status, score)`` from JSON result lines; any status but ``succeeded`` scores 0."""
    parsed = lines.where(F.trim(column) != "").select(F.from_json(column, RESULT_SCHEMA).alias("r")).select("r.*")
    answer = F.get(F.col("result.message.content"), F.lit(0))["text"]
    return parsed.select(
        "custom_id",
        F.col("result.type").alias("status"),
        F.when(F.col("result.type") == "succeeded", extract_score(F.coalesce(answer, F.lit("")))).otherwise(0.0).alias("score"),
    )


def result_row_id(custom_id: Column, mode: str) -> Column:
    """Row id at the end of a request id; NULL if it is no number or belongs to another mode."""
    row_id = F.element_at(F.split(custom_id, "_"), -1).try_cast("bigint")
    return F.when(F.startswith(custom_id, F.lit(f"eval_{mode}_")) & (row_id >= 0), row_id)


def join_results(df: DataFrame, results: DataFrame, mode: str, row_id: str = "row_id") -> DataFrame:
    """Add ``score`` and ``status`` by request id; a row without a result scores 0 with status ``missing``.

    Of several results for a row one is kept, a succeeded one if there is any.
    """
    found = results.withColumn(row_id, result_row_id(F.col("custom_id"), mode)).where(F.col(row_id).isNotNull())
    preference = F.struct((F.col("status") == "succeeded"), F.col("score"))
    one = found.groupBy(row_id).agg(F.max_by(F.struct("score", "status"), preference).alias("__result"))
    return df.join(one, row_id, "left").select(
        *df.columns,
        F.coalesce(F.col("__result.score"), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("__result.status"), F.lit("missing")).alias("status"),
    )


def without_results(df: DataFrame, results: DataFrame, mode: str, row_id: str = "row_id", retry: bool = False) -> DataFrame:
    """Rows that no stored result belongs to, to go on from an interrupted run. ``retry`` counts succeeded results only."""
    stored = results.where("status = 'succeeded'") if retry else results
    done = stored.select(result_row_id(F.col("custom_id"), mode).alias(row_id)).where(F.col(row_id).isNotNull())
    return df.join(done.distinct(), row_id, "left_anti")


def join_and_fill(df: DataFrame, results: DataFrame, sent: DataFrame, mode: str, row_id: str = "row_id") -> DataFrame:
    """``join_results`` for the rows that were ``sent``; the other rows get the mean of those scores.

    A sent row without a result scores 0 with status ``missing``, and that counts
    in the mean; a row that was not sent has the status ``not_sent`` and
    ``is_imputed``. ``sent`` holds row ids. The joined scores are written when
    this is called.
    """
    ids = sent.select(row_id).distinct()
    scored = materialize(join_results(ids, results, mode, row_id), "judge-scores")
    mean = scored.agg(F.avg("score")).scalar()
    joined = df.join(scored.withColumnsRenamed({"score": "__score", "status": "__status"}), row_id, "left")
    return joined.select(
        *df.columns,
        F.coalesce("__score", mean).alias("score"),
        F.coalesce("__status", F.lit("not_sent")).alias("status"),
        F.isnull("__status").alias("is_imputed"),
    )


def progress(results: DataFrame) -> DataFrame:
    """One row: results by status, their total, and the percentage that succeeded."""
    counts = results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    total = sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0]))
    return counts.select("*", total.alias("total")).select(
        "*", F.try_divide(F.col("succeeded") * 100.0, F.col("total")).alias("percent")
    )
