"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import event_ratings, event_scores, line_scores, rated_documents, replies, table, LINE_METRICS
from segeval.functions.expr import score_column, score_column_expr
from segeval.functions.judging import extract_score
from segeval.operators import corpus, judge, lexical, profile, ranking, ratings, scoring, training
from segeval.operators.correlation import correlations, group_correlations, kendall, pearson, spearman
from segeval.operators.order import first_rows
from segeval.operators.sketches import distinct_error, merge_sketches, rank_error, sketch_scores, sketch_summary
from segeval.plans.annotate import annotate_csv
from segeval.plans.evaluate import evaluate
from segeval.scratch import materialize, scratch_root
from segeval.sources import csv, judge_files, scores as score_io

LEXICAL = ["BLEU", "CHRF++", "WER", "ROUGE"]
JUDGE = judge.JudgeSettings(
    mode="reference_free",
    prompt="Source: {source}\nTranslation: {hypothesis}\nScore:",
    model="judge-1",
    system="Rate the translation.",
    examples="No examples.",
    max_tokens=100,
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- assembling and filtering ratings -------------------------------------------------


def rating_join(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    rated = orders.select(
        F.col("o_totalprice").alias("score"), F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("createdBy_id")
    )
    pairs = customers.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("sourceText"),
        F.col("c_mktsegment").alias("targetText"),
        F.col("c_nationkey").cast("string").alias("targetID"),
    )
    return ratings.join_ratings(rated, pairs)


def _text_references(spark: SparkSession, sf: str, labelled: bool) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf, "documents")
    pairs = documents.select(F.col("doc_id").alias("row_id"), F.col("text").alias("sourceText"))
    if labelled:
        documents = documents.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    references = documents.select(
        F.col("text").alias("en"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("ka"), F.col("doc_id").alias("pos")
    )
    return pairs, references


def reference_lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.add_reference(*_text_references(spark, sf, labelled=False))


def reference_lookup_lenient(spark: SparkSession, sf: str) -> DataFrame:
    pairs, references = _text_references(spark, sf, labelled=True)
    return ratings.add_reference(pairs, references, strict=False)


def reference_missing(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.missing_references(*_text_references(spark, sf, labelled=True))


def _partly_labelled(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.col("lang").alias("sourceText"),
        F.col("text").alias("targetText"),
        F.when(F.col("quality").isNotNull(), F.col("source")).alias("referenceText"),
    )


def drop_null_texts(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.drop_null_texts(_partly_labelled(spark, sf))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents through CSV: quotes, line breaks and missing cells come back unchanged."""
    path = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    csv.write_csv(_partly_labelled(spark, sf), path)
    return csv.read_pairs_csv(spark, path, {"row_id": "bigint"})


def active_raters(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.keep_active_raters(event_ratings(spark, sf), 60)


def rater_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratings.rater_audit(event_ratings(spark, sf), 60))


def rater_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratings.rater_stats(event_ratings(spark, sf)), 9)


def rater_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ratings.standardize_by_rater(event_ratings(spark, sf), 60), 9)


def rater_zscore_binary(spark: SparkSession, sf: str) -> DataFrame:
    rated = rated_documents(spark, sf).select("row_id", "createdBy_id", "score")
    return rounded(ratings.standardize_by_rater(rated), 9)


# --- profiles ---------------------------------------------------------------------------


def metric_summary_pop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.metric_summary(line_scores(spark, sf)), 9)


def column_summary_samp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.column_summary(table(spark, sf, "lineitem"), list(LINE_METRICS)), 9)


def describe_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.describe(event_ratings(spark, sf), "score"), 9)


def describe_standardized(spark: SparkSession, sf: str) -> DataFrame:
    z = ratings.standardize_by_rater(event_ratings(spark, sf), 60)
    return rounded(profile.describe(z, "standardized_score"), 6)


def score_histogram20(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.histogram(event_ratings(spark, sf), "score"), 9)


def preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first five rated pairs."""
    return rating_join(spark, sf).orderBy("createdBy_id").limit(5)


# --- agreement ----------------------------------------------------------------------------


def pearson_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pearson(line_scores(spark, sf)), 9)


def pearson_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pearson(event_scores(spark, sf)), 9)


def spearman_avg_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spearman(line_scores(spark, sf)), 9)


def kendall_tau_b(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kendall(event_scores(spark, sf)), 9)


def corr_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlations(event_scores(spark, sf)))


def corr_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Degenerate metrics over all events: constant, absent, infinite, and one usable pair."""
    ratings_ = event_ratings(spark, sf)
    first = ratings_.agg(F.min("row_id")).scalar()
    wide = ratings_.select(
        F.col("score").alias("human"),
        F.lit(1.5).alias("constant"),
        F.lit(None).cast("double").alias("absent"),
        F.lit(float("inf")).alias("infinite"),
        F.when(F.col("row_id") == first, F.col("score")).alias("single"),
        F.col("score").alias("itself"),
        (-F.col("score")).alias("reversed"),
    )
    names = ["constant", "absent", "infinite", "single", "itself", "reversed"]
    listed = spark.createDataFrame([(n,) for n in names], "metric string")
    return rounded(correlations(wide.unpivot(["human"], names, "metric", "score"), listed))


def _event_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.with_ordinal(correlations(event_scores(spark, sf)), ["key", "hour"])


def best_metric(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.best_metrics(_event_ranking(spark, sf))


def top3_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.top_metrics(_event_ranking(spark, sf)), 9)


def significance_class(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.significance(_event_ranking(spark, sf)))


# --- text similarity ----------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str, name: str, metric: Callable[[Column, Column], Column]) -> DataFrame:
    score = metric(F.col("targetText"), F.col("referenceText")).alias(name)
    return rounded(rated_documents(spark, sf).select("row_id", score))


def bleu_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "bleu_score", lexical.bleu)


def chrf_pp(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "chrfplusplus_score", lexical.chrf_plus_plus)


def word_edit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "word_edit_rate", lexical.word_edit_rate)


def word_edit_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "wer_score", lexical.word_edit_score)


def translation_edit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Edits with moves of every reply. A greedy search is beyond SQL; tests compare it with a plain one."""
    rate = lexical.translation_edit_rate(F.col("targetText"), F.col("referenceText"))
    return rounded(replies(spark, sf).select("row_id", rate.alias("translation_edit_rate")))


def rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "rouge_score", lambda h, r: lexical.rouge_l(h, r, stem=False))


def rouge_l_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "rouge_score", lexical.rouge_l)


def rouge_l_unicode(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "rouge_score", lambda h, r: lexical.rouge_l(h, r, stem=False, unicode_tokens=True))


# --- scoring surface ------------------------------------------------------------------------


def _length_ratio(hyp: Column, ref: Column, src: Column) -> Column:
    shorter, longer = F.least(F.length(hyp), F.length(ref)), F.greatest(F.length(hyp), F.length(ref))
    return F.coalesce(F.try_divide(shorter, longer), F.lit(1.0))


def registered_metric(spark: SparkSession, sf: str) -> DataFrame:
    scoring.register_metric("Length-Ratio", _length_ratio)
    return rounded(scoring.add_scores(rated_documents(spark, sf), ["Length-Ratio"]).select("row_id", "length_ratio_score"))


def _load_model() -> Callable:
    """A stand-in for a neural model: share of the reference's characters covered in length, at most 1."""
    return lambda rows: np.array([min(1.0, len(r["mt"]) / max(1, len(r["ref"]))) for r in rows])


def model_scoring(spark: SparkSession, sf: str) -> DataFrame:
    score = scoring.model_score(F.col("targetText"), F.col("referenceText"), F.col("sourceText"), _load_model)
    return rounded(rated_documents(spark, sf).select("row_id", score.alias("comet_score")))


def sampled_mean_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling option of model scoring: the first 100 rows are scored, the others get their mean."""
    score = scoring.model_score(F.col("targetText"), F.col("referenceText"), F.col("sourceText"), _load_model)
    rated = rated_documents(spark, sf)
    filled = scoring.score_first_rows(rated, 100, lambda df: df.withColumn("comet_score", score), column="comet_score")
    return rounded(filled.select("row_id", "comet_score", "is_imputed"), 9)


def first_rated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The head limit alone."""
    return first_rows(event_ratings(spark, sf), 1000, "row_id")


def _line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.max("l_quantity").alias("A+"), F.min("l_discount").alias("B-C"), F.max("l_extendedprice").alias("human")
    )


def attach_scores_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Orders get the scores of their line items; an order without line items keeps NULL."""
    long = profile.to_long(_line_pairs(spark, sf), ["A+", "B-C"], ["row_id"])
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    return rounded(scoring.attach_scores(rows, long, ["A+", "B-C"]))


def score_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Column names for names found in the data."""
    found = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("metric")).distinct()
    return found.select("metric", score_column_expr(F.col("metric")).alias("column_name"))


def score_files(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all events through the score table and the JSON score files."""
    root = f"{scratch_root(spark)}/scores-{uuid.uuid4().hex}"
    score_io.write_scores(event_scores(spark, sf).select("row_id", "metric", "score"), f"{root}/table")
    stored = score_io.read_scores(spark, f"{root}/table")
    for name in ("hour", "key"):
        score_io.export_score_files(stored.where(F.col("metric") == name), f"{root}/{name}")
    return score_io.read_score_files(
        spark, {"hour": f"{root}/hour", "key": f"{root}/key", "lost": f"{root}/no-such-file"}
    )


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON summary, read back into one row per metric."""
    scores = materialize(event_scores(spark, sf), "event-scores")
    listed = correlations(scores)
    text = score_io.summary_json(listed, profile.metric_summary(scores), ["hour", "key", "other"], ["hour", "key"])
    values = "struct<mean double, std double, min double, max double, count bigint>"
    coefficients = "struct<pearson double, spearman double, kendall double, p_value_pearson double>"
    schema = f"correlation_results map<string, {coefficients}>, summary_statistics map<string, {values}>, registry_info struct<used_metrics array<string>>"
    parsed = text.select(F.from_json("value", schema).alias("d")).select("d.*")
    one = parsed.select("*", F.explode("registry_info.used_metrics").alias("metric"))
    return rounded(
        one.select(
            "metric",
            F.expr("correlation_results[metric].pearson").alias("pearson"),
            F.expr("correlation_results[metric].kendall").alias("kendall"),
            F.expr("summary_statistics[metric].std").alias("std"),
            F.expr("summary_statistics[metric].count").alias("count"),
        ),
        9,
    )


# --- judge ------------------------------------------------------------------------------------


def judge_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request per reply; a reply whose conversation opens with a system turn lacks its source here."""
    opened = table(spark, sf, "conversations").where("role = 'system'").select("conv_id").distinct().withColumn("opened", F.lit(True))
    pairs = replies(spark, sf).withColumn("conv_id", F.floor(F.col("row_id") / 1000)).join(opened, "conv_id", "left")
    pairs = pairs.withColumn("sourceText", F.when(F.col("opened").isNull(), F.col("sourceText")))
    return judge.judge_requests(pairs, JUDGE)


def judge_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Score parsing over every document text."""
    return table(spark, sf, "documents").select("doc_id", extract_score(F.col("text")).alias("score"))


def _result_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Result lines of a batch over all events: the answer quotes the value, errors fail, clicks expire."""
    status = (
        F.when(F.col("event_type") == "error", "errored").when(F.col("event_type") == "click", "expired").otherwise("succeeded")
    )
    answer = F.concat(F.lit("Score: "), F.col("value").cast("string"), F.lit("/100"))
    content = F.array(F.struct(answer.alias("text")))
    message = F.when(status == "succeeded", F.struct(content.alias("content")))
    result = F.struct(status.alias("type"), message.alias("message"), F.when(status == "errored", "busy").alias("error"))
    line = F.struct(judge.custom_id("reference_free", F.col("event_id")).alias("custom_id"), result.alias("result"))
    return table(spark, sf, "events").select(F.to_json(line).alias("value"))


def judge_results(spark: SparkSession, sf: str) -> DataFrame:
    """Result files written and read back."""
    path = f"{scratch_root(spark)}/results-{uuid.uuid4().hex}"
    _result_lines(spark, sf).write.text(path)
    return judge_files.read_results(spark, path)


def judge_join(spark: SparkSession, sf: str) -> DataFrame:
    """Results joined to orders by key; orders beyond the events have none."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    return judge.join_results(rows, judge.parse_results(_result_lines(spark, sf)), "reference_free")


def judge_progress(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(judge.progress(judge.parse_results(_result_lines(spark, sf))))


# --- training tables -----------------------------------------------------------------------------


def train_set(spark: SparkSession, sf: str) -> DataFrame:
    rated = rated_documents(spark, sf).select("row_id", "sourceText", "targetText", "referenceText", "score")
    source = rated.withColumnsRenamed({"score": "llm_reference_based_score_noisy"}).withColumn(
        "llm_reference_based_score", F.length("targetText").cast("double")
    )
    return rounded(training.training_set(source), 9)


def valid_set(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training.validation_set(rated_documents(spark, sf), more_than=18), 9)


# --- whole runs -----------------------------------------------------------------------------------


def evaluation_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised human score and all lexical scores, one row per rated document."""
    return rounded(evaluate(rated_documents(spark, sf), LEXICAL).wide())


def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Which lexical metric agrees best with the document labels?"""
    return rounded(evaluate(rated_documents(spark, sf), LEXICAL).report())


# --- selection, failures, stored results --------------------------------------------------------


def metric_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown names are reported and skipped; known ones keep their order."""
    names = scoring.select_metrics(["CHRF++", "no-such-metric", "BLEU"])
    scored = scoring.add_scores(rated_documents(spark, sf), names)
    return rounded(scored.select("row_id", *[score_column(m) for m in names]))


class _Output:
    """What some models return: an object that holds the scores."""

    def __init__(self, scores: list[float]) -> None:
        self.scores = scores


def model_output_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Models that return an object, a list, a column of numbers, or one number for all."""
    shapes = {
        "object_score": lambda: lambda rows: _Output([float(len(r["mt"])) for r in rows]),
        "list_score": lambda: lambda rows: [len(r["ref"]) for r in rows],
        "column_score": lambda: lambda rows: np.array([[len(r["src"])] for r in rows]),
        "scalar_score": lambda: lambda rows: 0.5,
    }
    texts = [F.col(c) for c in ("targetText", "referenceText", "sourceText")]
    return rated_documents(spark, sf).select("row_id", *[scoring.model_score(*texts, load).alias(name) for name, load in shapes.items()])


def _broken(hyp: Column, ref: Column, src: Column) -> Column:
    return F.when(F.length(hyp) > 0, F.raise_error(F.lit("out of order")).cast("double"))


def evaluation_with_failing_metric(spark: SparkSession, sf: str) -> DataFrame:
    """A metric that fails on every row is left out; the other one is scored as if alone."""
    scoring.register_metric("Broken", _broken)
    try:
        return rounded(evaluate(rated_documents(spark, sf), ["Broken", "WER"]).wide())
    finally:
        scoring.unregister_metric("Broken")


def evaluation_extra_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A lexical metric and scores computed elsewhere, in one run."""
    rated = rated_documents(spark, sf)
    extra = rated.select("row_id", F.lit("Length").alias("metric"), F.length("targetText").cast("double").alias("score"))
    return rounded(evaluate(rated, ["WER"], extra_scores=extra, extra_metrics=("Length",)).wide())


def evaluation_saved(spark: SparkSession, sf: str) -> DataFrame:
    """The wide result as written by a run and read back."""
    root = f"{scratch_root(spark)}/run-{uuid.uuid4().hex}"
    evaluate(rated_documents(spark, sf), ["WER", "CHRF++"]).save(f"{root}/data", f"{root}/summary", scoring.metric_names())
    names = ["human_score", score_column("WER"), score_column("CHRF++")]
    return rounded(csv.read_csv(spark, f"{root}/data", {n: "double" for n in names}))


def csv_annotation(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through the CSV flow: read, score, write, and statistics of the new columns."""
    root = f"{scratch_root(spark)}/annotate-{uuid.uuid4().hex}"
    csv.write_csv(rated_documents(spark, sf), f"{root}/in")
    return rounded(annotate_csv(spark, f"{root}/in", f"{root}/out", ["WER", "ROUGE"]), 9)


def _five_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Two event metrics, a copy of one, the other one turned around, and one without a value."""
    scores = event_scores(spark, sf)
    key, hour = scores.where("metric = 'key'"), scores.where("metric = 'hour'")
    made = {
        "absent": key.withColumn("score", F.lit(None).cast("double")),
        "copy": key,
        "minus": hour.withColumn("score", -F.col("score")),
    }
    for name, rows in made.items():
        scores = scores.unionByName(rows.withColumn("metric", F.lit(name)))
    names = ["absent", "key", "copy", "minus", "hour"]
    listed = spark.createDataFrame([(n,) for n in names], "metric string")
    return ranking.with_ordinal(correlations(scores, listed), names)


def best_of_five(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.best_metrics(_five_metrics(spark, sf))


def top3_of_five(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.top_metrics(_five_metrics(spark, sf)), 9)


def document_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against the next one: long texts on both sides."""
    documents = table(spark, sf, "documents").select("doc_id", F.col("text").alias("targetText"))
    other = documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("targetText").alias("referenceText"))
    h, r = F.col("targetText"), F.col("referenceText")
    scored = documents.join(other, "doc_id").select(
        "doc_id", lexical.word_edit_rate(h, r).alias("word_edit_rate"), lexical.rouge_l(h, r).alias("rouge_score")
    )
    return rounded(scored)


def judge_requests_with_references(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that quote the reference."""
    settings = judge.JudgeSettings(mode="reference_based", prompt="{source}|{hypothesis}|{reference}", model="judge-2", system="Compare.", examples="None.")
    return judge.judge_requests(replies(spark, sf), settings)


def judge_open_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that no stored result belongs to; results that failed count as open."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    return judge.without_results(rows, judge.parse_results(_result_lines(spark, sf)), "reference_free", retry=True)


def judge_mean_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Finished orders were sent to the judge; the others get the mean."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    sent = rows.where("o_orderstatus = 'F'")
    return rounded(judge.join_and_fill(rows, judge.parse_results(_result_lines(spark, sf)), sent, "reference_free"), 9)


# --- groups, corpus scores, repeated texts, stored scores ------------------------------------------


def rater_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of both event metrics with the value, for every user on their own."""
    users = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("rater"))
    found = group_correlations(event_scores(spark, sf).join(users, "row_id"), ["metric", "rater"])
    return rounded(found.select("metric", "rater", "n", "pearson", "spearman", "kendall"), 9)


def corpus_scores_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """BLEU and chrF++ of all rated documents of a source and label together."""
    by = ["createdBy_id", "score"]
    return rounded(corpus.corpus_scores(corpus.corpus_counts(rated_documents(spark, sf), by), by))


def corpus_scores_added(spark: SparkSession, sf: str) -> DataFrame:
    """The same per source, from stored counts per source and label; no text is read again."""
    counts = materialize(corpus.corpus_counts(rated_documents(spark, sf), ["createdBy_id", "score"]), "corpus-counts")
    return rounded(corpus.corpus_scores(corpus.add_counts(counts, ["createdBy_id"]), ["createdBy_id"]))


def scores_of_distinct_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents against a reference that their length picks: copies are scored once, as the row ``scored_key``."""
    benchmark = table(spark, sf, "benchmark")
    size = benchmark.agg(F.count("*")).scalar()
    pairs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("targetText"))
    pairs = pairs.withColumn("item_id", F.length("targetText") % size).join(benchmark.withColumnRenamed("text", "referenceText"), "item_id")
    return rounded(scoring.scores_once(pairs.drop("item_id"), ["WER", "CHRF++"]))


def evaluation_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A run that finds the scores of even rows in the store, each of them 0.5, and computes the others."""
    store = f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"
    rated = rated_documents(spark, sf)
    stored = rated.where("row_id % 2 = 0").select("row_id", F.lit("WER").alias("metric"), F.lit(0.5).alias("score"))
    score_io.add_to_store(stored, store)
    return rounded(evaluate(rated, ["WER"], store=store).wide())


def _length_offset(texts: DataFrame) -> DataFrame:
    """How much longer a candidate is than the mean of all candidates of its source text's length in words."""
    words = F.size(F.split("sourceText", " "))
    means = texts.groupBy(words.alias("words")).agg(F.avg(F.length("targetText")).alias("mean"))
    return texts.join(means, words == F.col("words")).select("row_id", (F.length("targetText") - F.col("mean")).alias("score"))


def registered_table_metric(spark: SparkSession, sf: str) -> DataFrame:
    """An own metric that needs the whole table, next to one that needs a row."""
    scoring.register_table_metric("Length-Offset", _length_offset)
    try:
        wide = rounded(evaluate(rated_documents(spark, sf), ["Length-Offset", "WER"]).wide())
        # A difference that rounds to zero from below would be minus zero.
        return wide.withColumn("length_offset_score", F.col("length_offset_score") + 0.0)
    finally:
        scoring.unregister_metric("Length-Offset")


SHARES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def sketched_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Line item scores sketched per metric and status, stored and merged per metric; do the estimates keep their errors?"""
    scores = line_scores(spark, sf).select("metric", "score")
    scores = scores.union(table(spark, sf, "lineitem").select(F.lit("l_extendedprice"), "l_extendedprice"))
    stored = materialize(sketch_scores(scores.withColumn("part", F.floor(F.col("score") * 10) % 7), ["metric", "part"]), "sketches")
    found = materialize(sketch_summary(merge_sketches(stored, ["metric"]), ["metric"], SHARES), "summaries")
    met = scores.join(found.drop("n", "mean", "min", "max"), "metric")
    counts = [F.avg((F.col("score") < F.col(q)).cast("int")).alias(f"below_{q}") for q in SHARES]
    counts += [F.avg((F.col("score") <= F.col(q)).cast("int")).alias(f"up_to_{q}") for q in SHARES]
    exact = met.groupBy("metric").agg(*counts, F.countDistinct("score").alias("values"))
    # The stated bound holds with a probability of 0.99 a quantile; twice the bound, practically always.
    error = 2 * rank_error()
    held = [F.lit(share).between(F.col(f"below_{q}") - error, F.col(f"up_to_{q}") + error) for q, share in SHARES.items()]
    apart = F.abs(F.col("n_distinct") - F.col("values"))
    return rounded(
        found.join(exact, "metric").select(
            "metric", "n", "mean", "min", "max", *[h.alias(f"{q}_held") for q, h in zip(SHARES, held)], (apart <= distinct_error() * F.col("values")).alias("distinct_held")
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rating_join,
        reference_lookup_last_wins,
        reference_lookup_lenient,
        reference_missing,
        drop_null_texts,
        csv_round_trip,
        active_raters,
        rater_filter_audit,
        rater_statistics,
        rater_zscore,
        rater_zscore_binary,
        metric_summary_pop,
        column_summary_samp,
        describe_scores,
        describe_standardized,
        score_histogram20,
        preview,
        pearson_lines,
        pearson_events,
        spearman_avg_rank,
        kendall_tau_b,
        corr_pvalues,
        corr_guards,
        best_metric,
        top3_metrics,
        significance_class,
        bleu_sentence,
        chrf_pp,
        word_edit_rate,
        word_edit_score,
        translation_edit_rate,
        rouge_l,
        rouge_l_stemmed,
        rouge_l_unicode,
        registered_metric,
        model_scoring,
        sampled_mean_fill,
        first_rated_rows,
        attach_scores_wide,
        score_columns,
        score_files,
        run_summary,
        judge_requests,
        judge_extract,
        judge_results,
        judge_join,
        judge_progress,
        train_set,
        valid_set,
        evaluation_scores,
        evaluation_report,
        metric_selection,
        model_output_shapes,
        evaluation_with_failing_metric,
        evaluation_extra_scores,
        evaluation_saved,
        csv_annotation,
        best_of_five,
        top3_of_five,
        document_overlap,
        judge_requests_with_references,
        judge_open_rows,
        judge_mean_fill,
        rater_agreement,
        corpus_scores_by_source,
        corpus_scores_added,
        scores_of_distinct_texts,
        evaluation_resumed,
        registered_table_metric,
        sketched_scores,
    )
}
