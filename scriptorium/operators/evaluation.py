"""Retrieval and answer quality by vectors: relevancy, faithfulness, precision, recall, and the comparison of methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.errors import RetrievalError
from scriptorium.functions import text as T
from scriptorium.functions import vector as V
from scriptorium.functions.exact import exact_mean

FAITHFUL, RELEVANT = 0.40, 0.45


def relevancy(qa: DataFrame) -> DataFrame:
    """(qa_id, question_vec, answer_vec) -> qa_id, relevancy."""
    return qa.select("qa_id", V.cosine(F.col("question_vec"), F.col("answer_vec")).alias("relevancy"))


def supported_share(sentence_vecs: DataFrame, context_vecs: DataFrame, threshold: float, name: str) -> DataFrame:
    """(qa_id, sentence, vec) and (qa_id, rank, vec) -> qa_id, share of sentences whose best context reaches the threshold.

    The join is within a question, and a question has a handful of contexts.
    """
    best = sentence_vecs.join(context_vecs.select("qa_id", F.col("vec").alias("c")), "qa_id").groupBy("qa_id", "sentence").agg(F.max(F.round(V.cosine(F.col("vec"), F.col("c")), 6)).alias("best"))
    return best.groupBy("qa_id").agg(F.avg((F.col("best") >= threshold).cast("double")).alias(name))


def sentence_rows(texts: DataFrame, column: str, embed=V.hashed_embedding) -> DataFrame:
    """qa_id, sentence (its place), vec."""
    rows = texts.select("qa_id", F.posexplode(T.sentences(F.col(column))).alias("sentence", "s"))
    return rows.select("qa_id", "sentence", embed(F.col("s")).alias("vec"))


def precision(questions: DataFrame, context_vecs: DataFrame, threshold: float = RELEVANT) -> DataFrame:
    """(qa_id, question_vec) -> qa_id, context_precision: share of contexts at least that similar to the question."""
    rows = context_vecs.join(questions.select("qa_id", "question_vec"), "qa_id")
    return rows.groupBy("qa_id").agg(F.avg((F.round(V.cosine(F.col("question_vec"), F.col("vec")), 6) >= threshold).cast("double")).alias("context_precision"))


def evaluate(qa: DataFrame, context_vecs: DataFrame, embed=V.hashed_embedding) -> DataFrame:
    """(qa_id, question, answer, ground_truth) and (qa_id, rank, vec) -> one row of each question's four metrics.

    No sentences give 0. A question without contexts or without an answer, or whose `status` (where qa has it) is not ok, has null metrics and
    counts as failed: it is not scored as an empty text.
    """
    fine = F.col("answer").isNotNull() & (F.coalesce(F.col("status") == "ok", F.lit(False)) if "status" in qa.columns else F.lit(True))
    qa = qa.where(fine).unionByName(qa.where(~fine).withColumn("answer", F.lit(None).cast("string")))
    base = qa.select("qa_id", "answer", "ground_truth", embed(F.col("question")).alias("question_vec"), embed(F.col("answer")).alias("answer_vec"))
    faithful = supported_share(sentence_rows(base, "answer", embed), context_vecs, FAITHFUL, "faithfulness")
    recall = supported_share(sentence_rows(base, "ground_truth", embed), context_vecs, RELEVANT, "context_recall")
    has = context_vecs.select("qa_id").distinct().join(base.where("answer is not null").select("qa_id"), "qa_id", "left_semi").withColumn("ok", F.lit(True))
    out = relevancy(base).join(has, "qa_id", "left").join(faithful, "qa_id", "left").join(precision(base, context_vecs), "qa_id", "left").join(recall, "qa_id", "left")
    zero = lambda c: F.when(F.col("ok"), F.coalesce(c, F.lit(0.0))).alias(c)
    return out.select("qa_id", F.when(F.col("ok"), F.col("relevancy")).alias("answer_relevancy"), zero("faithfulness"), zero("context_precision"), zero("context_recall"))


METRICS = ("answer_relevancy", "faithfulness", "context_precision", "context_recall")


def report(per_question: DataFrame) -> DataFrame:
    """Means over the questions that could be evaluated, to four places, and how many those are."""
    return per_question.where("faithfulness is not null").agg(*[exact_mean(F.col(m)).alias(m) for m in METRICS], F.count("*").alias("num_evaluated"))


def comparison(questions: DataFrame, per_question: DataFrame) -> DataFrame:
    """(qa_id, question_type, method) and metrics by (qa_id, method) -> means in which questions without hits score 0."""
    joined = questions.join(per_question, ["qa_id", "method"], "left")
    mean = lambda m: exact_mean(F.coalesce(m, F.lit(0.0))).alias(m)
    missed = exact_mean(F.col("faithfulness").isNull().cast("double")).alias("zero_result_rate")
    return joined.groupBy("question_type", "method").agg(mean("faithfulness"), mean("context_precision"), missed, F.count("*").alias("num_questions"))


def retrieved_by(method: str, by_vector: DataFrame, by_graph: DataFrame) -> DataFrame:
    if method not in ("vector", "graph"):
        raise RetrievalError(f"unknown retrieval method: {method}")
    return (by_vector if method == "vector" else by_graph).withColumn("method", F.lit(method))
