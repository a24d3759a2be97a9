"""Composed chat plans: validated questions, retrieval, generation through a provider, fallback choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.operators import evaluate, providers

FALLBACK_ANSWER = "No reliable passage was found for this question."


def answers(questions: DataFrame, contexts: DataFrame, generate: Callable[[list[str]], list[str]], history: DataFrame | None = None) -> DataFrame:
    """query_id, answer, status of questions (query_id, text) with contexts (query_id, context, sources, low_confidence).

    Refused questions and those without a reliable context never reach the model.
    """
    q = questions.select("query_id", X.clean_query(F.col("text")).alias("question"), X.query_error(F.col("text")).alias("error"))
    rows = q.join(contexts, "query_id", "left")
    if history is not None:
        rows = rows.join(history.select("query_id", "messages"), "query_id", "left")
    weak = F.coalesce("low_confidence", F.lit(True)) | (F.coalesce("context", F.lit("")) == "")
    status = F.when(F.col("error").isNotNull(), "refused").when(weak, "fallback").otherwise("answered")
    rows = rows.withColumn("status", status).withColumn("prompt", F.when(status == "answered", X.prompt(F.col("question"), F.col("context"))))
    asked = providers.generate(rows.filter("status = 'answered'"), generate)
    told = rows.filter("status != 'answered'").withColumn("answer", F.when(F.col("status") == "refused", F.concat(F.lit("Refused: "), "error")).otherwise(F.lit(FALLBACK_ANSWER)))
    both = asked.unionByName(told)
    return both.select("query_id", "status", with_sources(F.col("answer"), F.col("sources"), F.col("status") == "answered").alias("answer"))


def with_sources(answer: Column, sources: Column, show: Column) -> Column:
    return F.when(show & (F.coalesce(sources, F.lit("")) != ""), F.concat(answer, F.lit("\n\nSources: "), sources)).otherwise(answer)


def best_of(simple: DataFrame, agent: DataFrame, keywords: DataFrame, pass_at: float = 0.8) -> DataFrame:
    """query_id, answer, used_fallback: the simple answer unless it fails and the agent's scores strictly higher."""
    score = lambda df, name: evaluate.response(df.join(keywords, "query_id"), pass_at=pass_at).select("query_id", F.col("answer").alias(name), F.col("quality_score").alias(f"{name}_q"), F.col("passed").alias(f"{name}_ok"))
    both = score(simple, "simple").join(score(agent, "agent"), "query_id", "left")
    use = ~F.col("simple_ok") & (F.coalesce("agent_q", F.lit(-1.0)) > F.col("simple_q"))
    return both.select("query_id", F.when(use, F.col("agent")).otherwise(F.col("simple")).alias("answer"), use.alias("used_fallback"))
