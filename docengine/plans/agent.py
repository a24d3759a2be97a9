"""The agent graph as supersteps: all conversations go one step at a time by route, tools and budget until none is left.

A conversation's state is its last message, its count of tool calls and whether it is done: a row.  Each step writes the new
states to the shared folder, so a lost executor costs one step, and the messages of a step are a folder of the transcript.
A conversation takes at most two steps a tool call and three more, so the number of steps is bounded by the budget; a step is
one pass over the conversations still under way, whatever their number.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.operators.providers import generate
from docengine.sources.files import remove, scratch, written


def next_step(role: Column, text: Column, calls: Column, budget: int) -> Column:
    """As ``sessions.route``, of the last message."""
    return F.when(calls >= budget, "answer").when(role == "tool", "agent").when((role == "assistant") & text.contains("tool:"), "tools").when(role == "assistant", "end").otherwise("agent")


def run(messages: DataFrame, agent: Callable[[list[str]], list[str]], tool: Callable[[DataFrame], DataFrame], answer: Callable[[list[str]], list[str]], budget: int = 2) -> DataFrame:
    """conv_id, step (from 1), role, text: what the agent adds to conversations (conv_id, turn, role, text).

    ``agent`` and ``answer`` map last messages to new ones, in batches inside tasks.  ``tool`` maps a table (conv_id, text) of
    calls to (conv_id, result), with whatever joins it needs; a call without a result gets an empty one.  Null roles and
    texts are empty; rows without a conv_id are left out.
    """
    spark, path = messages.sparkSession, scratch(messages.sparkSession, "transcript")
    good = messages.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = good.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), F.struct("turn", "role", "text")).alias("m"), F.count_if(F.col("role") == "tool").alias("calls"))
    state = written(last.select("conv_id", "m.role", "m.text", "calls").withColumn("next", next_step(F.col("role"), F.col("text"), F.col("calls"), budget)).filter("next != 'end'"), "agent")
    step, schema = 0, f"conv_id {good.schema['conv_id'].dataType.simpleString()}, role string, text string, step int"
    while state.limit(1).count():
        step += 1
        said = [generate(state.filter(f"next = '{name}'").withColumn("prompt", F.col("text")), provider).select("conv_id", F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("text"), "calls", F.lit(name == "answer").alias("done")) for name, provider in (("agent", agent), ("answer", answer))]
        asked = state.filter("next = 'tools'")
        found = asked.join(tool(asked.select("conv_id", "text")).select("conv_id", "result"), "conv_id", "left")
        used = found.select("conv_id", F.lit("tool").alias("role"), F.coalesce("result", F.lit("")).alias("text"), (F.col("calls") + 1).alias("calls"), F.lit(False).alias("done"))
        new = written(said[0].unionByName(said[1]).unionByName(used), "agent-step")
        new.select("conv_id", "role", "text").write.parquet(f"{path}/step={step}")
        following = written(new.filter("not done").drop("done").withColumn("next", next_step(F.col("role"), F.col("text"), F.col("calls"), budget)).filter("next != 'end'"), "agent")
        remove(state, new)
        state = following
    if not step:
        return spark.createDataFrame([], schema).select("conv_id", "step", "role", "text")
    return spark.read.schema(schema).option("basePath", path).parquet(path).select("conv_id", "step", "role", "text")


def streamed(df: DataFrame, provider: Callable[[str], Iterator[str]], seconds: float = 90.0, prompt: str = "prompt") -> DataFrame:
    """Adds ``answer``, joined from streamed parts, and ``timed_out``: no part is taken after ``seconds`` of real time."""

    @F.pandas_udf("answer string, timed_out boolean")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            rows = []
            for p in series.fillna(""):
                began, parts, late = time.monotonic(), [], False
                for part in provider(p):
                    if time.monotonic() - began > seconds:
                        late = True
                        break
                    parts.append(part)
                rows.append(("".join(parts), late))
            yield pd.DataFrame(rows, columns=["answer", "timed_out"])

    return df.withColumn("_told", tell(F.col(prompt))).select("*", "_told.answer", "_told.timed_out").drop("_told")


def gguf_prompt(system: Column, question: Column) -> Column:
    """One text of turns, for models that take no list of messages."""
    return F.concat(F.lit("<|system|>\n"), system, F.lit("\n<|user|>\n"), question, F.lit("\n<|assistant|>\n"))
