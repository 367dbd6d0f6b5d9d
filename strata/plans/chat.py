"""Questions and answers as chat history: what was asked and answered is added to the conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import store as ST
from ..schemas import TIMED_MESSAGE


def exchanges(history: DataFrame, questions: DataFrame, answers: DataFrame, at: Column) -> DataFrame:
    """Each question (conv_id, query_id, query) as a user's message and its answer (query_id, answer) as the
    assistant's, at time ``at``, after the last turn of its conversation in ``history``; several questions
    of one conversation follow each other by query_id."""
    last = history.groupBy("conv_id").agg((F.max("turn") + 1).alias("next"))
    # questions of one conversation at once: few, like the turns of a person
    asked = questions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("query_id", "query"))).alias("qs"))
    asked = (asked.join(last, "conv_id", "left")
             .select("conv_id", F.coalesce("next", F.lit(0)).alias("next"), F.posexplode("qs").alias("n", "q"))
             .select("conv_id", (F.col("next") + 2 * F.col("n")).alias("turn"), "q.query_id", "q.query"))
    both = F.array(F.struct("turn", F.lit("user").alias("role"), F.col("query").alias("text")),
                   F.struct((F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    rows = asked.join(answers.select("query_id", "answer"), "query_id").select("conv_id", F.explode(both).alias("m"))
    return rows.select("conv_id", "m.turn", "m.role", "m.text", at.cast("string").alias("ts"))


def log_answers(spark: SparkSession, root: str, questions: DataFrame, answers: DataFrame, at: Column,
                max_history: int = K.MAX_HISTORY) -> int:
    """SNK4: append the exchanges to the history under ``root`` and keep the last messages of each
    conversation. ``at`` is the time of the messages (seconds as text): a parameter, so that a repeated job
    writes the same."""
    history = ST.read_state(spark, root, TIMED_MESSAGE)
    return ST.append_history(spark, root, exchanges(history, questions, answers, at), TIMED_MESSAGE, max_history)
