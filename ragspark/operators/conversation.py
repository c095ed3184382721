"""Conversations: history windows, titles, citations, prompts, provenance and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions.text import trimmed, truncated

HISTORY = 10
NONE_PROMPT = "No documents were searched. Answer greetings, questions about this product, or from the conversation alone."
EMPTY_PROMPT = "The documents hold nothing on this. Say so, and ask for more documents."
CONTEXT_PROMPT = "Answer from the passages below. Mark each use with [n], its number. Say when they are not enough.\n\n"


def chat_history(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """For every message the last ``n`` messages before it that are not blank, oldest first: session_id, id, history."""
    said = trimmed(F.coalesce("content", F.lit(""))) != ""
    # a blank message takes no part in other histories: of the places before each one, those of the last n that are said
    place = Window.partitionBy("session_id").orderBy("id")
    rows = messages.select("session_id", "id", F.when(said, F.struct("role", "content")).alias("_m")).withColumn("_k", F.count("_m").over(place.rowsBetween(Window.unboundedPreceding, -1)))
    near = Window.partitionBy("session_id").orderBy("_k").rangeBetween(-n, -1)
    none = F.expr("cast(array() as array<struct<role:string,content:string>>)")
    told = F.array_sort(F.collect_list(F.when(F.col("_m").isNotNull(), F.struct("id", "_m"))).over(near))
    return rows.withColumn("_h", told).select("session_id", "id", F.coalesce(F.transform("_h", lambda x: x["_m"]), none).alias("history"))


def session_titles(messages: DataFrame, n: int = 30) -> DataFrame:
    """The first question of each session, cut to ``n`` characters."""
    return messages.where("role = 'user'").groupBy("session_id").agg(F.substring(F.min_by("content", "id"), 1, n).alias("title"))


def session_listing(sessions: DataFrame, datasets: DataFrame, dataset_id: int | None = None, status: int | None = None) -> DataFrame:
    """Sessions with their dataset's name, newest first; a dataset that is gone is flagged.  Filters that are None don't apply."""
    if dataset_id is not None:
        sessions = sessions.where(F.col("dataset_id") == dataset_id)
    if status is not None:
        sessions = sessions.where(F.col("status") == status)
    named = sessions.join(datasets.select("dataset_id", F.col("name").alias("dataset_name")), "dataset_id", "left")
    named = named.withColumn("dataset_name", F.coalesce("dataset_name", F.lit(""))).withColumn("dataset_deleted", F.col("dataset_name") == "")
    return named.orderBy(F.col("updated_at").desc(), "session_id")


def citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that an answer uses, by markers [n]: message_id, position, chunk_id, score.

    answers: message_id, content; hits: message_id, rank, chunk_id, score, ranks from 1.
    """
    marks = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)).cast("array<int>"))
    used = answers.select("message_id", F.explode(marks).alias("rank")).distinct()
    return hits.join(used, ["message_id", "rank"]).select("message_id", F.col("rank").alias("position"), "chunk_id", "score")


def citation_provenance(cited: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations of each message in order, with content and document name; a chunk that is gone is left out, a missing name empty."""
    full = cited.join(chunks.select("chunk_id", "document_id", "content"), "chunk_id").join(documents.select("document_id", "name"), "document_id", "left")
    one = F.struct("position", "chunk_id", "document_id", F.coalesce("name", F.lit("")).alias("document_name"), "score")
    return full.groupBy("message_id").agg(F.array_sort(F.collect_list(one)).alias("citations"))


def prompt_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, prompt: numbered passages in rank order, or one of two instructions where there are none.

    questions: question_id, query_type; hits: question_id, rank, document_name, content.
    """
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 文档《"), "document_name", F.lit("》：\n"), "content", F.lit("\n\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))), lambda x: x["p"]), "")
    known = hits.groupBy("question_id").agg(text.alias("passages"))
    prompt = F.when(F.col("query_type") == "none", NONE_PROMPT).when(F.col("passages").isNull(), EMPTY_PROMPT).otherwise(F.concat(F.lit(CONTEXT_PROMPT), "passages"))
    return questions.join(known, "question_id", "left").select("question_id", prompt.alias("prompt"))


def purge(table: DataFrame, gone: DataFrame, key: str | list[str]) -> DataFrame:
    """What is left of ``table`` when all rows with a key in ``gone`` go."""
    return table.join(gone.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti")


def purge_scope(sessions: DataFrame, messages: DataFrame, cited: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """All three tables after the accounts ``users`` (user_id) are deleted with what hangs on them."""
    dead = sessions.join(users.select("user_id").distinct(), "user_id", "left_semi").select("session_id")
    lost = messages.join(dead, "session_id", "left_semi").select(F.col("id").alias("message_id"))
    return {"sessions": purge(sessions, users, "user_id"), "messages": purge(messages, dead, "session_id"), "citations": purge(cited, lost, "message_id")}


def preview(text: str, n: int):  # noqa: ANN201
    return truncated(F.col(text), n)
