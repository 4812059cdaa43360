"""Conversations with tools as a dataflow: talks are a table, a round is one pass of the model and one join
with what the tools answer.

A model's replies are written before anything is made of them, and a round leaves two tables: talks that
have ended, and those that go on. So only unfinished talks are read again, a lost executor costs no reply
twice, and a run that is started anew in the same folder goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators.scoring import FINAL_QUESTION, clean_schema

CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,tool_call_id:string,tool_calls:array<{CALL}>>"
TALKS = f"id string, messages array<{MESSAGE}>"

#: A model, loaded once a task: talks and the tools' schemas to replies, as a chat endpoint has them.
Chat = Callable[[], Callable[[list[list[dict]], list[dict]], list[dict]]]


@dataclass
class TableTool:
    """A tool that answers many calls at once: ``answer`` makes (key, content) of (key, arguments), arguments as JSON.
    A call that it leaves out has no result."""

    name: str
    description: str
    parameters: dict
    answer: Callable[[DataFrame], DataFrame]

    def schema(self) -> dict:
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": clean_schema(self.parameters)}}


def lookup_tool(name: str, description: str, argument: str, table: DataFrame) -> TableTool:
    """Looks one text up in ``table`` (key, content), keys distinct."""
    schema = {"type": "object", "properties": {argument: {"type": "string"}}, "required": [argument]}

    def answer(calls: DataFrame) -> DataFrame:
        given = F.from_json("arguments", "map<string,string>")
        asked = calls.select("key", given.isNull().alias("bad"), given[argument].alias("of"))
        hit = asked.join(table.select(F.col("key").alias("of"), "content"), "of", "left")
        said = F.when(F.col("bad"), "Error: arguments are no JSON").when(F.col("of").isNull(), f"Error: {argument} is missing")
        return hit.select("key", said.otherwise(F.coalesce("content", F.lit("No results."))).alias("content"))

    return TableTool(name, description, schema, answer)


def first_messages(rows: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """Talks that open with what the user says."""
    message = F.struct(F.lit("user").alias("role"), F.col(content_col).cast("string").alias("content"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast(f"array<{CALL}>").alias("tool_calls"))
    return rows.select(F.col(id_col).cast("string").alias("id"), F.array(message).cast(f"array<{MESSAGE}>").alias("messages"))


def as_chat(messages: list[dict]) -> list[dict]:
    """A talk as chat endpoints have it: without what a message lacks."""
    out = []
    for m in messages:
        calls = [{"id": c["id"], "type": "function", "function": {"name": c["name"], "arguments": c["arguments"]}} for c in m["tool_calls"] or []]
        out.append({"role": m["role"], "content": m["content"]} | ({"tool_call_id": m["tool_call_id"]} if m["tool_call_id"] else {}) | ({"tool_calls": calls} if calls else {}))
    return out


@dataclass
class ToolRounds:
    """``chat`` talks until it answers with content and calls no tool; an empty reply is asked again. After at most
    ``rounds`` a final question is put, to which ``confidence`` gives a number. ``folder`` holds the rounds."""

    chat: Chat
    confidence: Callable[[], Callable[[list[list[dict]]], list[float]]]
    tools: list[TableTool] = field(default_factory=list)
    rounds: int = 10
    folder: str = ""

    def run(self, talks: DataFrame) -> DataFrame:
        """(id, confidence, messages) of talks (id, messages), ids distinct."""
        spark, open_, closed = talks.sparkSession, talks, []
        for k in range(self.rounds):
            at = f"{self.folder}/round-{k:03}"
            if not _made(spark, f"{at}/open"):
                self._round(open_, at)
            closed.append(spark.read.schema(TALKS).parquet(f"{at}/closed"))
            open_ = spark.read.schema(TALKS).parquet(f"{at}/open")
            if open_.isEmpty():
                break
        every = reduce(DataFrame.unionByName, [*closed, open_])
        final = F.struct(F.lit("user").alias("role"), F.lit(FINAL_QUESTION).alias("content"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast(f"array<{CALL}>").alias("tool_calls"))
        return self._scored(every.withColumn("messages", F.concat("messages", F.array(final))))

    def _round(self, talks: DataFrame, at: str) -> None:
        spark = talks.sparkSession
        if not _made(spark, f"{at}/replies"):
            self._asked(talks).write.mode("overwrite").parquet(f"{at}/replies")
        got = spark.read.schema(f"{TALKS}, content string, tool_calls array<{CALL}>").parquet(f"{at}/replies")
        none = F.lit(None).cast("string")
        said = F.struct(F.lit("assistant").alias("role"), "content", none.alias("tool_call_id"), "tool_calls")
        calls, empty = F.size("tool_calls") > 0, F.coalesce(F.col("content"), F.lit("")) == ""
        got = got.withColumn("calls", F.coalesce(calls, F.lit(False)))
        ended = got.where(~F.col("calls") & ~empty).select("id", F.concat("messages", F.array(said)).alias("messages"))
        ended.write.mode("overwrite").parquet(f"{at}/closed")

        # a call is told by its talk and its place in the reply
        flat = got.where("calls").select("id", F.posexplode("tool_calls").alias("n", "call"))
        flat = flat.select(F.struct("id", "n").alias("key"), F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.coalesce("call.arguments", F.lit("{}")).alias("arguments"))
        known = [t.name for t in self.tools]
        answers = [flat.where(F.col("name").isNull() | ~F.col("name").isin(known)).select("key", F.concat(F.lit("Error: unknown tool "), F.coalesce("name", F.lit(""))).alias("content"))]
        answers += [t.answer(flat.where(F.col("name") == t.name).select("key", "arguments")).select("key", "content") for t in self.tools]
        told = flat.join(reduce(DataFrame.unionByName, answers), "key", "left")
        message = F.struct(F.lit("tool").alias("role"), F.coalesce("content", F.lit("No results.")).alias("content"), F.col("call_id").alias("tool_call_id"), F.lit(None).cast(f"array<{CALL}>").alias("tool_calls"))
        told = told.groupBy(F.col("key.id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("key.n").alias("n"), message.alias("m")))).alias("told"))
        on = got.where("calls").join(told, "id").select("id", F.concat("messages", F.array(said), F.transform("told", lambda x: x["m"])).alias("messages"))
        on = on.unionByName(got.where(~F.col("calls") & empty).select("id", "messages"))
        on.write.mode("overwrite").parquet(f"{at}/open")  # last: with it the round is made

    def _asked(self, talks: DataFrame) -> DataFrame:
        chat, schemas = self.chat, [t.schema() for t in self.tools]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            talk = chat()
            for b in batches:
                replies = talk([as_chat(m) for m in b.column("messages").to_pylist()], schemas) if b.num_rows else []
                calls = [[{"id": c.get("id"), "name": c.get("function", {}).get("name"), "arguments": c.get("function", {}).get("arguments")} for c in r.get("tool_calls") or []] for r in replies]
                kind = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())]))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("messages"), pa.array([r.get("content") for r in replies], pa.string()), pa.array(calls, kind)], ["id", "messages", "content", "tool_calls"])

        return talks.select("id", "messages").mapInArrow(run, f"{TALKS}, content string, tool_calls array<{CALL}>")

    def _scored(self, talks: DataFrame) -> DataFrame:
        load = self.confidence

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = load()
            for b in batches:
                given = score([as_chat(m) for m in b.column("messages").to_pylist()]) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(given, pa.float64()), b.column("messages")], ["id", "confidence", "messages"])

        return talks.mapInArrow(run, f"id string, confidence double, messages array<{MESSAGE}>")


def _made(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
