"""Scoring by batches of a chat endpoint, as a table of batches with a state.

Submitting, looking and fetching are steps of their own; each is a short job whose result is written, and
each may be run again at any time. Nothing waits in a task: between two looks no executor is held. A batch
carries a key of its run and number, so a submission that died half-way finds what it has sent already
and sends the rest; batches that were fetched are not fetched again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators.conversations import _made
from kgloom.operators.scoring import ENDED, BatchEndpoint, batch_requests, first_token_confidence

REPLY = "choices array<struct<logprobs:struct<content:array<struct<top_logprobs:array<struct<token:string,logprob:double>>>>>>>"


@dataclass
class BatchRun:
    """``endpoint.call`` reaches the service, from tasks. ``folder`` holds the run's tables: requests, batches, looks
    and replies. At most about ``size`` requests are a batch."""

    endpoint: BatchEndpoint
    model: str
    folder: str
    size: int = 20_000

    def submit(self, prompts: DataFrame) -> DataFrame:
        """(batch, remote) of the batches of prompts (id, prompt), ids distinct; what was submitted before is not again."""
        spark, name, endpoint = prompts.sparkSession, self.folder.rstrip("/").rsplit("/", 1)[-1], self.endpoint
        if not _made(spark, f"{self.folder}/requests"):
            n = max(1, -(-prompts.count() // self.size))
            lines = batch_requests(prompts, self.model).withColumn("id", F.get_json_object("value", "$.custom_id"))
            lines.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("batch"), "id", "value").write.mode("overwrite").parquet(f"{self.folder}/requests")
        if _made(spark, f"{self.folder}/batches"):
            return self._read(spark, "batches")
        known = self._known(name)

        def send(lines: pa.Table) -> pa.Table:
            number = lines.column("batch")[0].as_py()
            remote = known.get(f"{name}-{number}")
            if remote is None:
                sent = endpoint.call("POST", "/v1/files", ("\n".join(lines.column("value").to_pylist()) + "\n").encode())
                body = {"input_file_id": sent["id"], "endpoint": endpoint.endpoint, "completion_window": endpoint.window, "metadata": {"key": f"{name}-{number}"}}
                remote = endpoint.call("POST", "/v1/batches", body)["id"]
            return pa.table({"batch": [number], "remote": [remote]})

        # a group is a batch, whose requests are one upload
        made = self._read(spark, "requests").select("batch", "value").groupBy("batch").applyInArrow(send, "batch bigint, remote string")
        made.write.mode("overwrite").parquet(f"{self.folder}/batches")
        return self._read(spark, "batches")

    def _known(self, name: str) -> dict[str, str]:
        """Batches of this run that the service has, by their key."""
        out, after = {}, ""
        while True:
            page = self.endpoint.call("GET", "/v1/batches?limit=100" + (f"&after={after}" if after else ""), None)
            rows = page.get("data") or []
            out |= {r["metadata"]["key"]: r["id"] for r in rows if (r.get("metadata") or {}).get("key", "").startswith(f"{name}-")}
            if not rows or not page.get("has_more"):
                return out
            after = rows[-1]["id"]

    def look(self, spark: SparkSession) -> dict[str, int]:
        """Asks once after every batch that has not ended, and returns how many batches are in which state."""
        endpoint, last = self.endpoint, self._looks(spark)
        seen = self._read(spark, "batches")
        if last is not None:
            seen = seen.join(last.where(F.col("status").isin(*ENDED)), "batch", "left_anti")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [endpoint.call("GET", f"/v1/batches/{r}", None) for r in b.column("remote").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("batch"), *[pa.array([g.get(c) for g in got], pa.string()) for c in ("status", "output_file_id", "error_file_id")]], ["batch", "status", "output", "errors"])

        new = seen.select("batch", "remote").mapInArrow(ask, "batch bigint, status string, output string, errors string")
        new.withColumn("at", F.lit(time.time())).write.mode("append").parquet(f"{self.folder}/looks")
        return {r["status"]: r["count"] for r in self._looks(spark).groupBy("status").count().collect()}

    def _looks(self, spark: SparkSession) -> DataFrame | None:
        """The latest state of each batch."""
        if not _made(spark, f"{self.folder}/looks"):
            return None
        row = F.max_by(F.struct("status", "output", "errors"), "at")
        return self._read(spark, "looks").groupBy("batch").agg(row.alias("x")).select("batch", "x.*")

    def fetch(self, spark: SparkSession) -> None:
        """Reads the replies of batches that are complete and were not fetched yet."""
        endpoint, done = self.endpoint, self._looks(spark)
        if done is None:
            return
        done = done.where("status = 'completed' and output is not null")
        if _made(spark, f"{self.folder}/replies"):
            done = done.join(self._read(spark, "replies").select("batch").distinct(), "batch", "left_anti")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for number, file in zip(b.column("batch").to_pylist(), b.column("output").to_pylist()):
                    rows = [json.loads(x) for x in endpoint.call("GET", f"/v1/files/{file}/content", None).splitlines() if x.strip()]
                    yield pa.RecordBatch.from_pydict({"batch": pa.array([number] * len(rows), pa.int64()), "id": pa.array([r["custom_id"] for r in rows], pa.string()), "body": pa.array([json.dumps((r.get("response") or {}).get("body")) for r in rows], pa.string())})

        done.select("batch", "output").mapInArrow(read, "batch bigint, id string, body string").write.mode("append").parquet(f"{self.folder}/replies")

    def run(self, prompts: DataFrame, looks: int = 10_000) -> None:
        """All steps: submits, then looks and fetches until all batches have ended, waiting here in between."""
        self.submit(prompts)
        for _ in range(looks):
            states = self.look(prompts.sparkSession)
            self.fetch(prompts.sparkSession)
            if set(states) <= set(ENDED):
                return
            time.sleep(self.endpoint.wait)

    def unanswered(self, spark: SparkSession) -> DataFrame:
        """(id, batch, status) of requests without a reply."""
        asked = self._read(spark, "requests").select("id", "batch")
        if _made(spark, f"{self.folder}/replies"):
            asked = asked.join(self._read(spark, "replies").select("id"), "id", "left_anti")
        looks = self._looks(spark)
        return asked.withColumn("status", F.lit(None).cast("string")) if looks is None else asked.join(looks.select("batch", "status"), "batch", "left").select("id", "batch", "status")

    def confidences(self, spark: SparkSession, kind: str = "general") -> DataFrame:
        """(id, confidence) of every reply, from the first token's log probabilities."""
        x = F.from_json("body", REPLY)["choices"][0]["logprobs"]["content"][0]["top_logprobs"]
        rows = self._read(spark, "replies").select("id", F.explode_outer(x).alias("t")).select("id", F.coalesce("t.token", F.lit("")).alias("token"), F.coalesce("t.logprob", F.lit(0.0)).alias("logprob"))
        return first_token_confidence(rows, "id", kind)

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        kinds = {"requests": "batch bigint, id string, value string", "batches": "batch bigint, remote string", "looks": "batch bigint, status string, output string, errors string, at double", "replies": "batch bigint, id string, body string"}
        return spark.read.schema(kinds[name]).parquet(f"{self.folder}/{name}")
