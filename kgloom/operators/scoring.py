"""Yes/no confidence from language models: aggregation of first tokens, scorers, tools.

Model calls sit behind ``mapInArrow``: a scorer loads once per task. Persist what a scorer
returns before reading it twice, as a model need not answer alike again.
"""

from __future__ import annotations

import json
import logging
import math
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import is_negative, is_positive

log = logging.getLogger(__name__)


def first_token_confidence(candidates: DataFrame, id_col: str = "id", kind: str = "general") -> DataFrame:
    """(id, confidence) from rows (id, token, logprob) of a first position.

    The likeliest positive against the likeliest negative token: yes / (yes + no), 0.5 if neither
    occurs. The largest probability counts, not the sum, so spellings don't add up."""
    p = F.exp("logprob")
    best = lambda hit: F.coalesce(F.max(F.when(hit, p)), F.lit(0.0))
    got = candidates.groupBy(id_col).agg(best(is_positive(F.col("token"), kind)).alias("_yes"), best(is_negative(F.col("token"), kind)).alias("_no"))
    return got.select(id_col, F.coalesce(F.try_divide(F.col("_yes"), F.col("_yes") + F.col("_no")), F.lit(0.5)).alias("confidence"))


# Answer words that are encoded where no token of a vocabulary looks like an answer.
ANSWER_WORDS = {
    "general": (("yes", "Yes", "YES", " yes", " Yes", "true", "True", "TRUE"), ("no", "No", "NO", " no", " No", "false", "False", "FALSE")),
    "specific": (("yes", "Yes", " yes", " Yes"), ("no", "No", " no", " No")),
}


def answer_tokens(vocabulary: Iterable[str], kind: str = "general", encode: Callable[[str], list[int]] | None = None) -> tuple[list[int], list[int]]:
    """Positions of the positive and negative tokens of a vocabulary.

    Where none of a kind looks like an answer, the tokens into which ``encode`` turns the answer words
    stand in, in order and once each; without ``encode``, tokens that are an answer word but for the
    marks of a word's beginning. If that finds none, there is no way to score and ValueError says so."""
    import re

    from kgloom.functions.text import _TRUTH

    words = list(vocabulary)
    to_python = lambda p: re.compile(p.replace(r"[^\p{L}]", r"[\W\d_]").replace("(?iU)", "(?i)"))
    out = [[i for i, w in enumerate(words) if to_python(p).search(w)] for p in _TRUTH[kind]]
    for n, answers in enumerate(ANSWER_WORDS[kind]):
        if not out[n]:
            plain = {a.strip().lower() for a in answers}
            if encode is not None:
                out[n] = list(dict.fromkeys(i for a in answers for i in encode(a)))
            else:
                out[n] = [i for i, w in enumerate(words) if w.strip(" Ġ▁").lower() in plain]
            if not out[n]:
                raise ValueError(f"the vocabulary has no {'positive' if n == 0 else 'negative'} answer")
            log.warning("no token looks like an answer; %d stand in for it", len(out[n]))
    return out[0], out[1]


def confidence_of(logprobs: dict[str, float], kind: str = "general") -> float:
    """The same for one position in Python, for scorers that hold all tokens."""
    yes, no = answer_tokens_in(logprobs, kind)
    return yes / (yes + no) if yes + no > 0 else 0.5


def answer_tokens_in(logprobs: dict[str, float], kind: str = "general") -> tuple[float, float]:
    import re

    from kgloom.functions.text import _TRUTH

    best = []
    for p in _TRUTH[kind]:
        pattern = re.compile(p.replace(r"[^\p{L}]", r"[\W\d_]").replace("(?iU)", "(?i)"))
        best.append(max((math.exp(v) for t, v in logprobs.items() if pattern.search(t)), default=0.0))
    return best[0], best[1]


@dataclass
class Scorer:
    """Base: adds ``confidence`` to rows with a ``prompt``. ``load`` runs once per task and returns a
    function from prompts to {token: log probability} of the first position; an error scores 0.5."""

    load: Callable[[], Callable[[list[str]], list[dict[str, float] | None]]]
    kind: str = "general"

    def score(self, rows: DataFrame) -> DataFrame:
        keep = [c for c in rows.columns if c not in ("prompt", "confidence")]
        schema = rows.select(*keep).schema
        kind, load = self.kind, self.load

        def run(batches):
            ask = load()
            for b in batches:
                prompts = [p or "" for p in b.column(b.schema.get_field_index("prompt")).to_pylist()]
                try:
                    answers = ask(prompts)
                except Exception as e:
                    log.warning("scoring failed: %s", e)
                    answers = [None] * len(prompts)
                scores = [0.5 if a is None else confidence_of(a, kind) for a in answers]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(scores, pa.float64())], [*keep, "confidence"])

        return rows.mapInArrow(run, schema.add("confidence", "double"))


def table_scorer(answers: dict[str, float], default: float = 0.5) -> Scorer:
    """A fake model: confidence by the first key that the prompt contains."""

    def load():
        def ask(prompts):
            out = []
            for p in prompts:
                c = min(max(next((v for k, v in answers.items() if k in p), default), 1e-9), 1 - 1e-9)
                out.append({"yes": math.log(c), "no": math.log(1 - c)})
            return out

        return ask

    return Scorer(load)


def http_scorer(url: str, model: str, key: str = "", top: int = 20, timeout: float = 60.0) -> Scorer:
    """A chat-completions endpoint that returns log probabilities of the first token."""

    def load():
        def ask(prompts):
            out = []
            for p in prompts:
                body = {"model": model, "messages": [{"role": "user", "content": p}], "max_tokens": 1, "temperature": 0, "logprobs": True, "top_logprobs": top}
                try:
                    reply = post(url, body, key, timeout)
                    first = reply["choices"][0]["logprobs"]["content"][0]["top_logprobs"]
                    out.append({t["token"]: t["logprob"] for t in reversed(first)})
                except Exception as e:
                    log.warning("request failed: %s", e)
                    out.append(None)
            return out

        return ask

    return Scorer(load)


def post(url: str, body: dict, key: str = "", timeout: float = 60.0) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
        return json.loads(r.read())


def batch_requests(rows: DataFrame, model: str, id_col: str = "id") -> DataFrame:
    """(value) lines of a batch file for a chat endpoint, made on the JVM; write them as text."""
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(1).alias("max_tokens"), F.lit(True).alias("logprobs"), F.lit(20).alias("top_logprobs"))
    line = F.struct(F.col(id_col).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return rows.select(F.to_json(line).alias("value"))


#: States in which a batch will not change any more.
ENDED = ("completed", "failed", "expired", "cancelled")


@dataclass
class BatchEndpoint:
    """Requests sent as one file, answered by and by. ``call(method, path, body)`` reaches the service:
    bytes are uploaded as a file, a dict is sent as JSON, and the reply is a dict, or text for the
    content of a file. ``wait`` seconds lie between two looks at a batch."""

    call: Callable[[str, str, object], object]
    wait: float = 30.0
    window: str = "24h"
    endpoint: str = "/v1/chat/completions"

    def run(self, lines: list[str]) -> dict[str, dict]:
        """Replies by the requests' custom_id. A batch that ends otherwise, or leaves a request without
        an answer, raises RuntimeError with what the service said of it."""
        import time

        sent = self.call("POST", "/v1/files", ("\n".join(lines) + "\n").encode())
        batch = self.call("POST", "/v1/batches", {"input_file_id": sent["id"], "endpoint": self.endpoint, "completion_window": self.window})
        while batch["status"] not in ENDED:
            time.sleep(self.wait)
            batch = self.call("GET", f"/v1/batches/{batch['id']}", None)
        if batch["status"] != "completed":
            raise RuntimeError(f"batch {batch['id']} is {batch['status']}")
        got = {r["custom_id"]: r["response"]["body"] for r in self._rows(batch.get("output_file_id"))}
        missing = [i for i in (json.loads(x)["custom_id"] for x in lines) if i not in got]
        if missing:
            said = {r["custom_id"]: r.get("error") or r.get("response") for r in self._rows(batch.get("error_file_id")) if r["custom_id"] in missing}
            raise RuntimeError(f"batch {batch['id']} has no answer to {missing}: {said}")
        return got

    def _rows(self, file_id: str | None) -> list[dict]:
        text = self.call("GET", f"/v1/files/{file_id}/content", None) if file_id else ""
        return [json.loads(x) for x in text.splitlines() if x.strip()]


def batch_scorer(endpoint: BatchEndpoint, model: str, kind: str = "general", top: int = 20) -> Scorer:
    """A scorer whose prompts go out as one batch an Arrow batch."""

    def load():
        def ask(prompts):
            body = lambda p: {"model": model, "messages": [{"role": "user", "content": p}], "max_tokens": 1, "temperature": 0, "logprobs": True, "top_logprobs": top}
            lines = [json.dumps({"custom_id": f"req-{i}", "method": "POST", "url": endpoint.endpoint, "body": body(p)}) for i, p in enumerate(prompts)]
            got = endpoint.run(lines) if lines else {}
            first = [got[f"req-{i}"]["choices"][0]["logprobs"]["content"][0]["top_logprobs"] for i in range(len(prompts))]
            return [{t["token"]: t["logprob"] for t in reversed(x)} for x in first]

        return ask

    return Scorer(load, kind)


def complete(rows: DataFrame, load: Callable[[], Callable[[list[str], int], list[str]]], max_new_tokens: int = 512) -> DataFrame:
    """Rows with ``completion`` in place of ``prompt``. ``load`` runs once a task and returns a function
    from prompts and a number of tokens to texts; a batch that fails gets null."""
    keep = [c for c in rows.columns if c not in ("prompt", "completion")]

    def run(batches):
        write = load()
        for b in batches:
            prompts = [p or "" for p in b.column(b.schema.get_field_index("prompt")).to_pylist()]
            try:
                texts = write(prompts, max_new_tokens)
            except Exception as e:
                log.warning("completion failed: %s", e)
                texts = [None] * len(prompts)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(texts, pa.string())], [*keep, "completion"])

    return rows.mapInArrow(run, rows.select(*keep).schema.add("completion", "string"))


def http_completions(url: str, model: str, key: str = "", timeout: float = 120.0) -> Callable:
    """What ``complete`` loads for a chat-completions endpoint."""

    def load():
        def write(prompts, most):
            ask = lambda p: post(url, {"model": model, "messages": [{"role": "user", "content": p}], "max_tokens": most, "temperature": 0}, key, timeout)
            return [ask(p)["choices"][0]["message"]["content"] or "" for p in prompts]

        return write

    return load


def local_scorer(path: str, kind: str = "general", options: dict | None = None, most: int | None = None) -> Scorer:
    """A causal model in the task's own process: the softmax over the next token after a prompt, as
    log probabilities of the tokens that look like answers. The model's library is imported in the
    task; where it is missing the scorer raises there, and names it. ``most`` cuts prompts to their
    last so many tokens."""

    def load():
        try:
            import torch
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ImportError as e:
            raise RuntimeError(f"a local model needs {e.name}") from e
        tokenizer = AutoTokenizer.from_pretrained(path)
        model = AutoModelForCausalLM.from_pretrained(path, **(options or {})).eval()
        return next_token_scores(
            lambda p: tokenizer(p)["input_ids"], lambda ids: torch.log_softmax(model(torch.tensor([ids])).logits[0, -1].float(), -1).tolist(),
            tokenizer.convert_ids_to_tokens(range(len(tokenizer))), kind, lambda w: tokenizer.encode(w, add_special_tokens=False), most,
        )

    return Scorer(load, kind)


def next_token_scores(encode: Callable[[str], list[int]], forward: Callable[[list[int]], list[float]], vocabulary: list[str], kind: str = "general",
                      encode_word: Callable[[str], list[int]] | None = None, most: int | None = None) -> Callable[[list[str]], list[dict[str, float]]]:
    """Prompts to the best log probability of a positive and of a negative token, from any model that
    gives log probabilities of all next tokens."""
    yes, no = answer_tokens(vocabulary, kind, encode_word)

    def ask(prompts: list[str]) -> list[dict[str, float]]:
        out = []
        for p in prompts:
            ids = encode(p)
            scores = forward(ids[-most:] if most else ids)
            out.append({"yes": max(scores[i] for i in yes), "no": max(scores[i] for i in no)})
        return out

    return ask


def token_count(messages: list[dict], count: Callable[[str], int], template: Callable[[list[dict]], str] | None = None) -> int:
    """Tokens of a chat: of its rendered template, else 3 per message and 3 for the answer's start."""
    if template is not None:
        return count(template(messages))
    return 3 + sum(3 + sum(count(str(v)) for v in m.values() if v) for m in messages)


def chat_tokens(messages: DataFrame, load: Callable[[], Callable[[list[str]], list[int]]], id_col: str = "id", parts: list[str] | None = None) -> DataFrame:
    """(id, tokens) of chats, a row a message, by the rule of ``token_count``: 3 a message, 3 for the answer's start and
    those of its ``parts``. ``load`` runs once a task and returns a function from texts to their numbers of tokens;
    counts are added up before they move, so a long chat meets in no task."""
    parts = parts or ["role", "content"]

    def run(batches):
        count = load()
        for b in batches:
            total = [3] * b.num_rows
            for c in parts:
                total = [n + m for n, m in zip(total, count([t or "" for t in b.column(c).to_pylist()]))]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(total, pa.int64())], [id_col, "tokens"])

    rows = messages.select(id_col, *[F.col(c).cast("string").alias(c) for c in parts])
    return rows.mapInArrow(run, rows.select(id_col).schema.add("tokens", "long")).groupBy(id_col).agg((F.sum("tokens") + 3).alias("tokens"))


# --- tools --------------------------------------------------------------------------------------


@dataclass
class Tool:
    """A function a model may call. ``parameters`` is a JSON schema; errors come back as text."""

    name: str
    description: str
    parameters: dict
    run: Callable[..., object]

    def schema(self) -> dict:
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": clean_schema(self.parameters)}}

    def invoke(self, arguments: dict) -> str:
        kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
        try:
            props = self.parameters.get("properties", {})
            missing = [k for k in self.parameters.get("required", []) if k not in arguments]
            wrong = [k for k, v in arguments.items() if k in props and not isinstance(v, kinds.get(props[k].get("type"), object))]
            if missing or wrong:
                return "Error: " + ", ".join([f"{k} is missing" for k in missing] + [f"{k} has the wrong type" for k in wrong])
            return str(self.run(**arguments))
        except Exception as e:
            return f"Error: {e}"


def clean_schema(schema: object) -> object:
    """A JSON schema without titles and definitions, its references put in place."""
    defs = schema.get("$defs", {}) if isinstance(schema, dict) else {}

    def walk(x: object, inside: str = "") -> object:
        if isinstance(x, list):
            return [walk(v) for v in x]
        if not isinstance(x, dict):
            return x
        if "$ref" in x and inside != "properties":
            return walk(defs.get(x["$ref"].rsplit("/", 1)[-1], {}))
        return {k: walk(v, k) for k, v in x.items() if inside == "properties" or k not in ("title", "$defs")}

    return walk(schema)


FINAL_QUESTION = "Do the two entities match? Say only yes or no."


@dataclass
class ToolLoop:
    """Conversations with tools, driven from here: each round sends all unfinished ones, appends the
    answers and the tools' results, and a conversation ends with content and no tool call. An empty
    answer is asked again. After at most ``rounds`` the final question gives the confidence."""

    chat: Callable[[list[list[dict]], list[dict]], list[dict]]
    confidence: Callable[[list[list[dict]]], list[float]]
    tools: list[Tool] = field(default_factory=list)
    rounds: int = 10

    def run(self, prompts: list[list[dict]]) -> tuple[list[float], list[list[dict]]]:
        talks = [list(p) for p in prompts]
        by_name = {t.name: t for t in self.tools}
        left = list(range(len(talks)))
        for _ in range(self.rounds):
            if not left:
                break
            replies = self.chat([talks[i] for i in left], [t.schema() for t in self.tools])
            still = []
            for i, reply in zip(left, replies):
                calls = reply.get("tool_calls") or []
                if not calls and not reply.get("content"):
                    still.append(i)
                    continue
                talks[i].append({"role": "assistant", **reply})
                for call in calls:
                    talks[i].append({"role": "tool", "tool_call_id": call.get("id"), "content": self._call(by_name, call)})
                if calls:
                    still.append(i)
            left = still
        for t in talks:
            t.append({"role": "user", "content": FINAL_QUESTION})
        return self.confidence(talks), talks

    @staticmethod
    def _call(by_name: dict[str, Tool], call: dict) -> str:
        f = call.get("function", {})
        tool = by_name.get(f.get("name"))
        if tool is None:
            return f"Error: unknown tool {f.get('name')}"
        try:
            arguments = json.loads(f.get("arguments") or "{}")
        except ValueError as e:
            return f"Error: arguments are no JSON: {e}"
        return tool.invoke(arguments)


def sparql_tool(name: str, triples: DataFrame) -> Tool:
    from kgloom.plans.sparql import query_text

    schema = {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}
    return Tool(name, "Runs a SPARQL query and returns its answer as text.", schema, lambda query: query_text(query, triples))
