import json
import os

from kgloom.operators import batches as BA
from kgloom.operators.scoring import BatchEndpoint


def service(root):
    """A batch service on disk: a batch is done at the second look, the one of key -1 fails."""

    def call(method, path, body):
        if path == "/v1/files":
            name = f"f{len(os.listdir(root))}-{os.getpid()}-{hash(body) & 0xFFFF}"
            (root / name).write_bytes(body)
            return {"id": name}
        if path == "/v1/batches":
            name = "b" + body["input_file_id"]
            (root / name).write_text(json.dumps(body))
            return {"id": name}
        if path.startswith("/v1/batches?"):
            return {"data": [{"id": x, "metadata": json.loads((root / x).read_text())["metadata"]} for x in os.listdir(root) if x.startswith("b")], "has_more": False}
        name = path.split("/")[3]
        if path.startswith("/v1/batches/"):
            looked = root / f"look-{name}"
            first = not looked.exists()
            looked.touch()
            key = json.loads((root / name).read_text())["metadata"]["key"]
            return {"status": "in_progress"} if first else {"status": "expired"} if key.endswith("-1") else {"status": "completed", "output_file_id": name[1:]}
        rows = [json.loads(x) for x in (root / name).read_text().splitlines()]
        (root / f"read-{name}-{len(os.listdir(root))}").touch()
        body = lambda p: {"choices": [{"logprobs": {"content": [{"top_logprobs": [{"token": "yes", "logprob": 0.0}, {"token": "no", "logprob": -float(p)}]}]}}]}
        return "\n".join(json.dumps({"custom_id": r["custom_id"], "response": {"body": body(r["body"]["messages"][0]["content"])}}) for r in rows)

    return call


def count(root, start):
    return sum(x.startswith(start) for x in os.listdir(root))


def test_steps_resume_without_sending_again(spark, tmp_path):
    root = tmp_path / "service"
    root.mkdir()
    prompts = spark.createDataFrame([(f"r{i}", str(i % 5)) for i in range(40)], "id string, prompt string")
    job = BA.BatchRun(BatchEndpoint(service(root), wait=0), "m", f"file://{tmp_path}/run", size=10)
    job.submit(prompts)
    sent = count(root, "b")
    assert sent == 4
    job.submit(prompts)
    (tmp_path / "run/batches/_SUCCESS").unlink()  # as if the submission had died before its table was complete
    job.submit(prompts)
    assert count(root, "b") == sent
    assert job.look(spark) == {"in_progress": 4}
    job.fetch(spark)
    assert job.unanswered(spark).count() == 40
    assert job.look(spark) == {"completed": 3, "expired": 1}
    job.fetch(spark)
    read = count(root, "read")
    job.fetch(spark)
    job.run(prompts)  # nothing is left to do
    assert count(root, "read") == read == 3 and count(root, "b") == sent
    left = job.unanswered(spark).collect()
    got = {r.id: r.confidence for r in job.confidences(spark).collect()}
    assert {r.status for r in left} == {"expired"} and len(got) + len(left) == 40 and not {r.id for r in left} & set(got)
    import math

    assert all(abs(c - 1 / (1 + math.exp(-(int(i[1:]) % 5)))) < 1e-9 for i, c in got.items())
