"""Testcases and runs: load two graphs and a gold alignment, match, score, write."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kgloom.model import ALIGNMENT
from kgloom.operators import ranking as R
from kgloom.operators.settle import settled
from kgloom.sinks import tables
from kgloom.sinks.tracking import Tracker, tracked
from kgloom.sources.alignment_xml import read_alignment, write_alignment
from kgloom.sources.layout import read_parameters, testcases
from kgloom.sources.rdf import read_graph


@dataclass
class TestCase:
    """Two graphs, an input alignment and a gold one, with where they came from."""

    __test__ = False  # no test class, whatever its name says

    source: DataFrame
    target: DataFrame
    input_alignment: DataFrame
    reference: DataFrame | None
    paths: dict
    name: str = ""
    track: str = ""
    runtime_ns: int = 0
    system: str = ""


def load(spark: SparkSession, source: str, target: str, reference: str | None = None, name: str = "", track: str = "", alignment: str | None = None) -> TestCase:
    empty = spark.createDataFrame([], ALIGNMENT)
    return TestCase(
        read_graph(spark, source, "source"), read_graph(spark, target, "target"), read_alignment(spark, alignment) if alignment else empty,
        read_alignment(spark, reference) if reference else None, {"source": source, "target": target, "reference": reference, "alignment": alignment}, name, track,
    )


def load_run(spark: SparkSession, path: str) -> TestCase:
    """A testcase from the run_info.json that a run has left."""
    info = json.loads(Path(path).read_text(encoding="utf-8"))
    case = load(spark, info["source_path"], info["target_path"], info.get("reference_path"), info.get("testcase_name", ""), info.get("track_name", ""), info.get("alignment_path"))
    case.runtime_ns, case.system = info.get("runtime_ns", 0), info.get("system_name", "")
    return case


def run_testcase(case: TestCase, matcher, out: str, parameters: dict | None = None) -> dict:
    """Matches, writes alignment, time and run description, scores against gold if there is any.

    The result is persisted before it is written and scored, so that matching happens once."""
    os.makedirs(out, exist_ok=True)
    began = time.time_ns()
    result = matcher.match(case.source, case.target, case.input_alignment, parameters or {}).persist()
    n = result.count()
    ns = time.time_ns() - began
    path = write_alignment(result, f"{out}/systemAlignment.rdf")
    tables.write_performance(f"{out}/performance.csv", ns)
    tables.write_json(
        f"{out}/run_info.json",
        {
            "source_path": case.paths["source"], "target_path": case.paths["target"], "alignment_path": path, "reference_path": case.paths["reference"],
            "testcase_name": case.name, "track_name": case.track, "runtime_ns": ns, "system_name": str(matcher),
        },
    )
    scores = R.precision_recall(result, case.reference).collect()[0].asDict() if case.reference is not None else {}
    result.unpersist()
    return {"matcher": str(matcher), "testcase": case.name, "track": case.track, "size": n, "runtime_ns": ns, **scores}


def run_tracks(spark: SparkSession, matchers: list, tracks: dict[str, str], out: str, only: set[str] | None = None, parameters: dict | None = None) -> list[dict]:
    """Every matcher on every testcase of every track folder; testcases without a reference are
    skipped. Results are appended to results.csv."""
    os.makedirs(out, exist_ok=True)
    got = []
    for matcher in matchers:
        for track, folder in tracks.items():
            for name, (source, target) in testcases(folder).items():
                gold = f"{folder}/{name}/reference.rdf"
                if only is not None and name not in only or not os.path.exists(gold):
                    continue
                case = load(spark, source, target, gold, name, track)
                given = {**read_parameters(f"{folder}/{name}/parameters.rdf"), **(parameters or {})}
                r = run_testcase(case, matcher, f"{out}/{track}/{name}/{matcher}".replace(" ", "_"), given)
                tables.append_result(f"{out}/results.csv", track, name, str(matcher), r, r["runtime_ns"])
                got.append(r)
    return got


def run_on_top(spark: SparkSession, runs: list[str], matchers: list, out: str, chain: bool = False) -> list[dict]:
    """Matchers on the alignments of earlier runs (their run_info.json): each on the original one, or
    with ``chain`` on the result of the matcher before it."""
    got = []
    for path in runs:
        case = load_run(spark, path)
        for i, m in enumerate(matchers):
            to = f"{out}/{case.track}/{case.name}/{case.system}_{i}".replace(" ", "_")
            r = run_testcase(case, m, to)
            if "precision" in r:
                tables.append_result(f"{out}/results.csv", case.track, case.name, f"{case.system} > {m}", r, r["runtime_ns"])
            got.append(r)
            if chain:
                case.input_alignment = read_alignment(spark, f"{to}/systemAlignment.rdf")
    return got


def run_retrieval(case: TestCase, matcher, out: str, top_k: int = 20, variant: str = "asymmetric", config: dict | None = None, smoke: int | None = None,
                  tracker: Tracker | None = None) -> dict:
    """Ranked retrieval: predictions, reference and per-source tables, recall, reciprocal ranks and
    score statistics in metrics.json. A smoke run keeps the predictions of the first ``smoke`` source
    classes alone, and tells of each whether its best targets hold a gold one. A tracker, if there is
    one, gets the configuration, the metrics and the files."""
    given = {"matcher": str(matcher), "top_k": top_k, "variant": variant, "smoke": smoke, **(config or {})}
    with tracked(tracker, f"{case.track}/{case.name}/{matcher}", given) as run:
        metrics = _retrieval(case, matcher, out, top_k, variant, given, smoke)
        flat = {k: v for k, v in metrics.items() if isinstance(v, (int, float))}
        run.log(flat, [f"{out}/{x}" for x in sorted(os.listdir(out))])
    return metrics


def _retrieval(case: TestCase, matcher, out: str, top_k: int, variant: str, given: dict, smoke: int | None) -> dict:
    from kgloom.operators import graph as G

    os.makedirs(out, exist_ok=True)
    began = time.time()
    source = case.source if smoke is None else G.only_classes(case.source, G.first_classes(case.source, smoke))
    predictions = settled(matcher.match(source, case.target, case.input_alignment, {}))
    n = predictions.count()
    seconds = time.time() - began
    labels = [G.one_label(g, G.classes(g)).persist() for g in (case.source, case.target)]
    ks = R.k_values(top_k)
    metrics = {r.metric: r.value for r in R.flat_metrics(R.metrics(predictions, case.reference, ks)).collect()}
    metrics |= R.reference_totals(case.reference).collect()[0].asDict() | {"dropped": {r.relation: r.n for r in R.dropped_relations(case.reference).collect()}}
    metrics |= {"labels_present": R.labels_present(case.reference).collect()[0].labels, "scores": [r.asDict() for r in R.score_diagnostics(predictions, variant).collect()]}
    metrics |= {"predictions": n, "seconds": seconds}
    if smoke is not None:
        metrics["probe"] = {r.source: r.outcome for r in R.probe(predictions, case.reference).collect()}
    tables.write_json(f"{out}/config.json", given)
    tables.write_json(f"{out}/metrics.json", metrics)
    tables.write_tsv(tables.predictions_table(predictions, *labels), f"{out}/predictions.tsv")
    tables.write_tsv(tables.reference_table(case.reference), f"{out}/reference.tsv")
    if n:
        tables.write_tsv(R.per_source(predictions, case.reference, *labels).orderBy("source_uri", "rank"), f"{out}/per_source_long.tsv")
    for x in labels:
        x.unpersist()
    return metrics
