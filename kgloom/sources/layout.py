"""Datasets on disk: track folders, ZIP archives, parameter files, run descriptions."""

from __future__ import annotations

import json
import logging
import os
import shutil
import urllib.request
import xml.etree.ElementTree as ET
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kgloom.model import RDF, TRIPLES

log = logging.getLogger(__name__)

# Sub-datasets of the subsumption benchmark and the files each must have.
DATASETS = ("g1-web", "g2-diseases", "g3-text", "g5-groceries", "g6-finance", "g7-literature", "gpc-unspsc", "etim-eclass", "eclass-gpc", "mouse-human")
FILES = ("source.rdf", "target.rdf", "reference.rdf")


def read_parameters(path: str | None) -> dict:
    """A JSON object, whatever the file is called. Missing or unreadable gives {}, and what is no
    object comes as {"value": ...}."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, TypeError, ValueError):
        return {}
    return got if isinstance(got, dict) else {"value": got}


def testcases(track: str) -> dict[str, tuple[str, str]]:
    """name -> (source path, target path) of every subfolder, in order."""
    return {e.name: (f"{e.path}/source.rdf", f"{e.path}/target.rdf") for e in sorted(os.scandir(track), key=lambda e: e.name) if e.is_dir()}


_JUNK = ("__MACOSX/", ".DS_Store")


def extract(archive: str, cache: str, force: bool = False) -> Path:
    """Unpacks an archive once into a folder; ``force`` begins anew. System files are left out, and
    so are members that would land outside."""
    out = Path(cache)
    if force and out.exists():
        shutil.rmtree(out)
    if out.exists() and any(out.iterdir()):
        return out
    out.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        for m in z.infolist():
            name = m.filename
            if name.startswith(_JUNK[0]) or f"/{_JUNK[0]}" in name or os.path.basename(name) == _JUNK[1] or os.path.basename(name).startswith("._"):
                continue
            if not (out / name).resolve().is_relative_to(out.resolve()):
                raise ValueError(f"{name} lies outside the archive's folder")
            z.extract(m, out)
    return out


def validate(root: str | Path) -> list[str]:
    """Warnings about unexpected sub-datasets and missing files; without benchmark/ it raises."""
    top = Path(root) / "benchmark"
    if not top.is_dir():
        raise FileNotFoundError(f"{top} is missing")
    said = []
    for d in sorted(x for x in top.iterdir() if x.is_dir()):
        if d.name not in DATASETS:
            said.append(f"unexpected sub-dataset {d.name}")
        said += [f"{d.name} lacks {f}" for f in FILES if not (d / f).is_file()]
    for x in said:
        log.warning(x)
    return said


def sub_datasets(root: str | Path) -> list[str]:
    return sorted(x.name for x in (Path(root) / "benchmark").iterdir() if x.is_dir())


def sub_dataset(root: str | Path, name: str) -> tuple[str, str, str]:
    """Paths of source, target and reference. Unknown names raise ValueError, missing files FileNotFoundError."""
    d = Path(root) / "benchmark" / name
    if not d.is_dir():
        raise ValueError(f"unknown sub-dataset {name!r}, not one of {sub_datasets(root)}")
    if name not in DATASETS:
        log.warning("%s is none of the known sub-datasets", name)
    missing = [f for f in FILES if not (d / f).is_file()]
    if missing:
        raise FileNotFoundError(f"{name} lacks {', '.join(missing)}")
    return tuple(str(d / f) for f in FILES)


def _get(url: str, to: str | None = None, timeout: float = 60.0) -> bytes | None:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            data = r.read()
    except OSError as e:
        log.warning("%s: %s", url, e)
        return None
    if to:
        Path(to).parent.mkdir(parents=True, exist_ok=True)
        Path(to).write_bytes(data)
    return data


def suite_cases(spark: SparkSession, suite: DataFrame, has_item: str, name: str) -> list[tuple[str, str]]:
    """(name, item) of a suite's triples: two patterns joined, by name."""
    from kgloom.plans.sparql import compile_query

    q = f"SELECT ?name ?item WHERE {{ ?suite <{has_item}> ?item . ?item <{name}> ?name }} ORDER BY ?name"
    return [(r["name"], r["item"]) for r in compile_query(q, suite)[1].collect()]


def download_track(base: str, names: list[str], cache: str, parts: tuple = ("source", "target", "reference", "parameters"), get=_get) -> list[str]:
    """Fetches base/name/part for every testcase; one without source or target is skipped, other
    parts are optional. What is there already isn't fetched again. Returns the names kept."""
    kept = []
    for n in names:
        folder = Path(cache) / n
        have = {p: (folder / f"{p}.rdf").exists() or get(f"{base}/{n}/component/{p}", str(folder / f"{p}.rdf")) is not None for p in parts}
        if have.get("source") and have.get("target"):
            kept.append(n)
        else:
            shutil.rmtree(folder, ignore_errors=True)
    return kept


# Predicates of a suite's description, and the components of a testcase.
SUITE_ITEM, SUITE_NAME = "http://www.seals-project.eu/ontologies/SEALSMetadata.owl#hasSuiteItem", "http://purl.org/dc/terms/identifier"
COMPONENTS = ("source", "target", "reference", "input", "parameters", "evaluationexclusion")


def download_suite(spark: SparkSession, suite_url: str, cache: str, get=_get) -> list[str]:
    """Fetches a suite's description, then its testcases with all components, into a track folder that
    is empty or missing; one that holds files is left alone. Returns the names of its testcases."""
    from urllib.parse import quote

    from kgloom.sources.rdf import parse_rdfxml

    folder = Path(cache)
    if folder.is_dir() and any(folder.iterdir()):
        return sorted(testcases(cache))
    base = suite_url.rstrip("/")
    data = get(base + "/", None)
    if data is None:
        raise FileNotFoundError(f"no suite at {suite_url}")
    rows = [(base, *t) for t in parse_rdfxml(data, base + "/")]
    names = [n for n, _ in suite_cases(spark, spark.createDataFrame(rows, TRIPLES), SUITE_ITEM, SUITE_NAME)]
    return download_track(base, names, cache, COMPONENTS, lambda url, to: get("/".join(quote(x) if i > 2 else x for i, x in enumerate(url.split("/"))) + "/", to))


def rdf_root(path: str) -> bool:
    """Whether a file is RDF/XML."""
    for _, e in ET.iterparse(path, ("start",)):
        return e.tag == "{" + RDF + "}RDF"
    return False
