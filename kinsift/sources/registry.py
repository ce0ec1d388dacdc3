"""Registries on the driver: sources, adapters, presets, and what a catalogue knows of data sets."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

_SECRET = ("password", "token", "secret", "api_key", "apikey", "credential")


@dataclass(frozen=True)
class DatasetEntry:
    name: str
    task_type: str = "plagiarism"
    dataset_kind: str = "pair"
    languages: tuple[str, ...] = ()
    license: str = ""
    source_url: str = ""
    notes: str = ""
    source: str = "local"
    identifier: str = ""
    adapter: str = ""
    retrieval_adapter: str = ""
    task_families: tuple[str, ...] = ("pair",)


@dataclass
class Registry:
    """Named callables or entries; names are unique unless replaced on purpose."""

    kind: str
    entries: dict = field(default_factory=dict)

    def add(self, name: str, value, replace: bool = False) -> None:
        key = name.strip().lower()
        if not key:
            raise ValueError(f"a {self.kind} needs a name")
        if key in self.entries and not replace:
            raise ValueError(f"{self.kind} {name} is registered already")
        self.entries[key] = value

    def get(self, name: str):
        try:
            return self.entries[name.strip().lower()]
        except KeyError:
            raise ValueError(f"unknown {self.kind}: {name}; known: {', '.join(sorted(self.entries))}") from None

    def names(self) -> list[str]:
        return sorted(self.entries)


def _local(location: str, **_: object) -> str:
    if not Path(location).exists():
        raise FileNotFoundError(location)
    return location


def _remote(name: str) -> Callable[..., str]:
    def resolve(location: str, **_: object) -> str:
        raise ConnectionError(f"source {name} needs a network to fetch {location}")

    return resolve


def resolve_source(name: str, location: str, **options) -> str:
    """The local path of a source; of the options, the resolver gets those its signature takes."""
    resolver = SOURCES.get(name)
    names = inspect.signature(resolver).parameters
    every = any(p.kind is p.VAR_KEYWORD for p in names.values())
    return resolver(location, **{k: v for k, v in options.items() if every or k in names})


SOURCES = Registry("source", {"local": _local, **{n: _remote(n) for n in ("github", "zenodo", "huggingface", "kaggle")}})
ADAPTERS = Registry("adapter")
# Public data sets, where they are and which adapter reads them.
DATASETS = Registry("data set", {e.name: e for e in (
    DatasetEntry("soco14", dataset_kind="retrieval", source="zenodo", identifier="7433031", source_url="https://zenodo.org/records/7433031", retrieval_adapter="soco14_retrieval", task_families=("retrieval",)),
    DatasetEntry("irplag", source="github", identifier="oscarkarnalim/sourcecodeplagiarismdataset", source_url="https://github.com/oscarkarnalim/sourcecodeplagiarismdataset", adapter="irplag_pair", retrieval_adapter="irplag_retrieval", task_families=("pair", "retrieval")),
    DatasetEntry("conplag", source="zenodo", identifier="7332790", source_url="https://zenodo.org/records/7332790", adapter="conplag_pair"),
    DatasetEntry("ipca", source="github", identifier="humsha/IPCA", source_url="https://github.com/humsha/IPCA", adapter="ipca_pair"),
    DatasetEntry("student_code_similarity", source="kaggle", identifier="ehsankhani/student-code-similarity-and-plagiarism-labels", source_url="https://www.kaggle.com/datasets/ehsankhani/student-code-similarity-and-plagiarism-labels", adapter="student_code_similarity_pair"),
    DatasetEntry("criminal_minds", source="zenodo", identifier="19115559", source_url="https://zenodo.org/records/19115559", adapter="criminal_minds_pair"),
)})


def catalogue(task_type: str | None = None, dataset_kind: str | None = None) -> list[DatasetEntry]:
    return [e for _, e in sorted(DATASETS.entries.items()) if (task_type is None or e.task_type == task_type) and (dataset_kind is None or e.dataset_kind == dataset_kind)]


def load_manifest(path: str) -> list[dict]:
    """Data set specifications of a JSON or YAML manifest: one (`dataset`), several (`datasets`) or the object
    itself; relative paths start at the manifest. Keys that look like credentials are an error at any depth."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a manifest is an object")
    if int(value.get("version", 1)) != 1:
        raise ValueError("manifests have version 1")
    _reject_secrets(value)
    specs = value["datasets"] if "datasets" in value else [value["dataset"]] if "dataset" in value else [value]
    base = Path(path).resolve().parent
    out = []
    for spec in specs:
        if not isinstance(spec, dict) or not (spec.get("path") or spec.get("identifier") or spec.get("preset")):
            raise ValueError("a data set of a manifest needs a path, an identifier or a preset")
        own = dict(spec)
        if own.get("source", "local") == "local" and "path" in own and not Path(own["path"]).is_absolute():
            own["path"] = str(base / own["path"])
        if own.get("adapter") and not own.get("adapted_destination"):
            raise ValueError("an adapter needs adapted_destination")
        if own.get("source", "local") != "local" and not own.get("destination"):
            raise ValueError("a remote source needs destination")
        out.append(own)
    return out


def _reject_secrets(value: object) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            if any(s in str(k).lower() for s in _SECRET):
                raise ValueError(f"manifests must not hold credentials: {k}")
            _reject_secrets(v)
    elif isinstance(value, list):
        for v in value:
            _reject_secrets(v)
