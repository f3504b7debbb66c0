"""Settings of an evaluation, checked as they are read; names of metrics and files."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import MISSING, dataclass, field, fields

#: Names under which metrics are known.
METRIC_NAMES = {
    "auc": "auc", "roc_auc": "auc", "auroc": "auc", "auc_roc": "auc",
    "accuracy": "accuracy", "acc": "accuracy",
    "average_precision": "average_precision", "ap": "average_precision", "auprc": "average_precision", "pr_auc": "average_precision",
    "f1": "f1", "f1_score": "f1",
}


def metric_name(name: str) -> str:
    """The metric's own name; raises ValueError for one that isn't known."""
    key = re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")
    if key not in METRIC_NAMES:
        raise ValueError(f"no metric {name!r}; known are {', '.join(sorted(set(METRIC_NAMES.values())))}")
    return METRIC_NAMES[key]


def metric_names(names: Sequence[str]) -> list[str]:
    """The metrics' own names, each once, in the order of their first mention."""
    return list(dict.fromkeys(map(metric_name, names)))


def safe_name(text: str) -> str:
    """A name for files: letters, digits, dot, minus and underscore; never empty."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("._") or "unnamed"


@dataclass(frozen=True)
class FeatureSet:
    """A set of features: structured columns, embeddings of one type (nlp), or of several (rfg)."""

    name: str
    columns: tuple[str, ...] = ()
    embeddings: Mapping[str, int] = field(default_factory=dict)
    dims: tuple[int, ...] = (-1,)

    @property
    def kind(self) -> str:
        return "structured" if not self.embeddings else "nlp" if len(self.embeddings) == 1 else "rfg"

    def variants(self) -> dict[str, list[str]]:
        """Columns of each variant: the structured ones, then the first components of an embedding.

        Components of an embedding e are named e_0, e_1, …; -1, or more than there
        are, stands for all.
        """
        if not self.embeddings:
            return {"ALL": list(self.columns)}
        out = {}
        for e, size in self.embeddings.items():
            for d in self.dims:
                label = "ALL" if d < 0 or d >= size else str(d)
                key = label if len(self.embeddings) == 1 else f"{e}_{label}"
                out.setdefault(key, [*self.columns, *[f"{e}_{i}" for i in range(size if label == "ALL" else d)]])
        return out


@dataclass(frozen=True)
class Evaluation:
    """What a nested cross-validation is run with; the first three must be given."""

    label: str
    index: str
    models: Mapping[str, Mapping[str, Sequence]]
    iterations: int = 50
    outer: int = 3
    inner: int = 3
    seed: int = 2048
    imputer: str = "median"
    metrics: tuple[str, ...] = ("auc",)
    permutations: int = 10_000


def evaluation(values: Mapping | str) -> Evaluation:
    """Settings from a mapping or JSON text; raises ValueError for missing and for unknown ones."""
    given = json.loads(values) if isinstance(values, str) else dict(values)
    known = {f.name: f for f in fields(Evaluation)}
    missing = [n for n, f in known.items() if f.default is MISSING and n not in given]
    unknown = sorted(set(given) - set(known))
    if missing or unknown:
        raise ValueError(f"missing: {missing}, unknown: {unknown}")
    if "metrics" in given:
        given["metrics"] = tuple(metric_names(given["metrics"]))
    return Evaluation(**given)
