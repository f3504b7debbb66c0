"""How the settings of the toxicity model are chosen: by folds of the teaching rows.

``python -m quillspark.llm.toxicity_settings DIR...`` prints, for each setting, the
mean of the tables' F1 at score 0.5. A teaching row's fold is crc32(doc_id) mod 5,
1 to 4; each fold is scored by a model of the other three. Held-out rows (0) are
read by no step of the choice. Rows whose features a model has seen are left out
of its figures, so that copies don't count.
"""

from __future__ import annotations

import sys
import zlib
from concurrent.futures import ProcessPoolExecutor
from itertools import product
from multiprocessing import get_context

import numpy as np
import pyarrow.parquet as pq

from .toxicity import POSITIVES, UNLABELLED, features, train

#: The settings in use are the best of those of 16 to 48 texts, 300 and 600 steps and a
#: decay of 1e-4 to 1e-3 that were compared. Words and first letters as features were
#: chosen before, over character 5-grams, in the same way.
GRID = {"least_texts": (16, 24, 32, 48), "steps": (300, 600), "decay": (1e-4, 3e-4, 6e-4, 1e-3)}
#: (fold, toxic, features) of a labelled row.
Row = tuple[int, int, np.ndarray]


def labelled(sf_dir: str) -> list[Row]:
    """The labelled rows of a table that fits one machine."""
    labels = pq.read_table(f"{sf_dir}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()
    toxic = {r["doc_id"]: r["toxic"] for r in labels if r["doc_id"] is not None and r["toxic"] is not None}
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    found = zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True)
    return [(zlib.crc32(str(i).encode()) % 5, toxic[i], features(t)) for i, t in found if i in toxic]


def counts(teach: list[Row], judge: list[Row], **settings: float) -> tuple[int, int, int]:
    """True positives, false positives and missed rows among ``judge``, copies left out."""
    rng = np.random.default_rng(5)
    positive = [x for _, t, x in teach if t]
    prior = len(positive) / len(teach)
    positive = [positive[i] for i in rng.permutation(len(positive))[:POSITIVES]]
    unlabelled = [teach[i][2] for i in rng.permutation(len(teach))[:UNLABELLED]]
    weights, bias = train(positive, unlabelled, prior, **settings)
    seen = {x.tobytes() for _, _, x in teach}
    new = [(t, float(weights[x].sum(dtype=np.float64)) + bias >= 0) for _, t, x in judge if x.tobytes() not in seen]
    return sum(t and p for t, p in new), sum(p and not t for t, p in new), sum(t and not p for t, p in new)


def _fold(task: tuple[str, int, dict]) -> tuple[int, int, int]:
    sf_dir, fold, settings = task
    rows = _tables[sf_dir]
    return counts([r for r in rows if r[0] != fold], [r for r in rows if r[0] == fold], **settings)


_tables: dict[str, list[Row]] = {}


def main(dirs: list[str]) -> None:
    _tables.update({d: [r for r in labelled(d) if r[0]] for d in dirs})
    settings = [dict(zip(GRID, v, strict=True)) for v in product(*GRID.values())]
    tasks = [(d, fold, s) for s in settings for d in dirs for fold in range(1, 5)]
    with ProcessPoolExecutor(mp_context=get_context("fork")) as pool:
        done = dict(zip([(d, f, *s.values()) for d, f, s in tasks], pool.map(_fold, tasks), strict=True))
    for s in settings:
        f1 = []
        for d in dirs:
            hit, wrong, missed = np.sum([done[d, f, *s.values()] for f in range(1, 5)], axis=0)
            f1.append(2 * hit / max(1, 2 * hit + wrong + missed))
        print(f"{np.mean(f1):.4f}", s, [f"{x:.4f}" for x in f1])


if __name__ == "__main__":
    main(sys.argv[1:])
