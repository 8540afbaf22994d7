"""Settings of the toxicity machine by cross-validation: python -m maskwright.llm.tune_toxicity DIR...

Only rows that ``op8_toxicity`` may learn from (crc32 of doc_id modulo 5 is not 0) are read; held-out rows never are.
They are dealt into folds by another hash; each setting is fitted without a fold and judged on it.  For every setting
the script prints the summed errors of the folds, with the factors and with them set to 0.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from multiprocessing import Pool

import numpy as np
import pyarrow.dataset as ds

from . import toxicity

FOLDS = 4
GRID = {"SCREEN": (4.5, 6.0), "RATE": (0.3, 1.0), "L1_LINEAR": (0.0, 0.02), "L1_FACTORS": (0.0, 0.005), "TOXIC_WEIGHT": (1.0, 2.0), "START": (0.003, 0.05)}


def allowed(folder: str) -> list[tuple[int, np.ndarray, int]]:
    """(doc_id, terms, label) of labelled rows that may be learned from, SAMPLE_DOCS at most."""
    labels = ds.dataset(f"{folder}/labels.parquet").to_table(["doc_id", "toxic"])
    known = {i: y for i, y in zip(*(labels.column(c).to_pylist() for c in ("doc_id", "toxic")), strict=True) if y in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    chosen = sorted(known, key=lambda i: zlib.crc32(f"sample {i}".encode()))[: toxicity.SAMPLE_DOCS]
    rows = ds.dataset(f"{folder}/documents.parquet").to_table(["doc_id", "text"], filter=ds.field("doc_id").isin(chosen))
    terms = toxicity.Terms()
    return [(i, terms.of([t or ""])[1], known[i]) for i, t in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text")), strict=True)]


def judged(job: tuple) -> tuple:
    """Errors of one setting on one fold: (setting, [missed, false alarms, log loss] with and without factors)."""
    setting, rows, fold = job
    for name, value in setting:
        setattr(toxicity, name, value)
    own = [zlib.crc32(f"fold {i}".encode()) % FOLDS == fold for i, _, _ in rows]
    model = toxicity.fit([(x, y) for (_, x, y), out in zip(rows, own, strict=True) if not out])
    out = []
    for factors in (1, 0):
        kept = model | {"V": model["V"] * factors}
        for (_, x, y), here in zip(rows, own, strict=True):
            if here:
                ids = x[model["active"][x]]
                z = toxicity.logits(kept, 1, np.zeros(len(ids), int), ids)[0][0]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                out.append((factors, y == 1 and p < toxicity.THRESHOLD, y == 0 and p >= toxicity.THRESHOLD, -np.log(max(p if y else 1 - p, 1e-9))))
    return setting, out


def main() -> None:
    for folder in sys.argv[1:]:
        rows = allowed(folder)
        settings = [tuple(zip(GRID, values, strict=True)) for values in itertools.product(*GRID.values())]
        with Pool() as pool:
            found = pool.map(judged, [(s, rows, f) for s in settings for f in range(FOLDS)], 1)
        print(folder, len(rows), "rows,", sum(y for _, _, y in rows), "toxic")
        lines = []
        for setting in settings:
            both = [x for s, out in found if s == setting for x in out]
            sums = {f: [sum(x[k] for x in both if x[0] == f) for k in (1, 2, 3)] for f in (1, 0)}
            lines.append((sums[1][0] + sums[1][1], dict(setting), sums))
        for errors, setting, sums in sorted(lines, key=lambda x: (x[0], x[2][1][2])):
            print(f"errors {errors}: missed {sums[1][0]}, false {sums[1][1]}, loss {sums[1][2]:.0f}; without factors missed {sums[0][0]}, false {sums[0][1]}, loss {sums[0][2]:.0f}; {setting}")


if __name__ == "__main__":
    main()
