"""Held-out accuracy of the markup classifier by features, and its tree: python tests/llm/heldout_markup.py.

Thirds of the labelled fields are held out in turn; all their blocks count.
"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

from lexifold.llm import markup as M  # noqa: E402
from lexifold.llm import tree  # noqa: E402

N = len(M.FEATURES)
NAMES = [f"{where}{f}" for where in ("", "previous ", "next ") for f in M.FEATURES] + [f"field's {f} density" for f in M.FAMILIES]
SETS = {
    "words and link density of the block and its neighbours": [k for k in range(3 * N) if k % N < 2],
    "and densities by family": list(range(len(NAMES))),
}


def shown(node, indent=0):
    if isinstance(node, str):
        print("  " * indent + node)
        return
    feature, at, left, right = node
    print("  " * indent + f"{NAMES[feature]} <= {at:.4f}")
    shown(left, indent + 1), shown(right, indent + 1)


for name, columns in SETS.items():
    right = marked = n = 0
    cut = lambda rows: [[r[c] for c in columns] for r in rows]  # noqa: B023, E731
    for part in (1, 2, 3):
        rows, labels, _ = M.labelled_rows(part)
        fitted = tree.fit(cut(rows), labels, depth=12)
        rows, labels, _ = M.labelled_rows(-part)
        got = [tree.classify(fitted, r) for r in cut(rows)]
        right += sum(a == b for a, b in zip(got, labels))
        marked += sum((a == "plain") == (b == "plain") for a, b in zip(got, labels))
        n += len(rows)
    print(f"{name}: {right / n:.3f} of {n} held-out blocks by family, {marked / n:.3f} as marked or plain")
shown(M.classifier())
