"""Learn the rules of document kinds: python -m lodestrand.llm.train_quality DIR_OF_TABLES.

labels.json holds the doc_ids of the labelled documents of the sf0.1 table that are no rulings, by kind, as found by
reading; all others there are rulings.  At most SAMPLE labelled documents are used, half of them to learn, half held out.
Writes learned.py and prints the held-out confusion.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from .quality import FEATURES, Memory, text_statistics
from .rules import classify, induce

SAMPLE = 10_000
ORDER = ("junk", "table", "list")
#: Orders of the kinds and splits into growing and pruning rows that are tried; the fewest errors on the learning half win.
ORDERS, SPLITS = (ORDER, ("table", "junk", "list"), ("table", "list", "junk")), 8


def main(folder: str) -> None:
    here = Path(__file__).parent
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).slice(0, SAMPLE)
    words = pq.read_table(f"{folder}/common_words.parquet", columns=["word"])["word"].to_pylist()
    found = text_statistics(docs["text"].combine_chunks(), Memory(frozenset(w.lower() for w in words)))
    kind_of = {i: k for k, ids in json.loads((here / "labels.json").read_text()).items() for i in ids}
    kinds = np.array([kind_of.get(i, "ruling") for i in docs["doc_id"].to_pylist()], object)
    valid = found["n_words"] > 0
    data = {c: found[c][valid] for c in FEATURES}
    kinds = kinds[valid]
    learn = np.random.default_rng(11).random(len(kinds)) < 0.5
    part = lambda m: {c: v[m] for c, v in data.items()}
    tried = [induce(part(learn), kinds[learn], order, seed=s) for s in range(SPLITS) for order in ORDERS]
    rules = min(tried, key=lambda r: int((classify(r, part(learn), "ruling") != kinds[learn]).sum()))
    got = classify(rules, part(~learn), "ruling")
    for a in (*ORDER, "ruling"):
        print(a, {b: int(((kinds[~learn] == a) & (got == b)).sum()) for b in (*ORDER, "ruling")})
    lines = ['"""Written by train_quality.py: the rules learned on the labelled documents, in order."""\n', "RULES = ("]
    lines += [f"    {rule!r}," for rule in rules]
    (here / "learned.py").write_text("\n".join([*lines, ")"]) + "\n")


if __name__ == "__main__":
    main(sys.argv[1])
