from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import brute_jaccard

from demandspark.llm import jaccard
from demandspark.llm.store import table


def _edited(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("few, common", [(16, 8), (2, 1), (1, 10**9)])
def test_near_copies_against_all_pairs(docs, monkeypatch, few, common):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    rng, rows = random.Random(5), []
    licence = [f"licence{i}" for i in range(30)]
    for group in range(12):
        base = [f"g{group}w{rng.randrange(500)}" for _ in range(rng.choice([4, 30, 120, 200]))] + licence * (group % 2)
        for copy in range(12):
            rows.append((len(rows), _edited(base, min(len(base), rng.choice([0, 0, 1, 2, 3, 5])), rng)))
    rows += [(900, ""), (901, " \n"), (902, "Two  Words"), (903, "two words"), (904, "two words more")]
    got = sorted(r.doc_id for r in jaccard.one_of_each(docs(rows)).collect())
    want, pairs = brute_jaccard(rows)
    assert pairs > 100 and got == want


def test_stage_finds_near_copies_of_the_test_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = jaccard.one_of_each(table(spark, "/root/testdata/sf0.001", "documents"))
    assert sorted(r.doc_id for r in got.collect()) == brute_jaccard(rows)[0]


@pytest.mark.parametrize("block", [16, 300])
def test_bit_sliced_blocks_against_single_comparisons(monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, rows = random.Random(2), []
    for key in range(40):
        base = [rng.getrandbits(64) for _ in range(rng.choice([30, 200, 700]))]
        for _ in range(rng.choice([5, 20, 90])):
            mine = {x if rng.random() > 0.05 else rng.getrandbits(64) for x in base} if rng.random() > 0.3 else {rng.getrandbits(64) for _ in range(rng.choice([1, 2]) * len(base))}
            rows.append((key, sorted(mine), rng.randrange(4)))
    n = np.array([len(h) for _, h, _ in rows])
    sketches = jaccard._sketches(np.concatenate([np.array(h, np.uint64) for _, h, _ in rows]), n).to_pylist()
    items = sorted(((k, 0, 0, side, len(h), i, root, sketches[i]) for side in (True, False) for i, (k, h, root) in enumerate(rows)), key=lambda x: x[0])
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([x[c] for x in items], kind) for c, kind in enumerate(kinds)], list("kijsngrb"))
    found = jaccard._across(batch.slice(x, 500) for x in range(0, batch.num_rows, 500))
    got = {pair for out in found for pair in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}

    def apart(a, b):
        m = min(len(a), len(b)) // 8
        a, b = (jaccard._folded(np.frombuffer(x, "<u8")[None], m)[0] for x in (a, b))
        return int(np.bitwise_count(a ^ b).sum())

    want = {
        (a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
        if rows[a][0] == rows[b][0] and rows[a][2] != rows[b][2] and 5 * min(n[a], n[b]) >= 4 * max(n[a], n[b]) and 9 * apart(sketches[a], sketches[b]) <= n[a] + n[b]
    }
    assert got == want and len(want) > 100
