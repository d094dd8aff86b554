from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from demandspark.llm import prefixtrie, radix

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            md5 = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, md5, role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append((c, len(seq)))
    out = []
    for node, in_it in members.items():
        under = [k for k in members if k[: len(node)] == node]
        kids = lambda k: sum(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in under if k)
        ends = ",".join(str(c) for c in sorted(c for c, n in in_it if n == len(node)))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in in_it), len(node), parent, len(in_it), kids(node), sum(not kids(k) for k in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as id", "2 as conv", "3 as pos").repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefixtrie.conversation_trie(df, **more).collect()), key=str)


def conversations(n, seed):
    rng, rows = random.Random(seed), []
    texts = ["", "é" * 5, "yes", "no", "tell me more", None]
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 4, 12])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user", rng.choice(texts[: rng.choice([2, 6])])))
    return rows


@pytest.mark.parametrize("size", [prefixtrie.PIECE, 2])
def test_nodes_against_all_prefixes(spark, monkeypatch, size):
    rows = conversations(40, 3)
    # Copies of one conversation, equal turn numbers, repeated rows, a long one, no id, negative and distant ids.
    rows += [(c, t, "user", f"same {t}") for c in range(100, 112) for t in range(3)] + [(200, 1, "a", "x"), (200, 1, "a", "x"), (200, 1, "b", "y")]
    rows += [(300, t, "user", str(t % 3)) for t in range(25)] + [(None, 1, "user", "lost"), (-7, 0, "user", "yes"), (10**12, 0, "user", "yes")]
    assert run(spark, rows, size=size) == brute(rows)


def test_ends_of_many_ranges_are_one_stream(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "RANGE", 4)
    rows = [(c, 0, "user", "same") for c in range(0, 60)]
    assert run(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert run(spark, []) == [] and run(spark, [(None, None, None, None)]) == []


def test_layouts_grow_and_keep_all_keys():
    tree, rng = radix.Tree(), random.Random(1)
    keys = {bytes([b, rng.randrange(256)]) + b"common" * rng.randrange(3) for b in range(256)} | {b"", b"\x01", b"\x01\x02\x03"}
    seen = set()
    for k in rng.sample(sorted(keys), len(keys)):
        tree.at(k).value = k
        seen.add(tree.root.layout)
    assert seen == {4, 16, 48, 256}
    walk = tree.walk()
    assert {n.value for n, _, _ in walk if n.value is not None} == keys
    assert all(n.value in (None, key) and (up < 0 or key.startswith(walk[up][1])) for n, key, up in walk)
    assert all(tree.at(k).value == k for k in keys)
