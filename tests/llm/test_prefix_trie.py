"""The prefix trie against a plain version, on the table and on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from codewave.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, c int, path string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def token(role, text):
    told = "%016X%s%s" % (len(role.encode()), role, text)
    return hashlib.sha256(told.encode()).digest()[:16] + len(text.encode()).to_bytes(8, "big")


def brute(rows, share=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, token(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if share else 0
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]  # % as in SQL
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [u for u in members if u[: len(node)] == node]
        children = [u for u in below if len(u) == len(node) + 1]
        leaves = [u for u in below if not any(len(w) == len(u) + 1 and w[: len(u)] == u for w in below)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in below if u)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op12_prefix_trie"](spark, SF)) == brute(rows)


def awkward():
    random.seed(5)
    rows = []
    for c in range(120):  # many equal beginnings, and copies of whole conversations
        for t in range(random.choice([0, 1, 2, 5, 9, 12])):
            rows.append((c, t, random.choice(["user", None]), random.choice(["", "hola ñ", None, "x" * 30])))
    rows += [(c, t, "user", "the same") for c in range(200, 320) for t in range(3)]
    rows += [(7, None, "user", "before all"), (8, 1, "a", "tie"), (8, 1, "b", "tie"), (8, 1, "b", "tie")]
    rows += [(None, 0, "user", "no conversation"), (-3, 0, "user", "below zero"), (10**15, 0, None, None)]
    rows += [(c, t, "user", f"turn {t}") for c in (400, 405, 410) for t in range(150 + c % 7)]  # several bands
    return rows


@pytest.mark.parametrize("shard_turns", [1 << 16, 40])
def test_awkward_rows(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK_BITS", 4)
    rows = awkward()
    clashing = [(*r, 1, "p", 2) for r in rows]
    assert found(prefix_trie.build_trie(spark.createDataFrame(clashing, SCHEMA))) == brute(rows)


def test_without_shared_beginnings(spark):
    rows = awkward()[:200]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefix_trie.build_trie(df, share=False)) == brute(rows, share=False)


def test_turnless_conversations_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.build_trie(spark.createDataFrame([], schema)).count() == 0
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(c, 0, "user", "replaced by a head that is absent")]
    assert found(prefix_trie.build_trie(spark.createDataFrame(rows, schema))) == brute(rows)
    assert brute(rows)[0][1] == 0
