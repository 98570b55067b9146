"""The prefix trie of conversations, held to a dictionary of all prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from barlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def all_nodes(conversations):
    members, children, out = defaultdict(list), defaultdict(list), {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        below = [out[c] for c in children[node]]
        n, size = len(members[node]), len(node[-1][1].encode()) if node else 0
        ends = sorted(c for c in members[node] if len(conversations[c]) == len(node))
        out[node] = (
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, n, len(below), sum(b[5] for b in below) or 1, sum(b[6] for b in below) + (n - 1) * size,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return sorted(out.values())


def ordered(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in found.items()}


def rebuilt(conversations):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in conversations}
    return {c: conversations.get(c - int(math.fmod(c, 5)), [])[: h[c]] + turns[h[c] :] for c, turns in conversations.items()}


def some(chance, n, most, texts):
    return [(c, t, chance.choice("ua"), chance.choice(texts)) for c in range(n) if chance.random() < 0.9 for t in range(chance.randint(1, most))]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("sizes", [trie.Sizes(), trie.Sizes(3, 7, 200)])
def test_rebuilt_conversations_against_all_prefixes(spark, sizes):
    rows = some(random.Random(2), 70, 14, "xäö")
    got = rows_of(trie.report(spark.createDataFrame(rows, SCHEMA).repartition(4), sizes))
    assert got == all_nodes(rebuilt(ordered(rows)))


def test_hot_conversations_odd_rows_and_long_ones(spark):
    """Equal conversations go to several ranges; nulls, rows without an id, ids under zero, long conversations that
    share a prefix and one that is alone; a turn of no conversation but its base, and one that is left turnless."""
    rows = [(c, t, "u", "x") for c in range(400) for t in range(3)] + [(c, t, "u", "x") for c, n in ((1000, 90), (1001, 70), (1500, 300)) for t in range(n)]
    rows += [(None, 1, "a", "b"), (7, None, "z", None), (-3, 1, None, "q"), (-5, 1, "u", "x"), (2003, 0, None, None)]
    frame = spark.createDataFrame([(*r, "extra", 0) for r in rows], SCHEMA + ", conv string, depth int").repartition(5)
    assert rows_of(trie.report(frame, trie.Sizes(8, 50, 2000))) == all_nodes(rebuilt(ordered(rows)))


def test_prefix_trie_of_conversations_as_they_are(spark):
    rows = some(random.Random(4), 40, 6, "ab") + [(5, 9, "u", "q"), (5, 9, "u", "q")]
    frame = spark.createDataFrame(rows, "key long, n long, who string, said string")
    assert rows_of(trie.prefix_trie(frame, "key", "n", "who", "said")) == all_nodes(ordered(rows))
    assert trie.prefix_trie(frame.limit(0), "key", "n", "who", "said").count() == 0


def test_the_tree_of_losers_merges_and_knows_what_is_shared():
    chance = random.Random(6)
    for _ in range(200):
        entries = [(b"".join(bytes([chance.randrange(2)]) * trie.UNIT for _ in range(chance.randint(0, 6))), c) for c in range(chance.randint(1, 30))]
        runs = [[] for _ in range(chance.randint(1, 5))]
        for e in sorted(entries):
            chance.choice(runs).append(e)
        packed = []
        for run in runs:
            common = [0, *(trie.shared(a[0], b[0], 0) for a, b in zip(run, run[1:], strict=False))]
            packed.append([(key[k * trie.UNIT :], k, c) for (key, c), k in zip(run, common, strict=False)])
        got = [(k, e[0], e[2]) for k, e in trie.merged(packed)]
        assert [g[1:] for g in got] == sorted(entries)
        assert all(k == trie.shared(a[1], b[1], 0) for a, b, k in zip(got, got[1:], [g[0] for g in got[1:]], strict=False))


def test_shared_turns_are_not_compared_again(monkeypatch):
    """Runs that share a long prefix: what the merge compares doesn't grow with the length of the prefix."""
    looked = 0

    def counted(a, b, known):
        nonlocal looked
        out = plain(a, b, known)
        looked += out - known + 1
        return out

    plain = trie.shared
    monkeypatch.setattr(trie, "shared", counted)
    prefix, k, n = b"p" * trie.UNIT * 500, 8, 50
    keys = [[prefix + (r + k * i).to_bytes(trie.UNIT, "big") for i in range(n)] for r in range(k)]
    runs = [[(key if i == 0 else key[-trie.UNIT :], 0 if i == 0 else 500, i) for i, key in enumerate(run)] for run in keys]
    assert len([*trie.merged(runs)]) == k * n
    assert looked < k * 502 + 4 * k * n
