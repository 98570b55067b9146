import hashlib
import random

from llm_odd import ODD
from pyspark.sql import functions as F

from barlens.llm import block_naming, simhash
from barlens.llm.graph import components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected_groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in by.items():
        best = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == best and first
            first = first and not kept
            out.append((i, best, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_of_odd_rows(odd, none):
    got = sorted((tuple(r) for r in block_naming.groups(odd).collect()), key=repr)
    assert got == expected_groups(ODD)
    assert block_naming.groups(none).isEmpty()


def test_blocks_of_any_size_name_texts_exactly(make_docs):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abAé") for _ in range(rnd.choice([0, 1, 3, 4, 5, 8, 9, 17, 40]))) for _ in range(60)]
    rows = [(i, rnd.choice(texts)) for i in range(160)]
    for size in (4, 7):
        got = sorted((tuple(r) for r in block_naming.groups(make_docs(rows), block_bytes=size).collect()), key=repr)
        assert got == expected_groups(rows)


def test_deduplicate(odd, make_docs):
    got = block_naming.deduplicate(odd)
    assert got.columns == odd.columns
    kept = {(i, t) for (i, _, _, k, _), t in ((e, None) for e in expected_groups(ODD)) if k}
    assert sorted(r.doc_id for r in got.filter("doc_id is not null").collect()) == sorted(i for i, _ in kept if i is not None)
    assert got.filter("doc_id is null").count() == 1
    simple = make_docs([(1, "A"), (2, "a"), (3, "b")])
    assert sorted(r.doc_id for r in block_naming.deduplicate(simple).collect()) == [2, 3]


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(frame).collect()}
    want = roots([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(frame.limit(0)).isEmpty()


def bits(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def test_links_against_all_pairs(spark):
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    found = set(base)
    for b in base:
        for _ in range(6):
            for bit in rnd.sample(range(64), rnd.randint(1, 5)):
                b ^= 1 << bit
            found.add(b)
    signed = [f - 2**64 if f >> 63 else f for f in found]
    frame = spark.createDataFrame([(f,) for f in signed], "f bigint")
    for k in (0, 1, 3, 4):
        rows = simhash.links(frame, k).collect()
        want = {(a, b) for a in signed for b in signed if a < b and bits(a, b) <= k}
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_embedding_is_a_lower_bound(spark):
    rnd = random.Random(1)
    pairs = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("d")).collect()
    for r in rows:
        counts = [[bin(x >> 2 * s & 3).count("1") for s in range(32)] for x in (r.a, r.b)]
        assert r.d == sum(abs(p - q) for p, q in zip(*counts, strict=True)) <= bits(r.a, r.b)


def plain_fingerprint(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hash_is_sparks(spark):
    import xxhash

    for t in ("", "a b c", "é ñ ß" * 20):
        signed = spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0]
        assert signed % 2**64 == xxhash.xxh64_intdigest(t.encode(), 42)


def test_groups_against_all_pairs(odd, none, spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(250).collect()]
    for frame, rows in ((odd, ODD), (spark.createDataFrame(docs, "doc_id bigint, text string"), docs)):
        prints = [plain_fingerprint(t) for _, t in rows]
        distinct = sorted(set(prints))
        root = {f: f for f in distinct} | roots([(a, b) for a in distinct for b in distinct if a < b and bits(a, b) <= 3])
        least = {}
        for (i, _), f in zip(rows, prints, strict=True):
            least.setdefault(root[f], []).append(i)
        want = sorted(((i, f"{f:016x}", min((x for x in least[root[f]] if x is not None), default=None)) for (i, _), f in zip(rows, prints, strict=True)), key=repr)
        assert sorted((tuple(r) for r in simhash.groups(frame).collect()), key=repr) == want
    assert simhash.groups(none).isEmpty()


def test_near_deduplicate(odd, make_docs):
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(odd).collect()), key=repr)
    # 1, 2 and 3 have no words; 4 and 5 are equal; 5 twice
    assert [i for i, _ in got if i is not None] == [1, 4, 6, 7, 8, 9] and len(got) == 7
    twice = make_docs([(3, "some words here now"), (3, "some words here now"), (8, "other text it is")])
    assert sorted(r.doc_id for r in simhash.deduplicate(twice).collect()) == [3, 8]


def test_beyond_the_broadcast_bound(make_docs, monkeypatch):
    from barlens.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = [(i, f"text number {i // 2} has some words") for i in range(40)]
    assert sorted(r.doc_id for r in block_naming.deduplicate(make_docs(rows)).collect()) == list(range(1, 40, 2))
    near = [(i, f"the very same text again {'x' if i % 2 else 'X'}") for i in range(20)] + [(50, "another one")]
    assert sorted(r.doc_id for r in simhash.deduplicate(make_docs(near)).collect()) == [0, 50]


def test_clashing_names(make_docs):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "B"), (None, "c"), (3, "d")]
    docs = make_docs(rows).withColumns({c: F.lit(1) for c in ("_id", "_sha", "_sha2", "_id3", "its_id", "ITS_SHA", "own_id", "own_sha", "_own_sha")})
    got = block_naming.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == [(1, "a"), (2, "B"), (3, "d"), (None, "c")]


def test_names_do_not_depend_on_partitions(spark, make_docs):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("abc") for _ in range(rnd.choice([0, 3, 4, 9, 12])))) for i in range(40)]
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            ids = block_naming.identities(make_docs(rows).repartition(n), block_bytes=4)
            found.append(sorted((r.doc_id, r.n_blocks, r.name) for r in ids.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    blocks = {t[a : a + 4] for _, t in rows for a in range(0, max(len(t), 1), 4)}
    assert {name for _, n, name in found[0] if n == 1} <= set(range(len(blocks)))
