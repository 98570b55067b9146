import random
import re

from llm_odd import ODD

from barlens.llm import decontaminate


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = set()
    shingles = {}
    for i, t in items:
        w = words(t)
        k = min(5, len(w))
        if w:
            shingles.setdefault(i, set()).update((k, tuple(w[a : a + k])) for a in range(len(w) - k + 1))
    best = {}
    for d, t in docs:
        w = words(t)
        have = {(k, tuple(w[a : a + k])) for k in range(1, 6) for a in range(len(w) - k + 1)}
        for i, s in shingles.items():
            n = len(s & have)
            if n >= 0.8 * len(s) - 1e-9:
                best[d, i] = max(best.get((d, i), 0), n)
    return {(d, i, n, len(shingles[i])) for (d, i), n in best.items()} | out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id, r.n_found, r.n_shingles) for r in decontaminate.leaks(d, b).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 5, 6, 12, 30])))) for i in range(30)]
    docs = []
    for d in range(120):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.7:
            part = words(rnd.choice(items)[1])
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if part:
                    part[rnd.randrange(len(part))] = "changed"
            cut = rnd.choice([0, 0, 1, 2, 5])
            part = part[cut:]
            at = rnd.randint(0, len(w))
            w[at:at] = part
        docs.append((d, ", ".join(w).upper()))
    docs += [(3, docs[5][1]), (None, items[6][1] + " tail")]
    assert run(spark, docs, items) == brute(docs, items)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    """With a bound of nothing only the bitmap is broadcast, whose size does not depend on the items."""
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i}") for i in range(12)]
    docs = [(i, f"x {items[i % 12][1]} y") for i in range(30)]
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    for bits, row in ((10, 8), (26, 15)):
        monkeypatch.setattr(decontaminate, "BITMAP_BITS", bits)
        monkeypatch.setattr(decontaminate, "ROW_BITS", row)
        assert run(spark, docs, items) == brute(docs, items) and len(brute(docs, items)) == 30


def test_size_of_the_bitmap(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(decontaminate, "BITMAP_BITS", 12)
    monkeypatch.setattr(decontaminate, "ROW_BITS", 9)
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    for n in (10, 5000):
        some = hashes.limit(n)
        rows = {r.bits_row: r.bits for r in decontaminate._bitmap(some).collect()}
        assert len(rows) <= 8 and all(len(b) == 8 for b in rows.values())
        low = {r.h & 4095 for r in some.collect()}
        assert {row * 512 + w * 64 + k for row, b in rows.items() for w in range(8) for k in range(64) if b[w] >> k & 1} == low


def test_partitions_have_sketches_of_their_own(spark):
    """An item of q shingles may miss q - ceil(0.8 q) of them, and has one more in its sketch."""
    import math

    items = [(n, " ".join(f"i{n}w{k}" for k in range(n + 4))) for n in (1, 4, 5, 9, 10, 16, 31)]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    parted = decontaminate.partitions(decontaminate.item_shingles(b))
    got = {(r.item, r.least): r["count"] for r in decontaminate.sketches(parted).groupBy("item", "least").count().collect()}
    for (n, least), m in got.items():
        assert m == n - math.ceil(0.8 * n) + 1 and least <= math.ceil(0.8 * n) + 4


def test_items_of_several_sizes(spark):
    items = [(1, "one two three four five six"), (1, "seven"), (1, "eight"), (1, "nine"), (2, "ten")]
    docs = [(1, "nine eight seven one two"), (2, "one two three four five six"), (3, "five one two three four five seven nine eight"), (4, "ten")]
    assert run(spark, docs, items) == brute(docs, items) and {x[0] for x in brute(docs, items)} == {3, 4}


def test_shingles_of_many_items_make_no_candidates(spark):
    shared = "to be or not to be"
    items = [(i, f"{shared} x{i} y{i} z{i} u{i} v{i} w{i} p{i} q{i} r{i} s{i}") for i in range(40)]
    docs = [(i, f"{shared} and nothing else {i}") for i in range(50)] + [(60, items[3][1])]
    assert run(spark, docs, items) == brute(docs, items) == {(60, 3, 12, 12)}
    b = spark.createDataFrame(items, "item_id bigint, text string")
    sketch = decontaminate.sketches(decontaminate.partitions(decontaminate.item_shingles(b)))
    assert sketch.groupBy("h").count().filter("count > 1").isEmpty()


def test_ids_of_text(spark):
    d = spark.createDataFrame([("a", "one two three four five six"), (None, "one two three four five six"), ("b", "x")], "doc_id string, text string")
    b = spark.createDataFrame([("i", "one two three four five")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == {("a", "i"), (None, "i")}
    assert [r.doc_id for r in decontaminate.clean(d, b).orderBy("doc_id").collect()] == [None, "b"]


def test_edges(spark):
    items = [(1, "one two three four five six seven"), (2, None), (3, "short item"), (1, "eight nine ten eleven twelve")]
    docs = [*ODD, (20, "x One, two; THREE four five six seven y eight nine ten eleven twelve"), (21, "a short item here")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()


def test_items_without_an_id(spark):
    items = [(1, "one two three four five six seven"), (None, "red orange yellow green blue indigo violet"), (None, "north east south west up down left")]
    docs = [(1, f"x {items[1][1]} y"), (2, items[2][1]), (3, "nothing of these"), (4, f"{items[0][1]} {items[2][1]}"), (None, items[1][1])]
    assert run(spark, docs, items) == {(1, None, 3, 3), (2, None, 3, 3), (4, 1, 3, 3), (4, None, 3, 3), (None, None, 3, 3)}
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.leaks(d, b.unionByName(b)).count() == 5
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {3, None}


def test_clean(spark, odd):
    b = spark.createDataFrame([(1, "hello world"), (2, None)], "item_id bigint, text string")
    left = decontaminate.clean(odd, b)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.filter("doc_id is not null").collect()) == [1, 2, 3, 6, 7, 8, 9] and left.filter("doc_id is null").count() == 1
