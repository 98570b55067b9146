"""The Jaccard join, held to a comparison of all pairs."""

import random

import numpy as np
import pytest
from llm_odd import ODD
from pyspark.sql import functions as F

from barlens.llm import jaccard


def expected(rows, words=3, percent=90):
    sets, n = [jaccard.shingles(t, words) for _, t in rows], len(rows)
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            with_id = rows[i][0] is not None and rows[j][0] is not None
            if sets[i] and sets[j] and (sets[i] == sets[j] or with_id and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def near_copies(chance, n, sizes, most_edits, vocabulary=300):
    words = [f"w{k}" for k in range(vocabulary)]
    bases = [[chance.choice(words) for _ in range(chance.choice(sizes))] for _ in range(8)]
    rows = []
    for k in range(n):
        w = list(chance.choice(bases))
        for _ in range(chance.randint(0, most_edits)):
            w[chance.randrange(len(w))] = chance.choice(words)
        rows.append((k * 7 % 1009, " ".join(w) + " more" * chance.choice([0, 0, 1])))
    return rows


@pytest.mark.parametrize(("sizes", "edits"), [([4, 30, 60], 3), ([100, 108, 116], 7)])
def test_near_copies_against_all_pairs(spark, sizes, edits):
    rows = near_copies(random.Random(sizes[0]), 300, sizes, edits)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(jaccard.groups(frame))
    assert got == expected(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_odd_rows(odd, none, spark):
    rows = [*ODD, (20, "a b"), (21, "A  B"), (22, "a b c"), (23, "HELLO world"), (None, "hello world"), (24, " \x0b \x0c ")]
    frame = odd.select("doc_id", "text", "n", "pos", "k1", "e").unionByName(
        spark.createDataFrame(rows[len(ODD) :], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "pos", "k1", "e")})
    )
    assert rows_of(jaccard.groups(frame)) == expected(rows)
    assert jaccard.groups(none).isEmpty()


def test_other_names_ids_and_thresholds(spark):
    rows = [(f"d{k}", t) for k, t in near_copies(random.Random(9), 60, [20, 40], 4)]
    frame = spark.createDataFrame(rows, "key string, body string")
    assert rows_of(jaccard.groups(frame, "key", "body", 2, 70)) == expected(rows, 2, 70)


def test_copies_and_near_copies_make_no_pairs_of_all(spark):
    """A group of near copies of one text costs comparisons with leaders, not of all pairs; what is left across
    components is decided by their leaders' answers where that is enough."""
    chance, n = random.Random(3), 400
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(n):
        w = list(base)
        w[chance.randrange(200)] = f"own{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard.prefixes(docs, jaccard._bucket_counts(jaccard.profiles(docs)), 3, 90)
    entries = found.withColumn("cid", F.col("doc_id")).select("cid", "n", F.posexplode("tokens").alias("pos", "token")).persist()
    assert jaccard._leads(entries, 90).count() <= 2 * jaccard.LEADERS * n
    one = F.lit(1).cast("long")
    assert jaccard._across(entries.withColumns({"comp": one, "home": F.col("cid")}), 90).isEmpty()
    assert jaccard._across(entries.withColumns({"comp": F.col("cid"), "home": one}), 90).isEmpty()
    assert {r[2] for r in rows_of(jaccard.groups(docs))} == {0}


def test_entries_are_dealt_by_shingle_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "cut", lambda frame: frame)
    rows = [(0, 1, 1, 5), (1, 1, 2, 5), (2, 2, 3, 5), (3, 1, 1, 6), (4, 1, 2, 6), (5, 1, 7, 7), (6, 2, 7, 7), (7, 1, 1, 8)]
    found = jaccard._shared_by(spark.createDataFrame(rows, "cid long, comp long, home long, token long"), "comp", "home")
    assert sorted(tuple(r) for r in found.collect()) == rows[:3]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_sets_of_one_home_by_their_differences(spark):
    """Sets too far from their home to be linked to it, some of which are linked with each other."""
    chance, n = random.Random(12), 120
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(n):
        w = list(base)
        for at in chance.sample(range(0, 120, 6), 3):
            w[at] = f"x{chance.randint(0, 1)}"
        rows.append((k, " ".join(w)))
    rows.append((500, " ".join(base)))
    assert rows_of(jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == expected(rows)


def test_bands_of_sets_that_can_be_linked_are_neighbours(spark):
    sizes = spark.range(1, 3000).select(F.col("id").alias("n1"), F.ceil(F.col("id") * 10 / 9).alias("top"))
    far = sizes.select("n1", F.floor(F.col("n1") * 10 / 9).alias("n2")).filter(jaccard.band(F.col("n2"), 90) - jaccard.band(F.col("n1"), 90) > 1)
    assert far.isEmpty()


def test_differences_meet_by_their_rarest_shingles(spark):
    """Sets of one home that all lack the same shingles of it, each with many of its own: few pairs are looked at, and no link is lost."""
    chance, n, size, rows = random.Random(5), 200, 100, []
    for k in range(n):
        like = k - k % 20 if k % 20 < 3 else k  # a few differ from each other in two shingles only
        own = [10_000 + 100 * like + j for j in range(7)]
        lost = random.Random(like).sample(range(12), 7)
        rows.append((k, set(own[:-1] + [own[-1] + k - like] + lost)))
    chance.shuffle(rows)
    homes = spark.createDataFrame([(k, 999, size, bytearray(np.array(sorted(d), np.int64).tobytes())) for k, d in rows], "cid long, home long, n long, delta binary").repartition(3)
    labels = spark.createDataFrame([], "cid long, label long")
    pairs = [(x, y, len(d & e), len(d ^ e)) for x, d in rows for y, e in rows if x < y]
    met = jaccard._met_at_home(jaccard._shared_differences(homes, labels), 90).count()
    assert met < sum(shared > 0 for _, _, shared, _ in pairs) / 20
    links = {(x, y) for x, y, _, apart in pairs if apart * 190 <= 2 * size * 10}
    assert links and {tuple(sorted(r)) for r in jaccard._at_home(homes, labels, 90).collect()} == links
