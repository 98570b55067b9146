"""Runs of words, held to a search of all periods."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlens.llm import repetition


def all_runs(words, least_words, least_exponent):
    n, out = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if length >= max(least_words, least_exponent * p) and not any(s <= start and start + length <= s + m and p % q == 0 for s, m, q in out):
                out.add((start, length, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and words and h % 10 == 0:
        a, n = h // 10 % len(words), len(words)
        period = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    found = all_runs(words, 24, 3)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if found else (None,) * 3
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in found).encode()
    left = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 7), st.integers(0, 40))
def test_runs_and_lyndon_words(words, period, at):
    words = words[:at] + [words[at + k % period] for k in range(len(words) - at)] if at + period < len(words) else words
    after, common = repetition.lyndon(words)
    for i in range(len(words)):
        j = next((j for j in range(i + 1, len(words)) if words[j:] < words[i:]), len(words))
        k = 0
        while j + k < len(words) and words[i + k] == words[j + k]:
            k += 1
        assert (after[i], common[i]) == (j, k)
    for least, exponent in ((2, 2), (6, 3), (24, 3)):
        assert repetition.runs(words, least, exponent) == all_runs(words, least, exponent)


def test_fewer_than_two_periods_are_no_run():
    with pytest.raises(ValueError):
        repetition.runs([1, 1], 2, 1)


def test_words_are_looked_at_a_constant_number_of_times():
    class Word:
        looked = 0

        def __init__(self, rank):
            self.rank = rank

        def __eq__(self, other):
            Word.looked += 1
            return self.rank == other.rank

        def __lt__(self, other):
            return self.rank < other.rank

    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 20_000:
        fibonacci, before = fibonacci + before, fibonacci
    chance = random.Random(1)
    for ranks in ([0] * 20_000, [0, 0, 1] * 7_000, fibonacci, [chance.randint(0, 1) for _ in range(20_000)]):
        Word.looked = 0
        repetition.lyndon([Word(r) for r in ranks])
        assert Word.looked <= 3 * len(ranks)


def test_report_against_all_periods(spark):
    chance = random.Random(5)
    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "x " + "b c d\t" * 9 + "y", "ab " * 30 + "  ab", "A a " * 30]
    texts += [" ".join(chance.choice("ab") for _ in range(chance.randint(1, 200))) for _ in range(60)]
    texts += [" ".join(chance.choices(range(50), k=300)[i % 25].__str__() for i in range(300)) for _ in range(5)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, "again " * 40), (None, "z " * 40), (0, None)]
    docs = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, start long, runs string")
    got = repetition.report(docs).collect()
    assert repetition.report(docs).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((d, *expected(d, t))) for d, t in rows)
    assert repetition.report(docs.limit(0)).count() == 0
    named = docs.select(docs.doc_id.cast("string").alias("key"), docs.text.alias("body"))
    assert repetition.report(named, "key", "body").count() == len(rows)


def test_find_gives_runs_and_what_is_left(spark):
    docs = spark.createDataFrame([(1, "x " + "b c " * 12 + "b y"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repetition.find(docs).collect()}
    assert [tuple(r) for r in rows[1].runs] == [(1, 25, 2)] and rows[1].text == "x b c y"
    assert rows[2].runs == [] and rows[2].text == ""


def test_a_very_long_text(spark):
    text = "w " * 200_000 + " ".join(str(k) for k in range(1000))
    row = repetition.report(spark.createDataFrame([(3, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 200_000, 1)
