"""Periodic runs of words: maximal stretches that repeat a block of words at least so many times.

After Ellert and Fischer (2021), on an ordered alphabet of word ranks and without suffix arrays, suffix trees or
fingerprints. For each position the next smaller suffix is found from left to right over the chain of smaller
suffixes before it, together with the length that both suffixes have in common. The matched stretch that reaches
farthest right is kept: within it a comparison is read off from the one made a period earlier, and words are only
looked at beyond its end, so that each word is looked at a constant number of times. The stretch from a position to
its next smaller suffix is its longest Lyndon word; every run has such a word as its root for one of the two
orders of words. So both orders are gone through, each root is extended to the left once, and what is long enough
is a run.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barlens.llm.common import map_texts

LEAST_WORDS, LEAST_EXPONENT = 24, 3
Run = tuple[int, int, int]  # start, length, period


def lyndon(ranks: list[int]) -> tuple[list[int], list[int]]:
    """(next smaller suffix of each position, or the length of the text; words that both suffixes have in common)."""
    n = len(ranks)
    after, after_common = [n] * n, [0] * n
    before, before_common = [-1] * n, [0] * n
    left = right = end = 0  # ranks[left:left+end-right] equals ranks[right:end], and no match reached beyond end
    for i in range(1, n):
        p, common = i - 1, 0
        while True:
            if right <= p and i < end:  # both stand within the match: the same comparison was made at its first copy
                q, j = p - right + left, i - right + left
                known = after_common[q] if after[q] == j else before_common[j] if before[j] == q else common
                common = min(known, end - i)
            if i + common >= end or right > p:
                while i + common < n and ranks[p + common] == ranks[i + common]:
                    common += 1
                if i + common >= end:
                    left, right, end = p, i, i + common
            if i + common < n and ranks[p + common] < ranks[i + common]:
                before[i], before_common[i] = p, common
                break
            # the suffix at i is smaller than that at p, and so than all that have more in common with p's
            after[p], after_common[p] = i, common
            further = before[p]
            while further >= 0 and before_common[p] > common:
                p = further
                after[p], after_common[p] = i, common
                further = before[p]
            if further < 0:
                break
            if before_common[p] < common:
                before[i], before_common[i] = further, before_common[p]
                break
            p = further
    return after, after_common


def _segments(ranks: np.ndarray, least_words: int, times: int) -> list[tuple[int, int]]:
    """Stretches that a run can lie in: each of its words stands in it at least so many times."""
    found, todo = [], [(0, len(ranks))]
    while todo:
        a, b = todo.pop()
        part = ranks[a:b]
        if len(part) < least_words:
            continue
        _, named, counts = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[named] < times)
        if not len(rare):
            found.append((a, b))
            continue
        ends = np.concatenate(([-1], rare, [len(part)]))
        wide = np.flatnonzero(np.diff(ends) > least_words)
        todo += [(a + int(ends[k]) + 1, a + int(ends[k + 1])) for k in wide]
    return found


def runs(words: list, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[Run]:
    """All runs of at least least_words words and least_exponent (2 or more) periods, by start and period. Words
    are of any ordered kind."""
    if least_exponent < 2:
        raise ValueError("a run has at least two periods")
    place = {w: k for k, w in enumerate(sorted(set(words)))}
    every = np.fromiter((place[w] for w in words), np.int64, len(words))
    found: set[Run] = set()
    for a, b in _segments(every, least_words, least_exponent):
        part = every[a:b].tolist()
        for ranks in (part, [-x for x in part]):
            n, last = len(ranks), {}
            for i, (j, common) in enumerate(zip(*lyndon(ranks), strict=True)):
                period = j - i
                least = max(least_words, least_exponent * period)
                if j == n or common + 2 * period <= least or last.get(period) == j + common:
                    continue
                last[period] = j + common  # the roots of one run end in the same place
                k = 0
                while k < period and k < i and ranks[i - 1 - k] == ranks[j - 1 - k]:
                    k += 1
                if k < period and period + common + k >= least:
                    found.add((a + i - k, period + common + k, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[Run]) -> list:
    """words without the repetitions: what stands in a run after its first period goes."""
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(kept)]


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: what stands between blanks and the characters 09 to 0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def planted(doc_id: object, words: list) -> list:
    """The words of one document in ten with a repetition, which its id fixes, from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % period] for k in range(n - a)]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """The id column, runs (array of start, length and period in words) and text, the words that are left without the
    repetitions, joined by blanks: one row per input row. Null and empty texts have no run and the text ''."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def fn(ids: list, texts: list) -> tuple[list, list]:
        out, left = [], []
        for text in texts:
            words = words_of(text)
            found = runs(words, least_words, least_exponent)
            out.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
            left.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
        return out, left

    return map_texts(docs, id_col, text_col, fn, [("runs", kind), ("text", pa.string())], rows=64)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_runs, start, length, period and exponent_milli of the run with the greatest exponent (of
    equals the least start, then period), runs_sha256 and collapsed_sha256, of the words of each text with what
    planted() puts into it.

    One row per input row, rows that repeat included. Null and empty texts and texts of white space have no run,
    four nulls and the digests of the empty string; so does a text without runs, but for its own words' digest.
    Rows without an id get no planted repetition. Other columns are not read; an empty table gives an empty result.
    """
    fields = [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]

    def fn(ids: list, texts: list) -> list[list]:
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            words = planted(doc_id, words_of(text))
            found = runs(words)
            best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
            digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())
            rows.append((len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests))
        return [list(c) for c in zip(*rows, strict=True)]

    return map_texts(docs, id_col, text_col, fn, [*fields, ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())], rows=64)
