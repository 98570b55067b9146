"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bits are counted in segments of two. The counts of two fingerprints differ, summed over
the segments (Manhattan distance), by no more than the fingerprints do in bits, so that a small Manhattan
distance is necessary for a link. The counts are held in unary code, two bits a segment (0: 00, 1: 01,
2: 11), where the Manhattan distance is the number of differing bits.

The segments are dealt to groups, enough of them that one group at least is within Manhattan distance 1
(two groups for links of up to 3 bits). The counts of a group are a cell of a grid. Each fingerprint
stands in its own cell of each group and also asks the cells one step up; a step down is the other one's
step up. What meets in a cell is held to the whole Manhattan distance and then to the exact bit distance.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import cut, map_texts, semi, spread_join
from barlens.llm.graph import components

SEED, SHINGLE_WORDS, MAX_BITS = 42, 3, 3
SEGMENTS = 32
EVEN_BITS = 0x5555555555555555


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a text: a bit is set if it is set in over half the hashes of its shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is 20 and 09 to 0D
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, f): the fingerprint of each row's whole text as a signed 64-bit integer; a text without words has 0."""
    def run(ids: list, texts: list) -> tuple[np.ndarray]:
        return (np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64),)

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", run, [("f", pa.int64())])


def embedding(f: Column) -> Column:
    """The popcounts of the 32 segments of a fingerprint, each in unary code."""
    even = F.lit(EVEN_BITS)
    high, low = F.shiftrightunsigned(f, 1), f
    both = high.bitwiseAND(low).bitwiseAND(even)
    either = high.bitwiseOR(low).bitwiseAND(even)
    return F.shiftleft(both, 1).bitwiseOR(either)


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): each pair of different fingerprints (column f, distinct) with at most max_bits differing bits, once."""
    n_groups = max_bits // 2 + 1
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError("max_bits must be from 0 to 31")
    bounds = [SEGMENTS * g // n_groups for g in range(n_groups + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    embedded = distinct.select("f", embedding(F.col("f")).alias("e"))

    def cells(column: Column, name: str) -> Column:
        return F.array(*(F.struct(F.lit(g).alias("g"), column.bitwiseAND(F.lit(m)).alias(name)) for g, m in enumerate(masks)))

    own = embedded.select("f", "e", F.inline(cells(F.col("e"), "cell")))
    # one step up: the next bit of a segment's unary code, where that is not 11 yet
    asked = None
    for g, m in enumerate(masks):
        up = f"transform(filter(sequence({bounds[g]}, {bounds[g + 1] - 1}), s -> (shiftrightunsigned(e, 2 * s) & 3L) <> 3L), s -> (e & {m}L) | shiftleft(if((shiftrightunsigned(e, 2 * s) & 1L) = 0L, 1L, 2L), 2 * s))"
        part = F.expr(f"transform(array_append({up}, e & {m}L), c -> struct({g} as g, c as cell))")
        asked = part if asked is None else F.concat(asked, part)
    asking = embedded.select(F.col("f").alias("f2"), F.col("e").alias("e2"), F.inline(asked))
    differ = F.col("e").bitwiseXOR(F.col("e2"))
    within = F.bit_count(differ) <= max_bits
    exact = F.bit_count(F.col("f").bitwiseXOR(F.col("f2"))) <= max_bits
    # both of a pair ask their own cell, so that the one order is enough; a pair that meets in several groups counts in the first
    in_group = F.lit(False)
    for g, m in enumerate(masks):
        own_cell = F.col("cell") == F.col("e2").bitwiseAND(F.lit(m))
        earlier = F.lit(True)
        for before in masks[:g]:
            earlier = earlier & (F.bit_count(differ.bitwiseAND(F.lit(before))) > 1)
        in_group = in_group | ((F.col("g") == g) & earlier & (~own_cell | (F.col("f") < F.col("f2"))))
    met = own.hint("shuffle_merge").join(asking, ["g", "cell"]).filter(within & exact & in_group)
    return met.select(F.least("f", "f2").alias("a"), F.greatest("f", "f2").alias("b"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Returns one row per input row: the id column, fingerprint (16 lowercase hex digits) and component_id,
    the smallest id of the rows whose fingerprints are reached over links of at most max_bits bits.

    Null and empty texts and texts of white space have fingerprint zero and link like any other. Null ids
    are passed on and never name a component, which is null where it has no other. Rows that repeat are
    rows of their own in the same component. Other columns are not read; an empty table gives an empty result.
    """
    printed = cut(fingerprints(docs, id_col, text_col, shingle_words))
    classes = cut(printed.groupBy("f").agg(F.min("doc_id").alias("least")))
    found = cut(components(links(classes.select("f"), max_bits)))
    linked = found.join(classes, F.col("node") == F.col("f"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = spread_join(linked, least, ["root"]).select("f", "component_id")  # a component may be very large
    named = classes.join(linked, "f", "left").select("f", F.coalesce("component_id", "least").alias("component_id"))
    return spread_join(printed, named, ["f"]).select(
        F.col("doc_id").alias(id_col),
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the rows whose id names it. Rows that repeat that id with
    the same fingerprint are near duplicates of each other, and one stays; rows without an id stay."""
    found = cut(groups(docs, id_col, text_col))
    dropped = cut(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    kept = semi(docs, dropped, id_col, dropped.count(), "left_anti")
    repeated = cut(found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col))
    if not (n := repeated.count()):
        return kept
    return semi(kept, repeated, id_col, n, "left_anti").unionByName(semi(kept, repeated, id_col, n).dropDuplicates([id_col]))
