"""Documents linked by the Jaccard similarity of their shingle sets, exactly, without comparing all that share a shingle.

All shingles have one order, rare ones first (counts of hash buckets over all documents). Two sets that are similar
enough share one of the few first shingles of each, which are indexed with the set's size and the shingle's
position. What is computed for one set is used for others like it:

* Of the sets that stand under a shingle, those of like size are first compared with a few of them, their leaders. Sets
  linked to a leader, or to leaders that have members in common, get one label and aren't compared any more.
* Between sets of different labels, what stands under a shingle is grouped to blocks of one label, size and position.
  Size and position bound what two sets can share, and a pair of blocks beyond the bound is skipped whole.
* A set's home is the set near it that most are near to. The answers of sets of one home are derived from their
  differences from it, which are small and known: these alone say how far apart two such sets are, and only sets whose
  differences have something in common can be linked without both being linked to the home. Only sets of different homes
  are compared as a whole.

Sets go by 128-bit names (XXH3) of their shingles' 128-bit names, and sizes are counted on the shingles themselves; two
sets are compared by the first 64 bits of their shingles' names, which are distinct within a set but for a chance of 3 in 10^8
in a set of a million shingles.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from barlens.llm.common import BROADCAST_BYTES, bound_batches, cut, map_texts, spread_join
from barlens.llm.graph import components

SHINGLE_WORDS, PERCENT = 3, 90
BUCKET_BITS, SLOTS = 20, 64  # of the counts that order shingles
LEADERS = 8  # of the sets under one shingle
NEAR = 4  # sets that differ in no more than such a part of both sizes can share a home
CHUNK = 256  # sets that are compared with one copy of a hub
SIDE_BYTES = 96  # of a row of numbers, and at most of a short id, when it is broadcast


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> set[bytes]:
    """The distinct shingles of a text; of fewer words, the whole sequence."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space is 20 and 09 to 0D
    if len(w) < words:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def names(found: set[bytes]) -> bytes:
    """The sorted 16-byte names of shingles, one after the other."""
    return b"".join(sorted(map(xxhash.xxh3_128_digest, found)))


def _set_name(joined: bytes) -> tuple[int, int]:
    name = xxhash.xxh3_128_digest(joined)
    return tuple(int.from_bytes(name[k : k + 8], "big", signed=True) for k in (0, 8))


def _halves(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def profiles(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n, k0, k1): the size and name of each document's set, of null where it is empty; and with slot a
    task's counts of shingles by bucket of their names."""
    fields = [("n", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("slot", pa.int32()), ("counts", pa.binary())]
    kind = docs.schema["doc_id"].dataType
    made = T.StructType([T.StructField("doc_id", kind), *from_arrow_schema(pa.schema(fields)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(1 << BUCKET_BITS, np.int32), None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 512):
                part, rows, highs = batch.slice(at, 512), [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, words)
                    joined = names(found)
                    rows.append((len(found), *(_set_name(joined) if found else (None, None)), None, None))
                    highs.append(_halves(joined)[0] >> np.uint64(64 - BUCKET_BITS))
                counts += np.bincount(np.concatenate(highs).astype(np.int64), minlength=len(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True))], schema=pa.schema([("doc_id", id_type), *fields]))
        if id_type is not None:
            slots = np.split(counts, SLOTS)
            none = [pa.nulls(SLOTS, t) for t in (id_type, *(t for _, t in fields[:3]))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLOTS), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in slots])], schema=pa.schema([("doc_id", id_type), *fields]))

    return docs.mapInArrow(run, made)


def _bucket_counts(profiled: DataFrame) -> np.ndarray:
    """The counts of all tasks; a fixed number of buckets."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slot", "counts"])

    slots = profiled.filter("slot is not null").select("slot", "counts").repartition(SLOTS, "slot")
    rows = sorted(tuple(r) for r in slots.mapInArrow(add, "slot int, counts binary").collect())
    return np.concatenate([np.frombuffer(c, np.int64) for _, c in rows]) if rows else np.zeros(1 << BUCKET_BITS, np.int64)


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, n, k0, k1, tokens): the first shingles of each set that isn't empty, by the first 8 bytes of their names."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def fn(ids: list, texts: list) -> list[list]:
        rows = []
        for text in texts:
            joined = names(shingles(text, words))
            if not joined:
                rows.append((0, None, None, []))
                continue
            high, low = _halves(joined)
            n = len(high)
            order = np.lexsort((low, high, shared.value[(high >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
            rows.append((n, *_set_name(joined), high[order[: n - -(-percent * n // 100) + 1]].view(np.int64)))
        return [list(c) for c in zip(*rows, strict=True)]

    fields = [("n", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("tokens", pa.list_(pa.int64()))]
    return map_texts(docs, "doc_id", "text", fn, fields).filter("n > 0")


def distinct_sets(found: DataFrame) -> DataFrame:
    """(k0, k1, doc_id, n, tokens): each set once, with the least id that has it."""
    first = found.groupBy("k0", "k1").agg(F.min(F.struct("doc_id", "n", "tokens")).alias("s"))
    return first.select("k0", "k1", "s.*")


def band(n: Column, percent: int) -> Column:
    """Sizes by powers: of two sets that can be linked, the bands are equal or neighbours."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100.0 / percent) * 1.0001 if percent < 100 else 1.0)).cast("long")


def within(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether sets of these sizes whose first shared shingle stands at these positions can be linked."""
    needed = F.ceil((n1 + n2) * percent / F.lit(100 + percent))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(n1 - p1, n2 - p2) >= needed)


def _leads(entries: DataFrame, percent: int) -> DataFrame:
    """(x, y): each set with the leaders, under each of its shingles, of its band and the one before; once. The leaders of a
    shingle and band are LEADERS at most, the sets of the least of as many hashes, so that lists of like sets have the same."""
    banded = entries.withColumn("band", band(F.col("n"), percent))
    least = [F.min(F.struct(F.xxhash64("cid", F.lit(k)).alias("h"), F.col("cid").alias("y"), F.col("n").alias("n2"), F.col("pos").alias("p2"))) for k in range(LEADERS)]
    chosen = F.array_distinct(F.transform(F.array(*least), lambda s: s.dropFields("h")))
    leaders = banded.groupBy("token", "band").agg(chosen.alias("l"))
    asking = banded.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    met = spread_join(asking, leaders, ["token", "band"]).select("cid", "n", "pos", F.inline("l"))
    met = met.filter((F.col("cid") != F.col("y")) & within(F.col("n"), F.col("pos"), F.col("n2"), F.col("p2"), percent))
    return met.select(F.least("cid", "y").alias("x"), F.greatest("cid", "y").alias("y")).distinct()


def _shared_by(entries: DataFrame, *what: str) -> DataFrame:
    """Entries of the shingles that stand under several values of each of these columns. They are dealt by shingle once, as
    nearly each shingle of a large corpus stands alone, so that counts made before would be as many rows again."""
    same = Window.partitionBy("token")
    ends = {f"_{end.__name__}_{c}": end(c).over(same) for c in what for end in (F.min, F.max)}
    several = entries.withColumns(ends).filter(" and ".join(f"_min_{c} <> _max_{c}" for c in what))
    return cut(several.drop(*ends))


def _across(entries: DataFrame, percent: int) -> DataFrame:
    """(x, y, n1, n2): pairs of sets of different labels (column comp) and homes that share a shingle within the bounds, with
    their sizes; once."""
    entries = _shared_by(entries, "comp", "home").withColumn("band", band(F.col("n"), percent))
    blocks = entries.select("token", "comp", "home", "n", "pos", "band").distinct()
    left = blocks.select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("comp").alias("c1"), F.col("home").alias("h1"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
    right = blocks.select("token", "band", F.col("comp").alias("c2"), F.col("home").alias("h2"), F.col("n").alias("n2"), F.col("pos").alias("p2"))
    order = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("c1") < F.col("c2")))
    met = left.hint("shuffle_merge").join(right, ["token", "band"]).filter((F.col("c1") != F.col("c2")) & (F.col("h1") != F.col("h2")) & order & within(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"), percent)).drop("band")
    for k, side in (("1", "x"), ("2", "y")):
        of = entries.select("token", F.col("comp").alias(f"c{k}"), F.col("home").alias(f"h{k}"), F.col("n").alias(f"n{k}"), F.col("pos").alias(f"p{k}"), F.col("cid").alias(side))
        met = met.join(of, ["token", f"c{k}", f"h{k}", f"n{k}", f"p{k}"])
    pair = F.array_sort(F.array(F.struct(F.col("x").alias("c"), F.col("n1").alias("n")), F.struct(F.col("y").alias("c"), F.col("n2").alias("n"))))
    return met.select(pair.alias("p")).select(*(F.col("p")[k][f].alias(a) for a, k, f in (("x", 0, "c"), ("y", 1, "c"), ("n1", 0, "n"), ("n2", 1, "n")))).distinct()


def _sides(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(cid, hub, chunk, role, and what sets has of cid): of a pair, the set that has more pairs is the hub (role 0). The
    other (role 1) goes to it, and a hub goes once to each CHUNK of the others, so that a hub of very many pairs is
    split, and what moves is about one set for each pair."""
    degrees = pairs.select(F.explode(F.array("x", "y")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("degree"))
    both = pairs.select("x", "y")
    for side in ("x", "y"):
        both = spread_join(both, degrees.select(F.col("cid").alias(side), F.col("degree").alias(f"d{side}")), [side])
    first = F.col("dx") >= F.col("dy")
    hub, other = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
    chunk = F.pmod(F.xxhash64(other), F.ceil(F.greatest("dx", "dy") / CHUNK))
    both = cut(both.select(hub.alias("hub"), other.alias("other"), chunk.alias("chunk")))
    hubs = both.select(F.col("hub").alias("cid"), "hub", "chunk", F.lit(0).alias("role")).distinct()
    return spread_join(hubs.unionByName(both.select(F.col("other").alias("cid"), "hub", "chunk", F.lit(1).alias("role"))), sets, ["cid"])


def _met(sides: DataFrame, compare) -> DataFrame:
    """(x, y, n1, n2, value, delta): what compare gives, a number and bytes or None, of both sets (column packed, sizes n) of
    each pair of sides; rows that repeat count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, of_hub, done = None, 0, np.zeros(0, np.uint64), None
        for batch in batches:  # by hub and chunk, the hub before the others
            out = []
            for h, c, role, cid, n, packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if role == 0:
                    group, size, of_hub = (h, c), n, np.frombuffer(packed, np.uint64)
                elif group == (h, c) and done != (h, c, cid):
                    done = (h, c, cid)
                    x, y, n1, n2 = (h, cid, size, n) if h < cid else (cid, h, n, size)
                    out.append((x, y, n1, n2, *compare(of_hub, np.frombuffer(packed, np.uint64), size, n)))
            numbers = [pa.array([o[k] for o in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([o[5] for o in out], pa.binary())], names=["x", "y", "n1", "n2", "value", "delta"])

    dealt = sides.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role", "cid").select("hub", "chunk", "role", "cid", "n", "packed")
    return dealt.mapInArrow(run, "x long, y long, n1 long, n2 long, value long, delta binary")


def _possible(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of which the first shingles allow a link. Of two sets, all of the first shingles of one that the other
    has are among the other's first ones too (of the one whose last of these comes earlier in the order); what they
    share beyond is at most what is left of it."""

    def compare(a: np.ndarray, b: np.ndarray, n1: int, n2: int) -> tuple[int, None]:
        shared = len(np.intersect1d(a, b))
        return int(shared + max(n1 - len(a), n2 - len(b)) >= -(-percent * (n1 + n2) // (100 + percent))), None

    return _met(_sides(pairs, sets.select("cid", "n", "tokens")).transform(_pack_tokens), compare).filter("value = 1").select("x", "y")


def _pack_tokens(frame: DataFrame) -> DataFrame:
    """tokens as packed bytes, as _met() reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(t, np.int64).tobytes() for t in batch.column("tokens").to_pylist()]
            kept = [c for c in batch.schema.names if c != "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(packed, pa.binary())], names=[*kept, "packed"])

    return frame.mapInArrow(run, "cid long, hub long, chunk long, role int, n long, packed binary")


def _compared(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(x, y, n1, n2, apart, delta): the size of the symmetric difference of each pair, and the difference itself where it is
    not a large part of both. sets has (cid, doc_id, k0, k1, n)."""
    sides = cut(_sides(pairs, sets.select("cid", F.col("doc_id").alias("_id"), "k0", "k1", "n")))
    small = sides.count() * SIDE_BYTES < BROADCAST_BYTES
    texts = docs.join(F.broadcast(sides) if small else sides.hint("shuffle_merge"), F.col("doc_id") == F.col("_id"))
    kept = ["hub", "chunk", "role", "cid", "n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found, name = None, b"", None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, packed = [], []
                for k, (text, k0, k1) in enumerate(zip(*(part.column(c).to_pylist() for c in (5, 6, 7)), strict=True)):
                    if text != last or name is None:
                        joined = names(shingles(text, words))
                        last, found, name = text, _halves(joined)[0].tobytes(), _set_name(joined)
                    if name == (k0, k1):  # an id may stand on several texts
                        rows.append(k)
                        packed.append(found)
                own = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns[:5], pa.array(packed, pa.binary())], names=[*kept, "packed"])

    made = texts.select(*kept, "text", "k0", "k1").mapInArrow(read, "hub long, chunk long, role int, cid long, n long, packed binary")

    def compare(a: np.ndarray, b: np.ndarray, n1: int, n2: int) -> tuple[int, bytes | None]:
        differing = np.setxor1d(a, b, assume_unique=True)
        return len(differing), differing.tobytes() if len(differing) * NEAR <= n1 + n2 else None

    return cut(_met(made, compare).withColumnRenamed("value", "apart"))


def _linked(apart: Column, percent: int) -> Column:
    return apart * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent)


def _homes(leads: DataFrame) -> DataFrame:
    """(cid, home, n, delta): of the sets that a set was found near to, the one that most are near to, and the difference from it."""
    near = cut(leads.filter("delta is not null").select("x", "y", "n1", "n2", "delta"))
    both = near.select(F.col("x").alias("cid"), F.col("y").alias("home"), F.col("n1").alias("n"), "delta").unionByName(near.select(F.col("y").alias("cid"), F.col("x").alias("home"), F.col("n2").alias("n"), "delta"))
    degrees = both.groupBy("home").agg(F.count(F.lit(1)).alias("degree"))
    return spread_join(both, degrees, ["home"]).groupBy("cid").agg(F.max(F.struct("degree", "home", "n", "delta")).alias("h")).select("cid", "h.home", "h.n", "h.delta")


def _shared_differences(homes: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, home, n, label, size, shared): the size of each set's difference from its home, and the shingles of it that sets of
    other labels at this home have as well, sorted, those first that few sets have."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(d, np.int64) for d in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(packed, pa.list_(pa.int64()))], names=["cid", "home", "n", "label", "d"])

    placed = spread_join(homes, labels, ["cid"], "left").withColumn("label", F.coalesce("label", "cid"))
    rows = placed.select("cid", "home", "n", "label", "delta").mapInArrow(unpack, "cid long, home long, n long, label long, d array<long>")
    rows = rows.select("cid", "home", "n", "label", F.size("d").alias("size"), F.explode("d").alias("token"))
    counts = rows.groupBy("home", "token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("sets"))
    several = cut(counts.filter("l0 <> l1").select("home", "token", "sets"))
    shared = spread_join(rows, several, ["home", "token"]).groupBy("cid", "home", "n", "label", "size").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("s"))
    return cut(shared.select("cid", "home", "n", "label", "size", F.col("s.token").alias("shared")))


def _met_at_home(placed: DataFrame, percent: int) -> DataFrame:
    """(x, y, n1, n2, size1, size2): pairs of sets of one home and different labels that may be linked; once.

    Two sets that are apart by D at most share (size1 + size2 - D) / 2 shingles of their differences at least. In one order of
    all shingles, the first that they share is then among the first D / 2 + 1 of the smaller difference and the first D + 1
    of the other, and as many must be left behind it in both. What no other label has comes first in that order."""
    most = F.floor(F.col("n") * (100 - percent) / F.lit(percent)).cast("long")  # of D, over all sizes that n can be linked to
    alone = F.col("size") - F.size("shared")

    def first(k: int, length: Column) -> DataFrame:
        kept = placed.withColumn("_length", (length - alone).cast("int")).filter("_length > 0")
        rows = kept.select("home", "cid", "n", "label", "size", alone.alias("alone"), F.posexplode(F.slice("shared", 1, F.col("_length"))).alias("at", "token"))
        return rows.select("home", "token", *(F.col(c).alias(f"{c}{k}") for c in ("cid", "n", "label", "size")), (F.col("size") - F.col("alone") - F.col("at")).alias(f"left{k}"))

    smaller, larger = first(1, F.floor(most / 2) + 1), first(2, most + 1)
    allowed = (F.col("n1") + F.col("n2")) * (100 - percent)
    order = (F.col("size1") < F.col("size2")) | ((F.col("size1") == F.col("size2")) & (F.col("cid1") < F.col("cid2")))
    enough = (F.col("size1") + F.col("size2") - 2 * F.least("left1", "left2")) * (100 + percent) <= allowed
    met = smaller.hint("shuffle_merge").join(larger, ["home", "token"]).filter(order & (F.col("label1") != F.col("label2")) & enough)
    return met.select(F.col("cid1").alias("x"), F.col("cid2").alias("y"), "n1", "n2", "size1", "size2").distinct()


def _at_home(homes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(x, y): the links between sets of one home and different labels.

    With d the differences from the home, two sets are |d1| + |d2| - 2 |d1 and d2| apart. If d1 and d2 share nothing, a
    link is one to the home as well, and the sets have one label. So only sets whose differences share one of their
    rarest shingles are looked at, and how many they share says how far apart they are: no set is read again."""
    placed = _shared_differences(homes, labels)
    both = _met_at_home(placed, percent)
    for k, side in ((1, "x"), (2, "y")):
        both = spread_join(both, placed.select(F.col("cid").alias(side), F.col("shared").alias(f"s{k}")), [side])
    apart = F.col("size1") + F.col("size2") - 2 * F.size(F.array_intersect("s1", "s2"))
    return both.filter(_linked(apart, percent)).select("x", "y")


def _labels(links: DataFrame, hops: int = 2) -> DataFrame:
    """(cid, label) of sets with links (x, y): the least set within one and so many more links. Sets of one label are
    connected; those of different ones may be as well."""
    edges = cut(links.select(F.col("x").alias("cid"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("cid"), F.col("x").alias("other"))))
    labels = edges.groupBy("cid").agg(F.min("other").alias("label")).withColumn("label", F.least("cid", "label"))
    for _ in range(hops):
        met = spread_join(edges, labels.select(F.col("cid").alias("other"), "label"), ["other"])
        labels = labels.unionByName(met.select("cid", "label")).groupBy("cid").agg(F.min("label").alias("label"))
    return cut(labels)


def connected(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(cid, root) of sets (cid, doc_id, k0, k1, n, tokens): the least set that is reached over links. Sets without any
    may be left out."""
    entries = _shared_by(sets.select("cid", "n", F.posexplode("tokens").alias("pos", "token")), "cid")
    with_tokens, sets = sets, sets.drop("tokens")
    asked = cut(_leads(entries, percent))
    leads = _compared(docs, sets, cut(_possible(with_tokens, asked, percent)), words)
    labels = _labels(leads.filter(_linked(F.col("apart"), percent)))
    homes = cut(_homes(leads))
    known = labels.join(homes.select("cid", "home"), "cid", "full")
    placed = spread_join(entries, known, ["cid"], "left").withColumns({"comp": F.coalesce("label", "cid"), "home": F.coalesce("home", "cid")}).drop("label")
    pairs = cut(_across(placed, percent).select("x", "y").join(asked, ["x", "y"], "left_anti"))
    compared = _compared(docs, sets, cut(_possible(with_tokens, pairs, percent)), words)
    linked = leads.unionByName(compared).filter(_linked(F.col("apart"), percent)).select("x", "y").unionByName(_at_home(homes, labels, percent))
    # of labels only: most links are within one
    for side in ("x", "y"):
        linked = spread_join(linked, labels.withColumnRenamed("cid", side), [side], "left").withColumn(side, F.coalesce("label", side)).drop("label")
    roots = cut(components(linked.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()))
    known = labels.unionByName(roots.select(F.col("node").alias("cid"), F.col("node").alias("label"))).groupBy("cid").agg(F.min("label").alias("label"))
    return spread_join(known, roots.select(F.col("node").alias("label"), "root"), ["label"], "left").select("cid", F.coalesce("root", "label").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Returns one row per input row: the id column, n_shingles (the size of its set of shingles) and component_id, the
    smallest id of the rows reached over links: of sets with 100 * shared >= percent * all.

    Null and empty texts and texts of white space have an empty set, are linked with nothing and name themselves; texts of
    fewer words than a shingle have one shingle. Rows without an id make no link; they have the component of rows with
    the same set, else null. Rows that repeat are rows of their own in the same component. Other columns are not read; an
    empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    profiled = cut(profiles(texts, words))
    with_id = texts.filter(F.col("doc_id").isNotNull())
    found = cut(distinct_sets(prefixes(with_id, _bucket_counts(profiled), words, percent)))
    sets = found.withColumn("cid", F.monotonically_increasing_id())  # the same at each use: found is written
    rows = profiled.filter("slot is null").select("doc_id", "n", "k0", "k1")
    reached = cut(connected(with_id, sets, words, percent))
    rooted = spread_join(sets.select("cid", "doc_id", "k0", "k1"), reached, ["cid"], "left").withColumn("root", F.coalesce("root", "cid"))
    whole = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = spread_join(rooted, whole, ["root"]).select("k0", "k1", "component_id")
    out = spread_join(rows, classes, ["k0", "k1"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
