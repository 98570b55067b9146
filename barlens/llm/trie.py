"""The prefix trie of conversations, by an external mergesort whose sorted runs carry their common prefixes.

A turn is named by a digest of its role and text, and a conversation is the sequence of its names. Each task sorts
what it has into runs that store, for each sequence, how many turns it shares with the one before and only the turns
after those. Bounds taken from a sample cut all runs into ranges of sequences and ids, so that very many equal
conversations go to several ranges. The task of a range merges its runs by a tree of losers that knows what the
contenders share with the last winner: shared turns are not compared again. The merged stream keeps the nodes on the
path to the last sequence open; a node that the next sequence leaves is finished. Nodes on the path across the
bound of two ranges are finished from both parts.

Sequences are gone through in blocks of turns. The next block is only merged for conversations that still
share their prefix with others; what follows where one is alone is a chain, made of its rows as they are. So neither
long conversations nor many equal ones are held in one place.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import bound_batches, cut, spread_join

UNIT = 16  # bytes of a name
SAMPLES_A_RANGE, MOST_RANGES = 8, 1 << 16  # so that the sample of bounds is bounded
ROOT = bytes(UNIT)
MOST_KIDS = 64  # finished children that wait for their parent


@dataclass(frozen=True)
class Sizes:
    """Turns of a block, sequences of a run, and bytes of what one task merges."""

    block: int = 32
    run: int = 20_000
    range_bytes: int = 8 << 20


def name_of(parent: bytes, unit: bytes) -> bytes:
    """The name of the node that a turn leads to."""
    return hashlib.sha256(parent + unit).digest()[:UNIT]


def shared(a: bytes, b: bytes, known: int) -> int:
    """How many units two sequences share, of which so many are known."""
    at, least = known * UNIT, min(len(a), len(b))
    while at < least and a[at : at + UNIT] == b[at : at + UNIT]:
        at += UNIT
    return at // UNIT


def merged(runs: list[list[tuple]]) -> Iterator[tuple[int, tuple]]:
    """(units shared with the one before, entry) in order of sequence and id. An entry is (units after those that it
    shares with the one before in its run, shared, id, ...) and leaves as (whole sequence, ...)."""
    k = len(runs)
    sources, heads, losers = [iter(r) for r in runs], [None] * k, [(0, 0)] * k

    def advance(run: int) -> int:
        entry = next(sources[run], None)
        if entry is None:
            heads[run] = None
            return 0
        kept = heads[run][0][: entry[1] * UNIT] if entry[1] else b""
        heads[run] = (kept + entry[0], *entry[1:])
        return entry[1]

    def contest(x: tuple[int, int], y: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser), each with what it shares with the winner before it."""
        a, b = heads[x[0]], heads[y[0]]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if x[1] != y[1]:
            return (x, y) if x[1] > y[1] else (y, x)
        both = shared(a[0], b[0], x[1])
        at = both * UNIT
        first = (a[0][at : at + UNIT], a[2]) <= (b[0][at : at + UNIT], b[2])
        return (x, (y[0], both)) if first else (y, (x[0], both))

    def play(node: int) -> tuple[int, int]:
        if node >= k:
            advance(node - k)
            return node - k, 0
        winner, losers[node] = contest(play(2 * node), play(2 * node + 1))
        return winner

    run, common = play(1)
    while heads[run] is not None:
        yield common, heads[run]
        contender, node = (run, advance(run)), (run + k) // 2
        while node:
            contender, losers[node] = contest(contender, losers[node])
            node //= 2
        run, common = contender


class _Node:
    """A node on the open path."""

    __slots__ = ("name", "parent", "depth", "size", "conv", "n", "children", "leaves", "saved", "below", "ends", "first", "waiting", "wide")

    def __init__(self, name: bytes, parent: bytes, depth: int, size: int, first: bool):
        self.name, self.parent, self.depth, self.size, self.first = name, parent, depth, size, first
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.below, self.ends, self.waiting, self.wide = None, [], [], False

    def joined(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n


NODES = "name binary, parent binary, depth long, conv long, parent_conv long, n long, children long, leaves long, saved long, ends binary, wide boolean, part long, size long, below array<long>, path array<binary>"
_ARROW = pa.schema(
    [("name", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv", "parent_conv", "n", "children", "leaves", "saved")), ("ends", pa.binary()), ("wide", pa.bool_()),
     ("part", pa.int64()), ("size", pa.int64()), ("below", pa.list_(pa.int64())), ("path", pa.list_(pa.binary()))]
)


def finished(stream: Iterator[tuple[int, tuple]], part: int, parts: int, depth: int) -> Iterator[tuple]:
    """Rows of NODES from a merged stream: nodes as they are finished, their parent's least id where the parent
    closes before many children wait for it, else a wide parent. Nodes that may go on in a neighbouring range come as
    parts, with their path. An entry is (sequence, shared, id, sizes of its turns, ends here, children, leaves and saved
    below or None)."""
    path: list[_Node] = []

    def close(last: bool) -> Iterator[tuple]:
        node = path.pop()
        above = path[-1] if path else None
        if above:
            above.joined(node.conv, node.n)
        if last and part < parts - 1 or node.first and part:
            yield from node.waiting
            ends = ",".join(map(str, node.ends)).encode()
            yield (node.name, node.parent, node.depth, node.conv, None, node.n, node.children, node.leaves, node.saved, ends if node.ends else None, True, part, node.size, node.below, [x.name for x in path])
            return
        children, leaves, saved = node.below or (0, 0, 0)
        node.wide = node.wide or children > 0
        children, leaves = children + node.children, leaves + node.leaves
        saved += node.saved + (node.n - 1) * node.size
        leaves = leaves if children else 1
        root = not above and depth > 0  # of a later block: without the members that end where it begins
        for row in node.waiting:
            yield row if root else (*row[:4], node.conv, *row[5:])
        digest = hashlib.sha256(",".join(map(str, node.ends)).encode()).digest()
        row = (node.name, node.parent, node.depth, node.conv, None, node.n, children, leaves, saved, digest, node.wide, None, None, None, None)
        if above:
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
            above.waiting.append(row)
            if len(above.waiting) > MOST_KIDS:
                above.wide = True
                yield from above.waiting
                above.waiting = []
        else:
            yield row

    started = False
    for common, (key, _, conv, sizes, ends, below) in stream:
        while len(path) > common:
            yield from close(False)
        for u in range(len(path), len(key) // UNIT):
            unit = key[u * UNIT : (u + 1) * UNIT]
            parent = path[-1].name if path else b""
            path.append(_Node(name_of(parent, unit) if path else unit, parent, depth + u, sizes[u - 1] if u else 0, not started))
        started = True
        node = path[-1]
        node.joined(conv, 1)
        if ends:
            node.ends.append(conv)
        node.below = below or node.below
    while path:
        yield from close(True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_RUNS = pa.schema(
    [("part", pa.int32()), ("run", pa.int64()), ("place", pa.int64()), ("shared", pa.int32()), ("units", pa.binary()), ("conv", pa.int64()), ("sizes", pa.list_(pa.int64())), ("ends", pa.bool_()), ("below", pa.list_(pa.int64()))]
)


def _sorted_runs(bounds: list[tuple[bytes, int]], most: int):
    """A mapInArrow function from (conv, group, units, sizes, ends, below) to the entries of sorted runs, each with the range that it
    belongs to; the first entry of a run in a range is whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def entries() -> Iterator[tuple]:
            held, number = [], 0
            for batch in batches:
                for conv, group, units, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append((group + b"".join(units), conv, *rest))
                    if len(held) == most:
                        yield from written(held, task << 32 | number)
                        held, number = [], number + 1
            yield from written(held, task << 32 | number)

        def written(held: list[tuple], number: int) -> Iterator[tuple]:
            held.sort(key=lambda e: e[:2])
            before, range_before = b"", -1
            for place, (key, conv, sizes, ends, below) in enumerate(held):
                of = bisect_right(bounds, (key, conv))
                common = shared(before, key, 0) if of == range_before else 0
                yield (of, number, place, common, key[common * UNIT :], conv, sizes, ends, below)
                before, range_before = key, of

        yield from _batches(entries(), _RUNS)

    return run


def _merge_ranges(parts: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (e for batch in batches for e in zip(*(c.to_pylist() for c in batch.columns), strict=True))

        def rows() -> Iterator[tuple]:
            for part, of_part in groupby(entries, itemgetter(0)):
                runs = [[(units, common, *rest) for _, _, _, common, units, *rest in of_run] for _, of_run in groupby(of_part, itemgetter(1))]
                yield from finished(merged(runs), part, parts, depth)

        yield from _batches(rows(), _ARROW)

    return run


def _level(entries: DataFrame, depth: int, sizes: Sizes) -> DataFrame:
    """Nodes (columns of NODES) of a block of turns below a depth: entries are (conv, group, units, sizes, ends, below)."""
    spark = entries.sparkSession
    width = F.size("units") * (UNIT + 8) + 3 * UNIT
    n, size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    parts = max(1, min(MOST_RANGES, size // sizes.range_bytes + 1, n))
    if n > 64 * (cores := spark.sparkContext.defaultParallelism):
        parts = max(parts, cores)
    bounds: list[tuple[bytes, int]] = []
    if parts > 1:
        spread = 1 << 40
        sample = entries.filter(F.pmod(F.xxhash64("conv", F.lit(depth)), F.lit(spread)) < spread * SAMPLES_A_RANGE * parts // n)
        drawn = sorted((bytes(g) + b"".join(map(bytes, u)), c) for c, g, u in sample.select("conv", "group", "units").collect())
        bounds = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []
    parts = len(bounds) + 1
    runs = entries.select("conv", "group", "units", "sizes", "ends", "below").mapInArrow(
        _sorted_runs(bounds, sizes.run), "part int, run long, place long, shared int, units binary, conv long, sizes array<long>, ends boolean, below array<long>"
    )
    dealt = runs.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "run", "place")
    return cut(dealt.mapInArrow(_merge_ranges(parts, depth), NODES))


_PIECES = pa.schema([("name", pa.binary()), ("digest", pa.binary())])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each name of pieces that come in order, one after the other."""

    def rows() -> Iterator[tuple]:
        name, state = None, None
        for batch in batches:
            for piece_of, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if piece_of != name:
                    if state:
                        yield name, state.digest()
                    name, state = piece_of, hashlib.sha256(piece)
                else:
                    state.update(b"," + piece)
        if state:
            yield name, state.digest()

    yield from _batches(rows(), _PIECES)


def _whole(nodes: DataFrame) -> DataFrame:
    """Nodes that were finished within a range, and those put together from the parts of several: these lie on
    the paths at the bounds of ranges, so that there are at most so many as bounds times turns of a block."""
    columns = ["name", "parent", "depth", "conv", "parent_conv", "n", "children", "leaves", "saved", "ends", "wide"]
    parts = nodes.filter("part is not null")
    own = parts.groupBy("name").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("size").alias("size"), F.max("below").alias("below"), F.first("path").alias("path"),
    )
    below = [F.coalesce(F.col("below")[k], F.lit(0)) for k in range(3)]
    own = own.withColumns({"children": F.col("children") + below[0], "leaves": F.col("leaves") + below[1], "saved": F.col("saved") + below[2] + (F.col("n") - 1) * F.col("size")})
    kids = own.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("kids"))
    own = own.join(kids, "name", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0))).withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")))
    # a part's own leaves and savings count for all nodes on its path
    sums = own.select(F.explode(F.array_append("path", F.col("name"))).alias("name"), "leaves", "saved").groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    pieces = parts.filter("ends is not null").select("name", "part", "ends")
    digests = pieces.repartition("name").sortWithinPartitions("name", "part").select("name", "ends").mapInArrow(_hash_pieces, "name binary, digest binary")
    empty = F.unhex(F.lit(hashlib.sha256().hexdigest()))
    whole = own.drop("leaves", "saved").join(sums, "name").join(digests, "name", "left")
    whole = whole.withColumns({"ends": F.coalesce("digest", empty), "parent_conv": F.lit(None).cast("long"), "wide": F.lit(True)})
    return nodes.filter("part is null").select(*columns).unionByName(whole.select(*columns))


def digested(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, unit, size): the name of each turn and the bytes of its text. Null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.unhex(F.substring(named, 1, 2 * UNIT)).alias("unit"), F.octet_length(text).cast("long").alias("size")
    )


def placed(rows: DataFrame) -> DataFrame:
    """(conv, i, unit, size) of digested turns: i counts the turns of a conversation from 0, null turns first; of
    one turn that comes several times, those of lesser names come first. Rows are sorted by ranges, so that
    a conversation of any length is numbered by several tasks; only the first conversation of a range can have begun earlier."""
    spark = rows.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, before, i = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                i = i + 1 if conv == before else 0
                before = conv
                places.append(i)
            made = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made, batch.column(1), batch.column(2), pa.array([task] * len(places), pa.int32())], names=["conv", "i", "unit", "size", "task"])

    dealt = rows.repartitionByRange("conv", "turn", "unit").sortWithinPartitions("conv", "turn", "unit").select("conv", "unit", "size")
    numbered = cut(dealt.mapInArrow(number, "conv long, i long, unit binary, size long, task int"))
    # a range's last conversation goes on where the next range begins with it
    ends = numbered.groupBy("task").agg(F.min("conv").alias("first"), F.max_by("conv", F.struct("conv", "i")).alias("last"), F.max(F.struct("conv", "i"))["i"].alias("i")).orderBy("task").collect()
    starts, open_conv, so_far = {}, None, 0
    for row in ends:
        if row.first == open_conv:
            starts[row.task] = (row.first, so_far)
        so_far = row.i + 1 + (so_far if row.last == row.first == open_conv else 0)
        open_conv = row.last
    if not starts:
        return numbered.drop("task")
    add = F.broadcast(spark.createDataFrame([(t, c, n) for t, (c, n) in starts.items()], "task int, conv long, add long"))
    return numbered.join(add, ["task", "conv"], "left").select("conv", (F.col("i") + F.coalesce("add", F.lit(0))).alias("i"), "unit", "size")


def trie(rows: DataFrame, convs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """The nodes of the trie: conv_id (the least member), depth, parent_conv_id (of the root null), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    rows are (conv, i, unit, size), i from 0 in each conversation without gaps; convs has each conversation's conv
    once, also those without turns. Conversations are integers. Without any conversation there is no node.
    """
    bound_batches(rows.sparkSession)
    block = F.floor(F.col("i") / sizes.block).cast("int")
    blocks = rows.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "unit", "size"))).alias("t"))
    blocks = cut(blocks.select("conv", "block", F.col("t.unit").alias("units"), F.col("t.size").alias("sizes")))
    last = blocks.agg(F.max("block")).first()[0] or 0
    sharing, levels, chains = convs.select("conv", F.lit(ROOT).alias("group")), [], None
    for level in range(last + 1):
        here = sharing.join(blocks.filter(F.col("block") == level).drop("block"), "conv", "left")
        here = here.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in (("units", "array<binary>"), ("sizes", "array<long>"))})
        more = blocks.filter(F.col("block") == level + 1).select("conv", F.lit(True).alias("goes_on"))
        name = F.aggregate("units", F.col("group"), lambda parent, u: F.unhex(F.substring(F.sha2(F.concat(parent, u), 256), 1, 2 * UNIT)))
        here = here.join(more, "conv", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
        here = cut(here.withColumn("end", F.when(F.col("goes_on"), name)))
        groups = here.filter("goes_on").groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
        alone = cut(groups.filter("n = 1").select("conv", F.lit(True).alias("alone")))
        here = here.join(alone, "conv", "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
        levels.append(here)
        tail = here.filter("alone").select("conv", "end", F.lit((level + 1) * sizes.block).alias("start"))
        chains = tail if chains is None else chains.unionByName(tail)
        sharing = here.filter("goes_on and not alone").select("conv", F.col("end").alias("group"))
        if level == last or sharing.isEmpty():
            break
    nodes, below = _chain_nodes(rows, chains), None
    for level, here in reversed([*enumerate(levels)]):
        sums = F.when(F.col("alone"), F.array(*map(F.lit, (1, 1, 0))).cast("array<long>"))
        if below is not None:
            here = spread_join(here.withColumns(_halves("end")), below.withColumns(_halves("end")).drop("end"), ["_h0", "_h1"], "left")
            sums = F.coalesce(sums, "sums")
        here = here.select("conv", "group", "units", "sizes", (~F.col("goes_on")).alias("ends"), sums.alias("below"))
        made = cut(_whole(_level(here, level * sizes.block, sizes)))
        if level:  # the roots of a later block are the last nodes of the block before
            below = made.filter(F.col("depth") == level * sizes.block).select(F.col("name").alias("end"), F.array("children", "leaves", "saved").alias("sums"))
            made = made.filter(F.col("depth") > level * sizes.block)
        nodes = nodes.unionByName(made)
    return _named(nodes)


def _chain_nodes(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Nodes of the turns that follow where a conversation shares its prefix with no other: each has one member."""
    counts = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))
    tails = spread_join(rows.select("conv", "i"), chains.join(counts, "conv"), ["conv"]).filter("i >= start")
    last = F.col("i") == F.col("turns") - 1
    digest = F.unhex(F.sha2(F.when(last, F.col("conv").cast("string")).otherwise("").cast("binary"), 256))
    top = F.col("i") == F.col("start")
    one = F.lit(1).cast("long")
    return tails.select(
        F.lit(None).cast("binary").alias("name"), F.when(top, F.col("end")).alias("parent"), (F.col("i") + 1).alias("depth"), "conv", F.when(~top, F.col("conv")).alias("parent_conv"), one.alias("n"),
        F.when(last, 0).otherwise(1).cast("long").alias("children"), one.alias("leaves"), F.lit(0).cast("long").alias("saved"), digest.alias("ends"), F.lit(False).alias("wide"),
    )


def _named(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's least member, which those of wide parents and of parts don't know yet."""
    out = ["conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "ends"]
    left = nodes.filter("parent_conv is null and depth > 0").withColumns(_halves("parent"))
    wide = nodes.filter("wide").withColumns(_halves("name")).select("_h0", "_h1", F.col("conv").alias("wide_conv"))
    found = spread_join(left, wide, ["_h0", "_h1"], "left").withColumn("parent_conv", F.col("wide_conv"))
    rows = nodes.filter("parent_conv is not null or depth = 0").select(*out).unionByName(found.select(*out))
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.lower(F.hex("ends")).alias("ends_sha256"),
    )


def _halves(column: str) -> dict[str, Column]:
    """A name of 16 bytes as two integers."""
    halves = (F.conv(F.hex(F.substring(F.col(column), p, 8)), 16, -10).cast("long") for p in (1, 9))
    return dict(zip(("_h0", "_h1"), halves, strict=True))


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """The trie of the conversations as they are: one row per distinct sequence of first turns, columns as of trie().

    Turns go in the order of turn_col, null first; repeated ones in the order of their names. Null roles and texts
    count as empty, rows without an id belong to no conversation and are left out, and rows that repeat are turns of
    their own. Other columns are not read. An empty table gives an empty result.
    """
    rows = placed(cut(digested(turns, id_col, turn_col, role_col, text_col)))
    return trie(rows, rows.select("conv").distinct(), sizes)


def rebuilt(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) of placed turns where each conversation c begins with the first h turns of conversation
    c - c % group, h being crc32(c) % most, and goes on with its own turns after its first h."""
    head_of = F.col("conv") - F.col("conv") % group
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    heads = rows.filter((F.col("conv") == head_of) & (F.col("i") < most - 1)).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("i", "unit", "size"))).alias("head"))
    convs = rows.select("conv").distinct().withColumns({"base": head_of, "h": h}).join(heads, "base", "left")
    convs = cut(convs.select("conv", F.slice(F.coalesce("head", F.array().cast("array<struct<i: long, unit: binary, size: long>>")), F.lit(1), F.col("h").cast("int")).alias("head")))
    taken = convs.select("conv", F.inline("head"))
    shift = convs.select("conv", F.size("head").cast("long").alias("m"))
    own = spread_join(rows.filter(F.col("i") >= h), shift, ["conv"]).select("conv", (F.col("i") - h + F.col("m")).alias("i"), "unit", "size")
    return taken.unionByName(own), convs.select("conv")


def report(conversations: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """The trie of the conversations that rebuilt() makes of a table of conv_id, turn, role and text; cases as in prefix_trie()."""
    rows, convs = rebuilt(placed(cut(digested(conversations))))
    return trie(rows, convs, sizes)
