"""Personal data by fixed patterns, and the words around it that would give it away (information-theoretic sanitisation).

Each value that a base pattern finds is a protected entity. Over the whole corpus it is counted in how many
documents a term stands near an entity, in how many it occurs at all, and in how many the entity does. The
pointwise mutual information of term and entity, as a share of the entity's information content, says how
much of the entity a reader of the term learns: PMI(e; t) = log2(n_et D / (n_e n_t)), IC(e) = log2(D / n_e).
Near the entity, terms from one share on are generalised, and from a greater one on removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import BROADCAST_BYTES, cut, map_texts, semi, spread_join

KINDS = ("email", "ip", "card", "phone")
#: Terms up to so many words away, of whatever length, stand near an entity.
NEAR_WORDS = 10
#: Shares of the information content from which terms are generalised and removed; characters of a word in
#: small letters that may tell something however it is written.
GENERALISE, REMOVE, LEAST_TERM = 0.9, 0.98, 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer
_digits = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_any_digit = re.compile(r"[0-9]").search
_terms = regex.compile(r"[\p{L}\p{N}]+").finditer


def _emails(t: str) -> list[tuple[int, int]]:
    """Looks left and right of each @, so that long runs without one take no time."""
    out, last = [], 0
    at = t.find("@")
    while at >= 0:
        end = at + 1
        if m := _domain(t, at + 1):
            start = at
            while start > last and t[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = end = m.end()
                out.append((start, end))
        at = t.find("@", end)
    return out


def _ips(t: str) -> list[tuple[int, int]]:
    """Four parts at a time of each run of numbers and dots."""
    out = []
    for m in _dotted(t):
        parts = m[0].split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in four):
                out.append((start, end))
            start = end + 1
    return out


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def _cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _digits(t):
        if m.end() - m.start() >= 13:
            bare = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(bare) <= 19 and _luhn(bare):
                out.append(m.span())
    return out


def _phones(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _phone(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each kind, leftmost and without overlaps within a kind."""
    t = text or ""
    numbers = bool(_any_digit(t))
    return {
        "email": _emails(t),
        "ip": _ips(t) if numbers else [],
        "card": _cards(t) if numbers else [],
        "phone": _phones(t) if numbers and "+" in t else [],
    }


def entity(kind: str, value: str) -> str:
    """What makes two values the same entity: case of an address and punctuation of a number don't count."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def _named(word: str) -> bool:
    """Not one of the short words in small letters, which are those of grammar ("to", "by"): names, codes and words
    of scripts without case may be as short as they like."""
    return len(word) >= LEAST_TERM or not (word.isalpha() and word.islower())


def near(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """The terms near each span, with their places and whether they are written as such: whole words of the text, but
    for those that share a character with any span. Linear in the text and in the spans."""
    words = [m.span() for m in _terms(text)]
    starts = [a for a, _ in words]
    free = [True] * len(words)
    at = 0
    for start, end in sorted(s for found in spans.values() for s in found):
        at = max(at, bisect_left(starts, start) - 1, 0)
        while at < len(words) and words[at][0] < end:
            free[at] = free[at] and words[at][1] <= start
            at += 1
    out = []
    for kind, found in spans.items():
        for start, end in found:
            name, left, right = entity(kind, text[start:end]), bisect_left(starts, start), bisect_left(starts, end)
            for i in (*range(max(left - NEAR_WORDS, 0), left), *range(right, min(right + NEAR_WORDS, len(words)))):
                if free[i]:
                    a, b = words[i]
                    word = text[a:b]
                    out.append({"entity": name, "term": word.lower(), "named": _named(word), "start": a, "stop": b})
    return out


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(ids: list, texts: list) -> tuple[list, list, list]:
        every = [base_spans(t) for t in texts]
        spans = [[{"kind": k, "start": a, "stop": b} for k, found in s.items() for a, b in found] for s in every]
        names = [sorted({entity(k, t[a:b]) for k, found in s.items() for a, b in found}) for t, s in zip(texts, every, strict=True)]
        return spans, names, [near(t, s) if any(s.values()) else [] for t, s in zip(texts, every, strict=True)]

    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    term = pa.struct([("entity", pa.string()), ("term", pa.string()), ("named", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32())])
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [("base", pa.list_(span)), ("entities", pa.list_(pa.string())), ("near", pa.list_(term))]
    return map_texts(frame, "doc_id", "text", run, fields).withColumn("row", F.monotonically_increasing_id())


def disclosures(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, n_et, n_e, n_t, share): the pairs whose share of the entity's information reaches GENERALISE.
    All counts are of documents, over the whole corpus; a pair of a single document counts like any other. A pair
    of a short word counts where one of its documents has it written as a name or code."""
    total = F.lit(float(max(docs.count(), 1)))
    pairs = cut(found.select("row", F.inline("near")).groupBy("row", "entity", "term").agg(F.max("named").alias("named")))
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.max("named").alias("named")).filter("named").drop("named")
    # documents that hold the bare value count too
    of_entity = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    # a term occurs at least as often as it stands near any entity: that bounds what it can tell of one, and
    # leaves out words that are common near many, before terms are counted over whole texts
    near_any = pairs.select("row", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    information = F.log2(total / F.col("n_e"))

    def share(n_t: Column) -> Column:
        return F.when(information > 0, F.log2(F.col("n_et") * total / (F.col("n_e") * n_t)) / information)

    def keyed(frame: DataFrame, name: str) -> DataFrame:
        return frame.withColumns({"k1": F.xxhash64(F.col(name)), "k2": F.xxhash64(F.col(name), F.lit(1))})

    # an entity may have very many terms, and a term stand near very many entities
    possible = spread_join(keyed(together, "entity"), keyed(of_entity, "entity").drop("entity"), ["k1", "k2"]).drop("k1", "k2")
    possible = spread_join(keyed(possible, "term"), keyed(near_any, "term").drop("term"), ["k1", "k2"]).drop("k1", "k2")
    possible = possible.withColumn("n_least", F.greatest("n_near", "n_et"))
    possible = cut(possible.filter(share(F.col("n_least")) >= GENERALISE))
    terms = cut(possible.select("term").distinct())
    words = docs.select(
        F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("term")
    )
    if terms.count() * 64 < BROADCAST_BYTES:
        counted = words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    else:  # counted within each task before anything is shuffled
        counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(terms, "term", "left_semi")
    both = possible.join(counted, "term", "left").withColumn("n_t", F.greatest("n_t", "n_least"))
    return both.withColumn("share", share(F.col("n_t"))).filter(F.col("share") >= GENERALISE)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns one row per input row: row (a number of this row), the id column, base (array of kind, start and
    stop) and terms (likewise, of the kinds generalise and remove).

    Places are code points of the whole text, stop exclusive. Null and empty texts have none. Null ids are
    passed on; rows that repeat are documents of their own and count as such. An empty table gives an empty
    result. Ids may be of any type. Other columns are not read.
    """
    found = cut(_found(docs, id_col, text_col))
    pairs = cut(disclosures(found, docs, text_col))
    keys = (F.xxhash64("entity", "term").alias("k1"), F.xxhash64("term", "entity").alias("k2"))
    places = found.select("row", F.inline("near")).select("row", "start", "stop", *keys)
    telling = spread_join(places, pairs.select("share", *keys), ["k1", "k2"])
    action = F.when(F.max("share") >= REMOVE, "remove").otherwise("generalise")
    per_place = telling.groupBy("row", "start", "stop").agg(action.alias("kind"))
    per_row = per_place.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("terms"))
    out = found.select("row", "doc_id", "base").join(per_row, "row", "left")
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    return out.select("row", F.col("doc_id").alias(id_col), "base", F.coalesce("terms", none).alias("terms"))


def _joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of spans(): counts and digest of the base, and all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans(docs).select(
        "doc_id", *(count(k) for k in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "terms")).alias("spans"),
    )


def sanitise_text(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with base spans replaced by their kind in brackets, generalised terms by [term], and removed ones dropped."""
    out, at = [], 0
    for kind, start, stop in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], {"remove": "", "generalise": "[term]"}.get(kind, f"[{kind}]")]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and the sanitised text of each row that has spans. Ids must be unique for this; rows
    without an id are left out."""
    have = cut(spans(docs, id_col, text_col).filter((F.size("base") > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.concat("base", "terms").alias("spans")))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    mine = semi(text, have.select("id"), "id", have.count()).join(have, "id").select("id", "text", "spans")

    def run(batches):
        for batch in batches:
            texts, every = (batch.column(i).to_pylist() for i in (1, 2))
            clean = [sanitise_text(t or "", [(s["kind"], s["start"], s["stop"]) for s in found]) for t, found in zip(texts, every, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], ["id", "text"])

    out = mine.mapInArrow(run, mine.drop("spans").schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
