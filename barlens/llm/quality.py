"""A quality classifier: gradient-boosted trees over statistics of a document's text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import bound_batches, cut, least_hashed, map_texts, remainder, semi
from barlens.llm.trees import Forest, fit

#: At most so many labelled rows are learnt from, those of the least hashes of their ids.
MAX_TRAINING_ROWS = 20_000
#: Scores from here on are label 1.
THRESHOLD = 0.3

CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".",
    "pause": b",;:",
    "cry": b"!?",
    "bracket": b"()[]{}<>\"'`",
    "bar": b"|/\\_-=+~",
    "symbol": b"#$%&*@^",
    "high": bytes(range(128, 256)),
}
FEATURES = (*CLASSES, "log_bytes", "log_words", "word_bytes", "word_deviation", "short_words", "long_words", "distinct_words", "distinct_triples", "log_lines", "distinct_lines", "line_words", "entropy", "sentence_ends", "last_stop", "commonest_word")

_OF_CLASS = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES.values()):
    _OF_CLASS[list(_members), _i] = 1


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text; those of an empty or null text are zero."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    shares = counts @ _OF_CLASS / n
    seen = counts[counts > 0] / n
    words = data.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    triples = max(len(words) - 2, 1)
    of_word: dict[bytes, int] = {}
    for w in words:
        of_word[w] = of_word.get(w, 0) + 1
    return [
        *shares.tolist(),
        np.log1p(n),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        len(of_word) / m,
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples,
        np.log1p(len(lines)),
        len(set(lines)) / max(len(lines), 1),
        len(words) / max(len(lines), 1),
        float(-(seen * np.log2(seen)).sum()),
        data.count(b". ") / m,
        float(data.rstrip().endswith(b".")),
        max(of_word.values(), default=0) / m,
    ]


def _statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(frame, "doc_id", "text", lambda ids, texts: ([statistics(t) for t in texts],), [("x", pa.list_(pa.float64()))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Forest:
    """Fits on at most max_rows labelled documents outside the held-out fold (crc32 of the id as text,
    modulo 5, is 0). Rows without an id or a label are not learnt from; an id with several labels counts
    with the greatest, and of rows that repeat an id the one of least statistics. Without any labelled document the forest gives one half to every text."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("id")) != 0))
    chosen = usable.groupBy("id").agg(F.max("label").alias("label"))
    chosen = cut(least_hashed(chosen, "id", max_rows))
    n = chosen.count()
    mine = semi(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chosen.select("id"), "id", n)
    one = _statistics(mine, "id", "text").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = one.join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "x", "label")
    found = rows.orderBy("doc_id").toPandas()  # bounded by max_rows
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, found["label"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns one row per input row: the id column and score, from 0 to 1. Only the text is looked at; null
    counts as empty and is scored as such. Null ids are passed on, repeated rows score alike."""
    def run(ids: list, texts: list) -> tuple[np.ndarray]:
        return (forest.scores(np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))),)

    return map_texts(docs, id_col, text_col, run, [("score", pa.float64())])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of each row; a null id is not held out."""
    scored = score(docs, train(docs, labels, id_col), id_col)
    return scored.select(
        id_col,
        F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with all their columns. The score is put beside each
    row in the scan itself: there is no join, and rows that repeat an id are judged each by its own text.
    A null text counts as empty; rows without an id are judged like others; an empty table stays empty."""
    forest = train(docs, labels, id_col, text_col)
    bound_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            good = np.zeros(len(texts), bool)
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                x = np.array([statistics(t) for t in part], float).reshape(len(part), len(FEATURES))
                good[i : i + 512] = forest.scores(x) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.select(*names).mapInArrow(run, docs.schema)
