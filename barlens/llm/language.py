"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm import gru
from barlens.llm.common import BROADCAST_BYTES, cut, least_hashed, map_texts, remainder, semi

#: At most so many documents are learnt from, from each of them the whole text: as many of each language, those of
#: the least hashes of their ids. Their texts are all that reaches the driver.
MAX_TRAINING_ROWS = 2_000
UNDETERMINED = "und"
_letter = regex.compile(r"\p{L}").search


def sample(ids: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows of ids (id, lang), an equal share of each language, those of the least hashes. A cut of the
    hashes far above what is needed comes first, by the size of each language, so that a task ranks few rows."""
    counts = cut(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    n = max(counts.count(), 1)
    quota, spread = max(max_rows // n, 1), 1 << 30
    sizes = F.broadcast(counts) if n * 1024 < BROADCAST_BYTES else counts.hint("shuffle_merge")
    hashed = ids.join(sizes, "lang").withColumn("hash", F.pmod(F.xxhash64("id"), F.lit(spread)))
    few = hashed.filter((F.col("n") <= 8 * quota) | (F.col("hash") < F.lit(float(spread * 4 * quota)) / F.col("n")))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id")))
    return least_hashed(ranked.filter(F.col("rank") <= quota).select("id", "lang"), "id", max_rows)


class Model:
    """Weights and the learnt languages in order."""

    def __init__(self, weights: dict[str, np.ndarray] | None, languages: list[str]):
        self.weights, self.languages = weights, languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its probability; texts without a letter are
        undetermined, with 0. Only a document without a letter skips the network."""
        lettered = [i for i, t in enumerate(texts) if t and _letter(t)]
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if self.weights is None or not lettered:
            return names, scores
        p = gru.pooled(self.weights, [texts[i].encode() for i in lettered])
        for i, best, row in zip(lettered, p.argmax(axis=1), p, strict=True):
            names[i], scores[i] = self.languages[best], min(1.0, float(row[best]))
        return names, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Learns from the whole texts of at most max_rows documents with a language outside the held-out fold (crc32 of
    the id as text, modulo 5, is 0). Rows without an id, a language or a letter are not learnt from; of rows that
    repeat an id the least text and the greatest language count. Without any row, the model finds every text
    undetermined; with a single language it gives that one."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    usable = usable.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("id")) != 0))
    chosen = cut(sample(usable.groupBy("id").agg(F.max("lang").alias("lang")), max_rows))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    mine = semi(text, chosen.select("id"), "id", chosen.count()).groupBy("id").agg(F.min("text").alias("text"))
    rows = [r for r in mine.join(chosen, "id").orderBy("id").collect() if r["text"] and _letter(r["text"])]  # bounded by max_rows
    if not rows:
        return Model(None, [])
    languages = sorted({r["lang"] for r in rows})
    windows, lengths, owners = gru.windows_of([r["text"].encode() for r in rows])
    labels = np.array([languages.index(r["lang"]) for r in rows])[owners]
    return Model(gru.train(windows, lengths, labels, len(languages)), languages)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns one row per input row: the id column (of any type), lang_pred and score. Whole texts are read, and
    nothing else. A null text, or one without a letter, is und with score 0; null ids are passed on, rows that
    repeat have the same prediction, an empty table gives an empty one."""
    return map_texts(docs, id_col, text_col, lambda ids, texts: model.predict(texts), [("lang_pred", pa.string()), ("score", pa.float64())], rows=1024)


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; a null id is not held out."""
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
