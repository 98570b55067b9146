"""Secret scans: fixed patterns, and a conditional random field that tags what they don't cover.

The field is taught on whole texts, in which the values that the patterns find are secrets. As these alone would
teach it the patterns again, made-up passages are put between the words of these texts: secrets behind names,
signs and in forms that no pattern has, and beside them as many harmless passages that look alike (versions, dates,
UUIDs, file names, calls, names of secrets without one).
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm import crf
from barlens.llm.common import cut, least_hashed, map_texts, semi

KINDS = ("assign", "access", "hex", "crf")
#: The field is taught on the whole texts of at most so many documents with and as many without base spans, those of the
#: least hashes of their ids, in sequences of so many tokens that cover them; each half is of so many bytes at most, and an
#: id that repeats gives one text.
MAX_TRAINING_ROWS, TRAINING_TOKENS, MAX_TRAINING_BYTES = 1_000, 48, 16 << 20
#: One made-up passage is put in for so many words of a text, and one more.
WORDS_A_PASSAGE = 120
#: So large a share of made-up secrets stand behind a word that names none.
UNNAMED = 0.15
#: So many tokens are decoded at once, or one text that has more.
DECODED_TOKENS = 1 << 16
#: Words are told apart by so many hashes; further than so many tokens back a word is not looked for.
N_WORDS, REACH = 1 << 12, 4

_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII).finditer
_access = re.compile(r"AKIA[A-Z0-9]+").finditer
_hex = re.compile(r"[0-9a-f]{24,}").finditer
_token = re.compile(r"\w+|[^\w\s]")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches by start, then kind; code points, end exclusive."""
    t = text or ""
    lower = t.lower()
    out = []
    if any(k in lower for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _assign(t) if len(m[1]) >= 6]
    if "AKIA" in t:
        out += [("access", *m.span()) for m in _access(t) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _hex(t)]  # shorter runs of these digits would be dropped
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Token classes: 0 beyond the ends, then punctuation, words that name secrets, and shapes by length.
_PUNCTUATION = {"=": 1, ":": 2, '"': 3, "'": 3, "+": 4, "/": 5, "-": 6, ".": 7}
_OTHER_MARK, _NAMING, _FIRST_SHAPE = 8, 9, 10
_NAMES = frozenset((*_KEYWORDS, "pwd", "pass", "key", "auth", "bearer", "credential", "credentials", "access", "private", "api"))
_LENGTHS = (2, 4, 6, 9, 13, 17, 20, 24, 32, 40)
_SHAPES = tuple(
    re.compile(p, re.ASCII).fullmatch
    for p in ("[a-z]+", "[A-Z][a-z]+", "[A-Z]+", "[A-Za-z]+", "[0-9]+", "[0-9a-f]+", "[A-Z0-9]+", "[a-z0-9]+", "[A-Za-z0-9]+", "[A-Za-z0-9_]+")
)
N_CLASSES = _FIRST_SHAPE + (len(_SHAPES) + 1) * (len(_LENGTHS) + 1)
N_FILES = 8


def _kind(c: int) -> int:
    """Beyond an end, a mark, a naming word, letters only, digits only, or both: short, middling, long."""
    if c < _FIRST_SHAPE:
        return 0 if c == 0 else 2 if c == _NAMING else 1
    shape, length = divmod(c - _FIRST_SHAPE, len(_LENGTHS) + 1)
    return 3 if shape < 4 or shape == len(_SHAPES) else 4 if shape == 4 else 5 + (length >= 3) + (length >= 5)


KINDS_OF_CLASSES = np.array([_kind(c) for c in range(N_CLASSES)])


def token_class(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return _PUNCTUATION.get(token, _OTHER_MARK)
    if token.lower() in _NAMES:
        return _NAMING
    shape = next((i for i, match in enumerate(_SHAPES) if match(token)), len(_SHAPES))
    return _FIRST_SHAPE + shape * (len(_LENGTHS) + 1) + sum(len(token) >= n for n in _LENGTHS)


_last_part_reversed = re.compile(r"[a-z]+[A-Z]?|[A-Z]+|[^\W\d_a-zA-Z]+").match


def word_hash(token: str) -> int:
    """Of the last word of a token, so that db_password and dbPassword are as password; 0 where it does not end in letters."""
    found = _last_part_reversed(token[::-1])  # from its end, so that a token of any length is read once
    return 1 + zlib.crc32(found[0][::-1].lower().encode()) % (N_WORDS - 1) if found else 0


class _Codes(dict):
    """Class and word of tokens seen, forgotten when there are too many."""

    def __missing__(self, token: str) -> int:
        found = token_class(token) | word_hash(token) << 8
        if len(token) <= 32:
            if len(self) >= 300_000:
                self.clear()
            self[token] = found
        return found


_codes = _Codes()


def features_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The class of each token, and (2, tokens) the last word up to REACH tokens before it and the word right behind it."""
    codes = np.fromiter(map(_codes.__getitem__, tokens), np.int32, len(tokens))
    words = codes >> 8
    places = np.arange(len(tokens))
    last = np.maximum.accumulate(np.where(words > 0, places, -REACH - 1))
    last = np.concatenate([[-REACH - 1], last])[:-1]
    before = np.where(places - last <= REACH, words[np.maximum(last, 0)], 0)
    return (codes & 255).astype(np.int16), np.stack([before, np.concatenate([words, [0]])[1:]]).astype(np.int16)


def file_class(classes: np.ndarray) -> int:
    """How many of a file's tokens hold digits among other characters, and whether it assigns anything."""
    n = max(len(classes), 1)
    mixed = ((classes >= _FIRST_SHAPE + 4 * (len(_LENGTHS) + 1)).sum()) / n
    level = int(mixed > 0) + int(mixed > 0.01) + int(mixed > 0.05)
    return level * 2 + int(((classes == 1) | (classes == 2)).any())


# Names of secrets in some languages, what stands between name and value, and harmless names.
SECRET_NAMES = (
    "password", "passphrase", "passcode", "passwd", "pwd", "pass", "pw", "secret", "client secret", "client_secret", "token", "access token", "auth token", "refresh_token", "bearer", "credential",
    "credentials", "api key", "apikey", "api_key", "access key", "access_key", "secret_access_key", "private key", "signing key", "encryption_key", "login", "pin", "otp", "auth", "authorization",
    "session key", "cookie", "webhook secret", "license key", "db_password", "dbPassword", "userPass", "Kennwort", "Passwort", "Zugangscode", "Geheimnis", "mot de passe", "clave", "contraseña", "jeton",
)
SIGNS = (": ", " = ", "=", " := ", ":", " => ", " is ", ' = "', ": '", '="', " -> ")
HARMLESS_NAMES = ("version", "date", "id", "name", "size", "file", "page", "color", "status", "count", "path", "host", "port", "user", "title", "ref", "order", "model", "build", "key", "table", "value", "time", "level")
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX = "0123456789abcdef"


#: Behind a name of secrets and a sign, a value that mixes letters and digits is taken for one where the field learns.
_likely = re.compile(r"(?i:" + "|".join(re.escape(n) for n in sorted(SECRET_NAMES, key=len, reverse=True)) + r""")["']?\x20?(?::=|=>|->|[:=])\x20?["']?(?=[^\s\d]*\d)(?=[^\sA-Za-z]*[A-Za-z])([^\s"']{6,})""").finditer


def _value(rnd: random.Random) -> str:
    """A made-up secret in one of some forms."""
    def some(letters: str, least: int, most: int) -> str:
        return "".join(rnd.choices(letters, k=rnd.randint(least, most)))

    form = rnd.randrange(8)
    if form == 0:  # a prefix that names the service
        return f"{some('abcdefghijklmnopqrstuvwxyz', 2, 4)}_{rnd.choice(['', 'live_', 'test_'])}{some(_ALNUM, 16, 40)}"
    if form == 1:  # base64
        return some(_ALNUM + "+/", 20, 44) + rnd.choice(["", "=", "=="])
    if form == 2:  # hexadecimal, of other lengths or letters than the pattern's
        return some(_HEX, 10, 23) if rnd.random() < 0.5 else some(_HEX, 16, 40).upper()
    if form == 3:  # three parts, as of a web token
        return f"eyJ{some(_ALNUM, 12, 30)}.eyJ{some(_ALNUM, 12, 40)}.{some(_ALNUM + '_-', 20, 40)}"
    if form == 4:  # a word with digits and a mark
        return some("abcdefghijklmnopqrstuvwxyz", 4, 8).capitalize() + some("0123456789", 2, 4) + rnd.choice(["", "!", "#", "$"])
    if form == 5:  # groups
        return "-".join(some(_ALNUM[:26] + "0123456789", 4, 5) for _ in range(rnd.randint(3, 5)))
    if form == 6:  # pieces between marks
        return rnd.choice("-._&@!%").join(some(_ALNUM, 1, 12) for _ in range(rnd.randint(2, 4))) + some("0123456789", 1, 2)
    return some(_ALNUM, 8, 40)


def passage(rnd: random.Random) -> tuple[str, int, int]:
    """A made-up passage and the place of the secret in it; an empty place where it is harmless."""
    def digits(n: int) -> str:
        return "".join(rnd.choices("0123456789", k=n))

    name, sign = rnd.choice(SECRET_NAMES), rnd.choice(SIGNS)
    unnamed = rnd.random() < UNNAMED  # behind a word that says nothing: by its form alone
    name = rnd.choice([name, name.upper(), name.capitalize(), rnd.choice(["my_", "the ", "your ", "app."]) + name])
    if rnd.random() < 0.5:
        if unnamed:
            name = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9)))
        before, value = name + sign, _value(rnd)
        return before + value + (sign[-1] if sign[-1] in "'\"" else ""), len(before), len(before) + len(value)
    other = rnd.choice(HARMLESS_NAMES)
    kind = rnd.randrange(9)
    if kind == 0:
        text = f"{name}{sign.rstrip()} {rnd.choice(['required', 'none', 'null', 'changed', 'expired', 'missing', 'optional', 'true', 'hidden'])}"
    elif kind == 1:
        text = f"{other}{sign}{'-'.join(''.join(rnd.choices(_HEX, k=k)) for k in (8, 4, 4, 4, 12))}"
    elif kind == 2:
        text = f"{other}{sign}{rnd.randint(0, 20)}.{rnd.randint(0, 30)}.{rnd.randint(0, 99)}"
    elif kind == 3:
        text = f"{other}{sign}20{digits(2)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}"
    elif kind == 4:
        text = f"{other}{sign}{''.join(rnd.choices('abcdefghijklmnopqrstuvwxyz', k=rnd.randint(4, 10)))}_{digits(rnd.randint(2, 8))}.{rnd.choice(['txt', 'png', 'tar', 'json', 'py'])}"
    elif kind == 5:
        text = f"{name}{sign.rstrip()} get{name.title().replace(' ', '')}({other})"
    elif kind == 6:
        text = f"{other}{sign}{digits(rnd.randint(1, 16))}"
    elif kind == 7:
        text = f"{other}{sign}{''.join(rnd.choices(_ALNUM[:26], k=2))}-{digits(rnd.randint(3, 6))}"
    else:
        text = f"{other}{sign}#{''.join(rnd.choices(_HEX, k=6))}"
    return text, 0, 0


def taught(text: str | None) -> tuple[bytes, bytes, bytes, int]:
    """What the field learns from a whole text with made-up passages between its words: the classes of its tokens,
    their words and their labels (packed), and the class of the file. Tokens in a base span, in the secret of a passage or
    in what stands like one behind a name of secrets are secrets, but for the name and the marks before the value."""
    t = text or ""
    rnd = random.Random(zlib.crc32(t.encode()))
    gaps = [m.start() for m in re.finditer(r"\s", t)]
    places = sorted(rnd.choices(gaps, k=1 + len(gaps) // WORDS_A_PASSAGE)) if gaps else [len(t)] if t else []
    parts, secret, at, length = [], [], 0, 0
    for place in places:
        words, a, b = passage(rnd)
        parts += [t[at:place], " ", words, " "]
        length += place - at + 1
        if b > a:
            secret.append((length + a, length + b))
        length, at = length + len(words) + 1, place
    t = "".join([*parts, t[at:]])
    secret += [m.span(1) for m in _likely(t)]
    values = {m.span(): m.start(1) for m in _assign(t)}
    secret += [(values[a, b] if kind == "assign" else a, b) for kind, a, b in base_spans(t)]
    tokens = list(_token.finditer(t))
    classes, words = features_of([m[0] for m in tokens])
    starts = np.fromiter((m.start() for m in tokens), np.int64, len(tokens))
    labels = np.zeros(len(tokens), np.int8)
    for a, b in sorted(secret):
        first, last = np.searchsorted(starts, (a, b))
        if first < last and not labels[first:last].any():
            labels[first:last] = crf.INSIDE
            labels[first] = crf.BEGIN
    return classes.tobytes(), words.tobytes(), labels.tobytes(), file_class(classes)


def sequences(rows: list[tuple[bytes, bytes, bytes, int]]) -> tuple[np.ndarray, ...]:
    """classes, words, files and labels of sequences of TRAINING_TOKENS that cover the rows (as taught() gives them)."""
    classes, words, files, labels = [], [], [], []
    for packed, packed_words, packed_labels, file in rows:
        own, label = np.frombuffer(packed, np.int16), np.frombuffer(packed_labels, np.int8)
        n, count = len(own), -(-len(own) // TRAINING_TOKENS)
        if not n:
            continue
        fill = count * TRAINING_TOKENS - n
        padded = np.concatenate([[0, 0], own, np.zeros(fill + 1, np.int16)]).astype(np.int16)
        classes.append(np.lib.stride_tricks.sliding_window_view(padded, TRAINING_TOKENS + 3)[::TRAINING_TOKENS])
        words.append(np.pad(np.frombuffer(packed_words, np.int16).reshape(2, n), ((0, 0), (0, fill))).reshape(2, count, TRAINING_TOKENS))
        labels.append(np.pad(label, (0, fill), constant_values=-1).reshape(count, TRAINING_TOKENS))
        files += [file] * count
    return np.concatenate(classes), np.concatenate(words, axis=1), np.array(files), np.concatenate(labels)


def _sample(told: DataFrame, max_rows: int) -> DataFrame:
    """(id): of (id, size) at most so many ids of least hashes, of MAX_TRAINING_BYTES together; longer texts are passed over."""
    chosen = least_hashed(told.filter(F.col("size") <= MAX_TRAINING_BYTES), "id", max_rows)
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id"))  # of at most max_rows rows
    return chosen.withColumn("so_far", so_far).filter(F.col("so_far") <= MAX_TRAINING_BYTES).select("id")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> crf.Weights | None:
    """Teaches the field on the whole texts of at most max_rows documents that look like having base spans and as
    many others, with made-up passages in all of them, so that it learns what secrets look like where no document has a
    base span as well. Rows without an id are not learnt from. None if there is no text to learn from."""
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # names are looked for as plain strings first, which is much faster than an expression
    lower = F.lower("text")
    named = reduce(or_, (lower.contains(k) for k in _KEYWORDS)) & F.col("text").rlike(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""")
    hit = named | (F.col("text").contains("AKIA") & F.col("text").rlike("AKIA[A-Z0-9]{16}")) | F.col("text").rlike("[0-9a-f]{24}")
    told = cut(text.filter("id is not null").groupBy("id").agg(F.max(hit.cast("int")).alias("hit"), F.max(F.octet_length("text")).alias("size")))
    chosen = cut(_sample(told.filter("hit = 1"), max_rows).unionByName(_sample(told.filter("hit = 0"), max_rows)))
    some = semi(text, chosen, "id", chosen.count()).groupBy("id").agg(F.max("text").alias("text"))
    fields = [("classes", pa.binary()), ("words", pa.binary()), ("labels", pa.binary()), ("file", pa.int8())]
    found = map_texts(some, "id", "text", lambda ids, texts: zip(*map(taught, texts), strict=True), fields)
    # one row for each of at most 2 max_rows ids, seven bytes a token of 2 MAX_TRAINING_BYTES of text
    rows = sorted((bytes(r["classes"]), bytes(r["words"]), bytes(r["labels"]), r["file"]) for r in found.drop("id").collect())
    rows = [r for r in rows if r[0]]
    if not rows:
        return None
    classes, words, files, labels = sequences(rows)
    return crf.train(classes, words, files, labels, KINDS_OF_CLASSES, N_FILES, N_WORDS)


def tagged_all(texts: list[str | None], weights: crf.Weights | None) -> list[list[tuple[int, int]]]:
    """Spans of the runs of tokens that the field tags as secrets in each of some whole texts, which are decoded together,
    about DECODED_TOKENS at once."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if weights is None:
        return out
    places, emissions, n = [], [], 0

    def decoded() -> None:
        starts = np.cumsum([0, *map(len, emissions)])
        labels = crf.decode(weights, emissions[0]) if len(emissions) == 1 else crf.decode(weights, np.concatenate(emissions), starts[:-1])
        for i, a, b in zip(places, starts[:-1], starts[1:], strict=True):
            if labels[a:b].any():
                out[i] = _spans_of(texts[i], labels[a:b])

    for i, text in enumerate(texts):
        if not (tokens := _token.findall(text or "")):
            continue
        classes, words = features_of(tokens)
        places.append(i)
        emissions.append(weights.emissions(classes, words, file_class(classes)))
        n += len(tokens)
        if n >= DECODED_TOKENS:
            decoded()
            places, emissions, n = [], [], 0
    if places:
        decoded()
    return out


def tagged(text: str | None, weights: crf.Weights | None) -> list[tuple[int, int]]:
    """tagged_all() of one text."""
    return tagged_all([text], weights)[0]


def _spans_of(text: str, labels: np.ndarray) -> list[tuple[int, int]]:
    spans = [m.span() for m in _token.finditer(text)]
    out: list[tuple[int, int]] = []
    before = -2
    for i in np.flatnonzero(labels).tolist():
        a, b = spans[i]
        if out and i == before + 1 and labels[i] == crf.INSIDE and not text[out[-1][1] : a].strip():
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        before = i
    return [(a, b) for a, b in out if any(map(str.isalnum, text[a:b]))]  # marks alone hold nothing


def all_spans(text: str | None, weights: crf.Weights | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and the spans of the field that share no character with any of them."""
    return _apart(base_spans(text), tagged(text, weights))


def _apart(base: list[tuple[str, int, int]], found: list[tuple[int, int]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    joined: list[list[int]] = []  # the base by start, without overlaps
    for _, a, b in base:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    starts, ends = [a for a, _ in joined], [0, *(b for _, b in joined)]
    return base, [("crf", a, b) for a, b in found if ends[bisect_right(starts, b - 1)] <= a]


def spans(docs: DataFrame, weights: crf.Weights | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns one row per input row: the id column, base and added (arrays of kind, start and stop).

    Whole texts are read; null and empty ones have no spans. Null ids are passed on, rows that repeat give
    the same spans, an empty table gives an empty one; other columns are not read. Ids may be of any type.
    """
    def run(ids: list, texts: list) -> tuple[list, list]:
        found = [_apart(base_spans(t), more) for t, more in zip(texts, tagged_all(texts, weights), strict=True)]
        as_rows = lambda spans: [{"kind": k, "start": a, "stop": b} for k, a, b in spans]
        return [as_rows(base) for base, _ in found], [as_rows(more) for _, more in found]

    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    return map_texts(docs, id_col, text_col, run, [("base", pa.list_(span)), ("added", pa.list_(span))])


def _joined(column: Column) -> Column:
    """By start, then kind as listed."""
    keyed = F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("o"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of spans() with a field taught on docs."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans(docs, train(docs)).select(
        "doc_id", *(count(k) for k in KINDS[:3]),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )
