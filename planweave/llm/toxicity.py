"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained in numpy.

Every word contributes its character n-grams (3 to 5 bytes of UTF-8, with the word's
ends marked by a space) and the word itself. Each feature is hashed to a row of an
embedding table; a window of words is the mean of its features' rows, and a linear
softmax maps the mean to two classes. Table and softmax are trained together, so a
misspelling or an inflection never seen shares rows with what was seen. A document is
as toxic as its most toxic window: the score is the softmax of the largest window
logit, which keeps one insult in a long text visible.

Two priors stand for evidence that is missing. A mean includes ``PRIOR`` features without
any, which matters to windows of a few words. A row counts ``c / (c + RARE)`` of its
value, ``c`` the training documents that have the feature: what one document says is no
rule yet, but no feature is left out. A word said c times in a row weighs 1 + ln c.

Because the softmax is linear, a feature adds ``E[g] . (w1 - w0)`` to its window's
logit; scoring therefore needs one float per row, and the exact gradient of the table
is an outer product of a per-row count vector and ``w1 - w0``. Both are plain numpy
gathers and ``bincount``s; the whole text is used, in blocks of words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, materialize, small_batches, trimmed

BITS = 20
GRAMS = (3, 4, 5)
WINDOW = 8  # words, repeats in a row being one; what is left at the end of a text belongs to the window before
PRIOR, RARE = 30.0, 6.0
PRIME = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32
BLOCK = 1 << 17  # bytes taken at once
HELD = 128 << 20  # bytes of training features kept between epochs; others are made again


@dataclass
class Model:
    """``rows``: logit of each hashed feature; ``bias``: the softmax's."""

    rows: np.ndarray
    bias: float


def _spaced(text: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """UTF-8 bytes of the words, ASCII lower case, a space before and after each, those said
    several times in a row once; and the weight of each word's bytes (None: all 1)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint8), None
    weights = None
    again = np.fromiter(map(eq, words, islice(words, 1, None)), bool, len(words) - 1)
    if again.any():
        first = np.flatnonzero(np.append(True, ~again))
        times = np.diff(first, append=len(words))
        words = [words[i] for i in first.tolist()]
        weights = np.repeat(np.append(1 + np.log(times), 1).astype(np.float32), [*(len(w) + 1 for w in words), 1])
    return np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8), weights


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    odd = 0x100000001B3
    n = 2 * BLOCK
    return np.cumprod(np.full(n, odd, np.uint64)), np.cumprod(np.full(n, pow(odd, -1, 1 << 64), np.uint64))


def _features(raw: np.ndarray):
    """For each kind of feature: hashed rows by starting byte, and which are features.
    A gram starts at a byte of its word or at the space before it; a space inside it
    would join two words. Whole words start at the space before them."""
    space = raw == SPACE
    wide = raw.astype(np.uint32)
    n = len(raw)
    h, inner = wide.copy(), np.zeros(n, bool)
    for size in range(2, GRAMS[-1] + 1):
        m = n - size + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193)
        h ^= wide[size - 1 :]
        inner = inner[:m]
        if size > 2:
            inner = inner | space[size - 2 : size - 2 + m]
        if size in GRAMS:
            yield ((h ^ np.uint32(size)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), ~inner
    # Whole words: differences of a prefix sum of byte * power, brought to a common power.
    marks = np.flatnonzero(space)
    power, back = (_powers() if n <= 2 * BLOCK else tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (0x100000001B3, pow(0x100000001B3, -1, 1 << 64))))
    sums = np.cumsum(wide * power[:n])
    whole = (sums[marks[1:]] - sums[marks[:-1]]) * back[marks[:-1]]
    rows, is_word = np.zeros(n, np.uint32), np.zeros(n, bool)
    rows[marks[:-1]] = ((whole + np.uint64(7)) * PRIME) >> np.uint64(64 - BITS)
    is_word[marks[:-1]] = True
    yield rows, is_word


def _windows(raw: np.ndarray) -> np.ndarray:
    """First byte of every window of words."""
    marks = np.flatnonzero(raw == SPACE)
    starts = marks[:-1:WINDOW]
    return starts[:-1] if len(starts) > 1 and (len(marks) - 1) % WINDOW else starts


def _blocks(text: str | None, size: int = BLOCK):
    """(bytes, weights) of pieces that end at a space after whole windows of words; all of the text."""
    raw, weights = _spaced(text)
    if len(raw) <= size:
        if len(raw):
            yield raw, weights
        return
    spaces = np.flatnonzero(raw == SPACE)
    first = 0
    while first < len(spaces) - 1:
        last = max(int(np.searchsorted(spaces, spaces[first] + size)) - 1, first + 1)
        last = min(first + max(WINDOW, (last - first) // WINDOW * WINDOW), len(spaces) - 1)
        if len(spaces) - 1 - last < WINDOW:
            last = len(spaces) - 1
        part = slice(spaces[first], spaces[last] + 1)
        yield raw[part], None if weights is None else weights[part]
        first = last


def logit(model: Model, text: str | None) -> float:
    """The largest window logit; the bias alone for a text without words."""
    best = -np.inf
    for piece, weights in _blocks(text):
        starts = _windows(piece)
        total, count = np.zeros(len(starts)), np.full(len(starts), PRIOR)
        for rows, valid in _features(piece):
            if weights is not None:
                valid = valid * weights[: len(valid)]
            cut = np.minimum(starts, len(rows) - 1)
            value = model.rows[rows]
            value *= valid
            total += np.where(starts < len(rows), np.add.reduceat(value, cut, dtype=np.float64), 0)
            count += np.where(starts < len(rows), np.add.reduceat(valid, cut, dtype=np.float64), 0)
        best = max(best, float((total / count).max()))
    return model.bias + (best if np.isfinite(best) else 0.0)


def _bag(piece: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(feature rows in the order of windows, their weights, first of each window, sum of its weights and prior)."""
    starts = _windows(piece)
    rows, at, own = [], [], []
    for r, valid in _features(piece):
        here = np.flatnonzero(valid)
        rows.append(r[here].astype(np.int32))
        at.append(np.searchsorted(starts, here, "right") - 1)
        own.append(None if weights is None else weights[here])
    window = np.concatenate(at)
    order = np.argsort(window, kind="stable")
    heavy = None if weights is None else np.concatenate(own)[order]
    counts = np.bincount(window, minlength=len(starts))
    return np.concatenate(rows)[order], heavy, np.cumsum(counts) - counts, PRIOR + (counts if weights is None else np.bincount(window, np.concatenate(own), len(starts)))


def _means(values: np.ndarray, rows: np.ndarray, weights: np.ndarray | None, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of each window's features; a window has a word at least, so none is empty."""
    own = values[rows]
    return np.add.reduceat(own if weights is None else own * weights, first, dtype=np.float64) / size


def score(model: Model, text: str | None) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(logit(model, text), -30, 30))))


class _Bags:
    """Feature bags of each training text, a block at a time; those of the first ``HELD`` bytes are
    kept, others made again, so memory doesn't grow with the texts."""

    def __init__(self, texts: list[str]):
        self.texts, self.kept, self.room = texts, {}, HELD

    def __getitem__(self, i: int):
        if i in self.kept:
            return self.kept[i]
        made = (_bag(*piece) for piece in _blocks(self.texts[i]))
        if 20 * len(self.texts[i]) > self.room:
            return made
        self.kept[i] = list(made)
        self.room -= sum(x.nbytes for bag in self.kept[i] for x in bag if x is not None)
        return self.kept[i]


def train(texts: list[str], labels: list[int], dim: int = 4, epochs: int = 12, batch: int = 128, rate: float = 0.05, seed: int = 7) -> Model:
    """Fit table and softmax together by Adam on the cross entropy of each document's
    largest windows (all windows in the first epochs, while none stands out yet). One
    class only, or no text, gives a constant model at the smoothed mean."""
    y = np.asarray(labels, np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    bags = _Bags(texts)
    seen = np.zeros(1 << BITS, np.float32)
    mark = np.full(1 << BITS, -1, np.int32)
    for i in range(len(texts)):
        for rows, *_ in bags[i]:
            new = rows[mark[rows] != i]
            mark[new] = i  # equal rows write the same
            seen[np.unique(new)] += 1
    index = np.full(1 << BITS, -1, np.int32)
    met = np.flatnonzero(seen)
    index[met] = np.arange(len(met))
    trust = (seen[met] / (seen[met] + RARE)).astype(np.float32)
    del seen, mark
    table = rng.normal(0, 0.1, (len(met), dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, dim)).astype(np.float32)
    bias = np.zeros(1)
    scale = 20.0  # a mean over hundreds of features is small
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, soft, bias)]
    step = 0
    cost = np.where(y == 1, 0.5 / y.mean(), 1.0 / (1 - y.mean()))  # a false alarm costs double
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            chosen = order[s : s + batch]
            direction = (soft[1] - soft[0]) * scale
            weights = np.zeros(1 << BITS, np.float32)
            weights[met] = trust * (table @ direction)
            per_row, off = np.zeros(len(met)), 0.0
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def add(per_row=per_row, held=held):
                if held:
                    per_row += np.bincount(index[np.concatenate([r for r, _ in held])], np.concatenate([x for _, x in held]), len(met))
                    held.clear()

            for i in chosen.tolist():
                means = [_means(weights, *bag) for bag in bags[i]]
                if not means:
                    continue
                mean = np.concatenate(means) + bias[0]
                share = np.ones(len(mean)) if epoch < 2 else np.exp(3 * (mean - mean.max()))
                p = 1 / (1 + np.exp(-np.clip(mean, -30, 30)))
                error = (p - y[i]) * cost[i] * share / share.sum() / len(chosen)
                off += error.sum()
                at = 0
                for rows, heavy, first, size in bags[i]:
                    part = np.repeat(error[at : at + len(first)] / size, np.diff(first, append=len(rows)))
                    at += len(first)
                    held.append((rows, part if heavy is None else part * heavy))
                    if sum(len(r) for r, _ in held) > 1 << 20:
                        add()
            add()
            own = (per_row * trust).astype(np.float32)
            toward = (own @ table) * scale
            step += 1
            pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for param, (m, v), grad in zip((table, soft, bias), moments, (np.outer(own, direction), np.stack([-toward, toward]), np.array([off]))):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= (pace * m / (np.sqrt(v) + 1e-8)).astype(param.dtype)
    out = np.zeros(1 << BITS, np.float32)
    out[met] = trust * (table @ ((soft[1] - soft[0]) * scale))
    return Model(out, float(bias[0]))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are never learned: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, bytes_each: int = 65536) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out third: of each class
    the ``per_class`` ids with the smallest hashes among those that have a text, ending early
    only where their texts come to more than ``per_class * bytes_each`` bytes (one text at
    least). Texts of any length are used whole. The bounds hold whatever the table's size, so
    the id list may be broadcast and one task may hold the texts. Training runs in that task,
    which Spark repeats if its executor is lost; the driver gets the finished model. Null ids,
    labels and texts are left out; of the rows of one id one counts."""
    import pandas as pd

    known = labels.filter("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    lengths = texts.groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("bytes"))
    usable = materialize(known.distinct().join(lengths, "doc_id"), "usable")
    ids = []
    for y in (0, 1):
        total = 0
        for r in usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_class).collect():
            total += r.bytes
            if total > per_class * bytes_each and total > r.bytes:
                break
            ids.append((r.doc_id, r.toxic, r.bytes))
    chosen = docs.sparkSession.createDataFrame(ids, "sample_id long, toxic int, size int")
    found = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("sample_id")) & (F.octet_length("text") == F.col("size")))
    found = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")

    def learn(batches):
        rows = pd.concat([b for b in batches] or [pd.DataFrame({"doc_id": [], "text": [], "toxic": []})]).sort_values(["doc_id", "toxic"], kind="stable")
        model = train(rows["text"].tolist(), rows["toxic"].tolist())
        yield pd.DataFrame({"rows": [model.rows.tobytes()], "bias": [model.bias]})

    got = found.coalesce(1).mapInPandas(trimmed(learn), "rows binary, bias double").collect()
    if not got:
        return train([], [])
    return Model(np.frombuffer(bytes(got[0].rows), np.float32), got[0].bias)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores; all columns pass. Null and empty texts get the
    score of no words. Map only; the model (2**20 floats, fixed) travels with the task."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.rows, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            texts = batch.column("text")
            scores = pa.array([score(own, texts[i].as_py()) for i in range(batch.num_rows)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(trimmed(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 at ``threshold`` or more)."""
    model = fit(docs, labels)
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns pass."""
    (name,) = fresh(docs, "score")
    return with_score(docs, fit(docs, labels), name).filter(F.col(name) < threshold).select(*docs.columns)
