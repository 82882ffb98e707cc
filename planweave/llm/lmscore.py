"""Scoring of texts by an n-gram language model kept in a log-frequency Bloom filter.

The model is learned from every training document: single words and pairs of neighbouring words
(an end mark closes each text and stands before its first word) are counted by their hashes,
summed a bucket a task, and the counts of a bucket go into its segment of a Bloom filter by their
level (``logbloom``). Workers get the filter by broadcast and read counts by repeated membership
probes; a level stands for the mean count of what was put in with it.

P(w | v) = (1 - e) c(v w) / c(v) + e P(w), with P(w) = (c(w) + 1) / (N + V + 1); an unseen v gives
P(w). The share e depends on the level of c(v). It maximises the likelihood of all training tokens
when each is left out of the counts, over a grid; a context that has been seen c times meets its
next token as one of c + 1 in training does, so small levels take the share of the level above.

A text is probed once: what the reading says of a token is one of few states, the levels of the
context, of the word and of the pair. A document keeps how often it has each; summed over all
training documents they give the shares, and with these its score.

The base score needs exact counts: the ``HOT`` most frequent words at most are broadcast, the words
of a document beyond them are summed a document and joined with the table of counts. No word of
that join is frequent, so no key of it is hot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logbloom
from .logbloom import Filters, levels_of, segment
from .store import materialize, small_batches, trimmed
from .tokens import slices
from .wordstream import U, blocks, mix, pair

WORD, PAIR = 1, 2
END = mix(np.array([0x0A], U))[0]  # no word's bytes
HOT = 1 << 18  # words that are broadcast, at most
TEXT = 4 << 20  # bytes of text whose n-grams are counted at once
ASKED = 32 << 20  # bytes of text that are looked up at once at most: a larger filter is read for more text at a time
PER_BUCKET = 8 << 20  # bytes of text a bucket
GRID = np.concatenate([[0.001, 0.003, 0.01, 0.03], np.arange(0.06, 1.0, 0.06), [0.98, 0.99, 0.997, 1.0]])
TOP = len(logbloom.LEAST)


def training(doc_id: Column, folds: int = 7, out: int = 2) -> Column:
    """Whether a document is learned from; a null id is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != out


def token_arrays(texts, most: int = TEXT):
    """``(tokens, contexts, text)`` arrays of a column of texts, block by block: hashes of the words
    and of an end mark after each text, of what stands before each, and the text of each."""
    before = END
    for b in blocks(texts, most=most):
        closed = np.arange(b.first, b.last if b.ends else b.last - 1)
        words = np.bincount(b.text - b.first, minlength=b.last - b.first)
        tokens = np.empty(len(b.hashes) + len(closed), U)
        text = np.empty(len(tokens), np.int64)
        at = np.arange(len(b.hashes)) + (b.text - b.first)  # an end mark for each text before
        tokens[at], text[at] = b.hashes, b.text
        stop = np.cumsum(words)[: len(closed)] + np.arange(len(closed))
        tokens[stop], text[stop] = END, closed
        contexts = np.concatenate([[before], tokens[:-1]]).astype(U) if len(tokens) else tokens
        before = tokens[-1] if len(tokens) else before
        yield tokens, contexts, text


def count_ngrams(docs: DataFrame, bits: int) -> DataFrame:
    """``docs(text)`` -> one row a kind and bucket: its segment of the filter, counts and their sum
    by level, and for single words the exact counts. N-grams are counted a slice of texts before
    they are shuffled; a frequent one has a row a slice."""
    import pandas as pd
    import pyarrow as pa

    def count(batches):
        for batch in slices(batches, most=TEXT):
            for tokens, contexts, _ in token_arrays(batch.column("text")):
                for kind, keys in ((WORD, tokens), (PAIR, pair(contexts, tokens))):
                    found, n = np.unique(keys, return_counts=True)
                    bucket = (found >> U(64 - bits)).astype(np.int64)
                    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
                    ends = np.append(cut[1:], len(bucket))
                    raw, n = found.astype("<u8"), n.astype("<i8")
                    for at in range(0, len(cut), 256):
                        some = list(zip(cut[at : at + 256].tolist(), ends[at : at + 256].tolist()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind] * len(some), pa.int32()), pa.array(bucket[cut[at : at + 256]]), pa.array([raw[s:e].tobytes() for s, e in some], pa.binary()), pa.array([n[s:e].tobytes() for s, e in some], pa.binary())],
                            names=["kind", "bucket", "keys", "counts"],
                        )

    def gather(key, rows):
        keys = np.frombuffer(b"".join(rows["keys"]), "<u8")
        counts = np.frombuffer(b"".join(rows["counts"]), "<i8")
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        level = levels_of(counts)
        exact = key[0] == WORD
        return pd.DataFrame([{
            "kind": key[0], "bucket": key[1], "bits": segment(keys, level),
            "n": np.bincount(level, minlength=TOP), "total": np.bincount(level, counts, minlength=TOP).astype(np.int64),
            "words": keys.view(np.int64) if exact else None, "counts": counts if exact else None,
        }])

    parts = docs.select("text").mapInArrow(trimmed(count), "kind int, bucket long, keys binary, counts binary")
    out = "kind int, bucket long, bits binary, n array<long>, total array<long>, words array<long>, counts array<long>"
    return materialize(parts.groupBy("kind", "bucket").applyInPandas(gather, out), "ngrams")


class Model:
    """What the workers need: filters, the mean count of each level, exact hot words."""

    def __init__(self, filters: Filters, means: dict[int, np.ndarray], tokens: int, distinct: int, hot: tuple[np.ndarray, np.ndarray]):
        self.filters, self.means, self.tokens, self.distinct, self.hot = filters, means, tokens, distinct, hot

    def probe(self, tokens: np.ndarray, contexts: np.ndarray):
        """Levels of the tokens, of their contexts and of the pairs; a pair is asked for only where
        both of its parts are there, for no other can be."""
        words, of = np.unique(np.append(tokens, contexts[:1]), return_inverse=True)
        seen = self.filters.levels({WORD: words})[WORD][of]
        word = seen[:-1]
        context = np.concatenate([seen[-1:], word[:-1]])[: len(word)]  # a token's context is the token before it
        asked = np.flatnonzero((word > 0) & (context > 0))
        pairs, of = np.unique(pair(contexts[asked], tokens[asked]), return_inverse=True)
        both = np.zeros(len(tokens), np.int8)
        both[asked] = self.filters.levels({PAIR: pairs})[PAIR][of]
        return word, context, both

    def lower(self, word: np.ndarray) -> np.ndarray:
        """P(w) of words of these levels."""
        return (self.means[WORD][word] + 1) / (self.tokens + self.distinct + 1)

    def states(self, tokens: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """State of each token: levels of its context, of itself and of the pair in one number."""
        word, context, both = self.probe(tokens, contexts)
        return (context.astype(np.int64) * TOP + word) * TOP + both

    def learn(self, states: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Share of each level of a context: over a grid, the one under which the training tokens, each
        left out of the counts, are likeliest."""
        context, word, both = states // TOP // TOP, states // TOP % TOP, states % TOP
        over = np.maximum(self.means[WORD][context] - 1, 1e-9)
        ratio = np.clip((self.means[PAIR][both] - 1) / over, 0, 1)
        lower = np.maximum(self.lower(word) - 1 / (self.tokens + self.distinct + 1), 1e-300)
        mixed = np.maximum((1 - GRID) * ratio[:, None] + GRID * lower[:, None], 1e-300)
        sums = np.zeros((TOP, len(GRID)))
        np.add.at(sums, context, np.log(mixed) * seen[:, None])
        best = {level: GRID[sums[level].argmax()] for level in np.unique(context).tolist()}
        above = [level + 1 if level + 1 < TOP and logbloom.LEAST[level + 1] == level + 1 else level for level in range(TOP)]
        return np.array([best.get(above[level], best.get(level, 1.0)) if level else 1.0 for level in range(TOP)])

    def log10(self, states: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """log10 P(w | v) of states."""
        context, word, both = states // TOP // TOP, states // TOP % TOP, states % TOP
        ratio = np.minimum(1, self.means[PAIR][both] / np.maximum(self.means[WORD][context], 1))
        return np.log10((1 - shares[context]) * ratio + shares[context] * self.lower(word))

    def exact(self, tokens: np.ndarray) -> np.ndarray:
        """Exact counts of hot words, -1 for others."""
        words, counts = self.hot
        if not len(words):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
        return np.where(words[at] == tokens, counts[at], -1)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """Model of ``docs(text)`` and the table its exact counts are in."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = logbloom.bucket_bits(size, PER_BUCKET)
    table = count_ngrams(docs, bits)
    by_level = table.select("kind", F.posexplode(F.arrays_zip("n", "total")).alias("level", "x")).groupBy("kind", "level").agg(F.sum("x.n").alias("n"), F.sum("x.total").alias("total")).filter("n > 0").collect()
    means, many = {WORD: np.zeros(TOP), PAIR: np.zeros(TOP)}, np.zeros(TOP, np.int64)
    tokens = distinct = 0
    for r in by_level:
        means[r.kind][r.level] = r.total / r.n
        if r.kind == WORD:
            tokens, distinct, many[r.level] = tokens + r.total, distinct + r.n, r.n
    lowest = next((level for level in range(1, TOP) if many[level:].sum() <= HOT), TOP - 1)
    each = counts_table(table)
    hot = each.filter(F.col("count") >= logbloom.LEAST[lowest]).toArrow()
    words, counts = np.asarray(hot.column("word")).astype(np.int64).view(U), np.asarray(hot.column("count")).astype(np.int64)
    order = np.argsort(words)
    filters = Filters.broadcast(table.select("kind", "bucket", "bits"), 64 - bits, TOP - 1)
    return Model(filters, means, tokens, distinct, (words[order], counts[order])), table


def counts_table(table: DataFrame) -> DataFrame:
    """``(word, count)``: exact counts by the word's hash."""
    return table.filter(F.col("kind") == WORD).select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("count"))


def scores(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` tells which rows nothing is learned from (default: ``training`` of doc_id).
    Null and empty texts are an end mark alone; a null doc_id is one to learn from; repeated rows
    count and get a row each; with nothing to learn from every text scores 0, for then nothing but
    the unknown is expected; an empty table gives no row; other columns are ignored.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    held = ~training(F.col("doc_id")) if held_out is None else held_out
    rows = docs.select(F.col("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model, table = train(rows.filter(~F.col("held_out")).select("text"))

    most = min(ASKED, max(TEXT, model.filters.size // 32))

    def read(batches):
        for batch in slices(batches, most=most):
            n = batch.num_rows
            tokens_of, known, base = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            cold, states = [], []
            for tokens, contexts, text in token_arrays(batch.column("text"), most):
                count = model.exact(tokens)
                hot = count >= 0
                tokens_of += np.bincount(text, minlength=n)
                known += np.bincount(text[hot], minlength=n)
                base += np.bincount(text[hot], np.log10(count[hot] + 1.0), minlength=n)
                cold.append(_tallied(text[~hot], tokens[~hot]))
                states.append(_tallied(text, model.states(tokens, contexts)))
            columns = [batch.column("at"), batch.column("doc_id"), batch.column("held_out"), pa.array(tokens_of), pa.array(known), pa.array(base)]
            for parts, kind in ((cold, np.int64), (states, np.int32)):
                text, keys, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
                order = np.argsort(text, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
                keys = keys[order].view(np.int64) if kind is np.int64 else keys[order].astype(kind)
                columns += [pa.ListArray.from_arrays(ends, pa.array(keys)), pa.ListArray.from_arrays(ends, pa.array(times[order].astype(kind)))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "doc_id", "held_out", "n_tokens", "known", "base", "words", "times", "states", "seen"])

    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"at long, doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, words array<long>, times array<long>, states array<int>, seen array<int>"
    told = materialize(rows.select(F.monotonically_increasing_id().alias("at"), "doc_id", "held_out", "text").mapInArrow(trimmed(read), schema), "states")
    model.filters.destroy()
    of_training = told.filter(~F.col("held_out")).select(F.explode(F.arrays_zip("states", "seen")).alias("x")).groupBy("x.states").agg(F.sum("x.seen").alias("n")).toArrow()  # a row a state
    shares = model.learn(*(np.asarray(of_training.column(k)).astype(np.int64) for k in range(2)))
    light = Model(None, model.means, model.tokens, model.distinct, (model.hot[0][:0], model.hot[1][:0]))

    def score(batches):
        for batch in batches:
            states = batch.column("states")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(states.offsets)))
            value = light.log10(np.asarray(states.flatten()).astype(np.int64), shares) * np.asarray(batch.column("seen").flatten())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("at", "doc_id", "held_out", "n_tokens", "known", "base")), pa.array(np.bincount(owner, value, minlength=batch.num_rows))], names=["at", "doc_id", "held_out", "n_tokens", "known", "base", "score"])

    scored = told.drop("words", "times").mapInArrow(trimmed(score), f"at long, doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, score double")
    cold = told.select("at", F.explode(F.arrays_zip("words", "times")).alias("x")).select("at", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = cold.join(counts_table(table), "word").groupBy("at").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("gain"))
    return scored.join(found, "at", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.distinct + 1)))).alias("base_score"),
        "score",
    )


def _tallied(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each text and how often they come."""
    found, back = np.unique(keys, return_inverse=True)
    cell, times = np.unique(text * max(1, len(found)) + back, return_counts=True)
    return cell // max(1, len(found)), found[cell % max(1, len(found))] if len(found) else found, times
