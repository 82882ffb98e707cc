"""Phrases whose words keep company, by suffix sorting (Suffix-sigma).

Every word starts a suffix of up to four words that ends with its piece. Suffixes meet by language
and first word, are sorted in reverse lexicographic order, and one pass over them counts all
prefixes: the stack is what a suffix has in common with the one before, and where it shrinks, the
prefixes that leave it are complete. Words too rare to be in any phrase end a piece; they are told
by a Bloom filter of fixed size holding the others, whose errors only cost rows. Frequencies of the
parts are joined afterwards.

Hot first words. A word is hot if it makes up more than one part in 2 ** bits of all words, so there
are at most that many. Suffixes are dealt by language, first word, and, while the words so far are
all hot, the next word; whatever meets in a bucket by its key is then bounded by the frequency of
a word that isn't hot, or is one suffix, counted before the shuffle. Only prefixes of two or three
hot words are counted in parts, which are summed.

Words and suffixes are 64-bit hashes until the end. The count of words compares the words of equal
hashes; should two words ever share one, the hashes are drawn again with another seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import logbloom
from .store import materialize, release, small_batches, trimmed
from .tokens import slices
from .wordstream import U, blocks, mix, pair

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t" + PIECE_ENDS
LONGEST = 4  # words of a phrase
TEXT = 3 << 20  # bytes of text sorted at once
PER_BUCKET = 4 << 20  # bytes of text a bucket
FILTER_BITS = 8  # log2 of the segments of the filter of words
SEGMENT = 1 << 16  # bytes each: 16 MiB in all


def _languages(column) -> tuple[np.ndarray, list[str]]:
    import pyarrow.compute as pc

    coded = pc.fill_null(column, "und").dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_pylist()


def _salts(names: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(n.encode("utf-8", "surrogatepass"), 7) for n in names), U, len(names))


def _keys(salts: np.ndarray, lang: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of a language's word; never 0."""
    out = mix(words + salts[lang])
    out[out == 0] = 1
    return out


def count_words(docs: DataFrame, least: int, bits: int, seed: int) -> DataFrame:
    """``docs(lang, text)`` -> a row a language and bucket of words: n, the number of occurrences,
    whether two words share a hash, and the words that occur ``least`` times or more."""
    import pandas as pd
    import pyarrow as pa

    def count(batches):
        for batch in slices(batches, most=TEXT):
            lang_of, names = _languages(batch.column("lang"))
            salts = _salts(names)
            for b in blocks(batch.column("text"), GAPS, most=TEXT, seed=seed):
                if not len(b.hashes):
                    continue
                lang = lang_of[b.text]
                keys = _keys(salts, lang, b.hashes)
                found, first, n = np.unique(keys, return_index=True, return_counts=True)
                code = lang[first]
                bucket = (found >> U(64 - bits)).astype(np.int64)
                order = np.lexsort((found, bucket, code))
                found, first, n, code, bucket = found[order], first[order], n[order], code[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])]))
                starts, stops = b.starts[first].tolist(), b.stops[first].tolist()
                words = [b.raw[s:e] for s, e in zip(starts, stops)]
                spans = list(zip(cut.tolist(), np.append(cut[1:], len(found)).tolist()))
                for at in range(0, len(spans), 256):
                    some = spans[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[code[s]] for s, _ in some]), pa.array([int(bucket[s]) for s, _ in some]), pa.array([found[s:e].tobytes() for s, e in some], pa.binary()),
                         pa.array([n[s:e].astype("<i8").tobytes() for s, e in some], pa.binary()), pa.array([b"\n".join(words[s:e]) for s, e in some], pa.binary())],
                        names=["lang", "bucket", "keys", "counts", "words"],
                    )

    def gather(key, rows):
        keys = np.frombuffer(b"".join(rows["keys"]), "<u8")
        counts = np.frombuffer(b"".join(rows["counts"]), "<i8")
        words = np.array([w for blob in rows["words"] for w in blob.split(b"\n")], object)
        keys, total, words, clash = _summed(keys, counts, words)
        kept = total >= least
        return pd.DataFrame([{
            "lang": key[0], "bucket": key[1], "n": int(total.sum()), "clash": clash,
            "keys": keys[kept].view(np.int64), "counts": total[kept], "words": [w.decode("utf-8", "surrogatepass") for w in words[kept]],
        }])

    parts = docs.select("lang", "text").mapInArrow(trimmed(count), "lang string, bucket long, keys binary, counts binary, words binary")
    out = "lang string, bucket long, n long, clash boolean, keys array<long>, counts array<long>, words array<string>"
    return materialize(parts.groupBy("lang", "bucket").applyInPandas(gather, out), "words")


def _summed(keys: np.ndarray, counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Distinct keys, their counts and words, and whether some key has two words."""
    order = np.argsort(keys, kind="stable")
    keys, counts, words = keys[order], counts[order], words[order]
    same = keys[1:] == keys[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return keys[first], np.add.reduceat(counts, first), words[first], bool((words[1:][same] != words[:-1][same]).any())


def _word_filter(words: DataFrame) -> logbloom.Filters:
    """Filter of the keys of ``words(key)``; its size is fixed, a fuller one tells less."""
    import pandas as pd

    shift = 64 - FILTER_BITS

    def gather(key, rows):
        hashes = np.concatenate([np.asarray(x) for x in rows["keys"]]).astype(np.int64).view(U)
        return pd.DataFrame([{"kind": 0, "bucket": key[0], "bits": logbloom.segment(hashes, np.ones(len(hashes), np.int64), SEGMENT)}])

    dealt = words.select(F.shiftrightunsigned("key", shift).alias("bucket"), "key").groupBy("bucket", (F.xxhash64("key") % 64).alias("part")).agg(F.collect_list("key").alias("keys"))
    segments = dealt.groupBy("bucket").applyInPandas(gather, "kind int, bucket long, bits binary")
    return logbloom.Filters.broadcast(materialize(segments.coalesce(8), "word-filter"), shift, 1)


def count_phrases(docs: DataFrame, known: logbloom.Filters, hot: np.ndarray, least: int, bits: int, seed: int, longest: int = LONGEST) -> DataFrame:
    """``docs(lang, text)`` -> ``(w1 .. w4, size, f)``: prefixes of two words or more that occur
    ``least`` times or more. A bucket gives what it counts in part whatever its number."""
    import pandas as pd
    import pyarrow as pa

    columns = [f"w{k + 1}" for k in range(longest)]

    def is_hot(keys):
        if not len(hot):
            return np.zeros(len(keys), bool)
        return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys

    def dealt(rows):
        """Suffixes of one slice, equal ones counted, in order of their buckets."""
        digest = rows[0]
        for k in range(1, longest):
            digest = pair(digest, rows[k])
        order = np.argsort(digest)
        rows, digest = rows[:, order], digest[order]
        differ = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        if (differ & (digest[1:] == digest[:-1])).any():  # two suffixes with one digest
            rows = rows[:, np.lexsort(rows[::-1])]
            differ = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        first = np.flatnonzero(np.concatenate([[True], differ]))
        n = np.diff(np.append(first, rows.shape[1]))
        rows = rows[:, first]
        key, leading = rows[0].copy(), is_hot(rows[0])
        for k in range(1, longest):
            key[leading] = pair(key[leading], rows[k][leading])
            leading &= is_hot(rows[k])
        bucket = (mix(key) >> U(64 - bits)).astype(np.int64)
        order = np.lexsort((rows[0], bucket))
        return rows[:, order], n[order], bucket[order]

    def split(batches):
        for batch in slices(batches, most=TEXT):
            lang_of, names = _languages(batch.column("lang"))
            salts = _salts(names)
            for keys, ends, whole in _pieces(batch.column("text"), lang_of, salts, seed, longest):
                rare = known.levels({0: keys})[0] == 0
                ends = ends | rare
                ends[:-1] |= rare[1:]
                rows = _suffixes(keys, ends, longest)[:, :whole]
                rows = rows[:, rows[1] != 0]  # single words are counted already
                if not rows.shape[1]:
                    continue
                rows, n, bucket = dealt(rows)
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                spans = list(zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist()))
                for at in range(0, len(spans), 256):
                    some = spans[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(bucket[s]) for s, _ in some]), *(pa.array([rows[k, s:e].tobytes() for s, e in some], pa.binary()) for k in range(longest)), pa.array([n[s:e].astype("<u4").tobytes() for s, e in some], pa.binary())],
                        names=["bucket", *columns, "counts"],
                    )

    def gather(key, group):
        rows = np.array([np.frombuffer(b"".join(group[c]), "<u8") for c in columns])
        n = np.frombuffer(b"".join(group["counts"]), "<u4").astype(np.int64)
        order = np.lexsort(rows[::-1])[::-1]
        rows, n = rows[:, order], n[order]
        same = np.logical_and.accumulate(rows[:, 1:] == rows[:, :-1], axis=0)
        kept = np.concatenate([[0], same.sum(axis=0)])  # of the stack, when the next suffix comes
        part, out = is_hot(rows[0]), []
        for size in range(2, longest + 1):
            part = part & is_hot(rows[size - 1])
            new = np.flatnonzero(kept < size)
            f = np.add.reduceat(n, new)
            split_up = part[new] & (size < longest)
            good = (rows[size - 1, new] != 0) & (split_up | (f >= least))
            found = rows[:, new[good]].copy()
            found[size:] = 0
            out.append(pd.DataFrame({**{c: found[k].view(np.int64) for k, c in enumerate(columns)}, "size": size, "f": f[good]}))
        return pd.concat(out, ignore_index=True)

    parts = docs.select("lang", "text").mapInArrow(trimmed(split), f"bucket long, {', '.join(f'{c} binary' for c in columns)}, counts binary")
    counted = parts.groupBy("bucket").applyInPandas(gather, f"{', '.join(f'{c} long' for c in columns)}, size int, f long")
    return counted.groupBy(*columns, "size").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _pieces(texts, lang_of, salts, seed: int, longest: int):
    """``(keys, ends, whole)`` a block: keys of its words, whether their piece ends after them, and how
    many start suffixes here. The last words of a part of a long text wait for the next part."""
    held = np.zeros(0, U)
    for b in blocks(texts, GAPS, most=TEXT, seed=seed):
        ended = np.concatenate([[0], np.cumsum(np.isin(np.frombuffer(b.raw, np.uint8), np.frombuffer(PIECE_ENDS, np.uint8)))])
        keys = _keys(salts, lang_of[b.text], b.hashes)
        ends = np.zeros(len(keys), bool)
        ends[:-1] = (ended[b.starts[1:]] > ended[b.stops[:-1]]) | (b.text[1:] != b.text[:-1])
        closed = b.ends or bool(ended[-1] > ended[b.stops[-1] if len(keys) else 0])
        if len(held):
            lead = np.zeros(len(held), bool)
            lead[-1] = ended[b.starts[0]] > 0 if len(keys) else closed
            keys, ends = np.concatenate([held, keys]), np.concatenate([lead, ends])
        if not len(keys):
            continue
        if closed:
            ends[-1] = True
        last = np.flatnonzero(ends)
        whole = max(len(keys) - longest + 1, int(last[-1]) + 1 if len(last) else 0)
        held = keys[whole:]
        yield keys, ends, whole


def _suffixes(keys: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """A column a word: its key and those that follow in its piece, 0 beyond its end."""
    out, going = np.zeros((longest, len(keys)), U), np.ones(len(keys), bool)
    out[0] = keys
    for k in range(1, longest):
        going[: len(keys) - k + 1] &= ~ends[k - 1 :]
        going[max(0, len(keys) - k) :] = False
        out[k, : len(keys) - k] = np.where(going[: len(keys) - k], keys[k:], 0) if len(keys) > k else 0
    return out


def _key(*parts: Column) -> list[Column]:
    """Columns w1 .. of the words given, 0 beyond them."""
    return [*parts, *[F.lit(0).cast("long")] * (LONGEST - len(parts))]


def phrases(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, seed: int = 0) -> DataFrame:
    """The first ``top`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n,
    score.

    Null texts are empty, a null language is ``und``; repeated rows count as often as they are there;
    no word or phrase of ``least`` occurrences gives no row; other columns are ignored; texts may be of
    any length. A part's frequency is never below its phrase's, so all that is asked for was counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = logbloom.bucket_bits(size, PER_BUCKET)
    while True:
        words = count_words(rows, least, bits, seed)
        if not words.filter("clash").limit(1).count():
            break
        release(words)
        seed += 1
    of_lang = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    each = words.select("lang", F.explode(F.arrays_zip("keys", "counts", "words")).alias("x")).select("lang", F.col("x.keys").alias("key"), F.col("x.counts").alias("f"), F.col("x.words").alias("word"))
    hot = each.filter(F.col("f") * (1 << bits) > total)  # fewer than 2 ** bits
    known = _word_filter(each.select("key"))
    hot_keys = np.sort(np.asarray(hot.select("key").toArrow().column("key")).astype(np.int64).view(U))
    found = materialize(count_phrases(rows, known, hot_keys, least, bits, seed), "phrases")
    known.destroy()

    columns = [f"w{k + 1}" for k in range(LONGEST)]
    w = [F.col(c) for c in columns]
    singles = each.select(*[c.alias(n) for c, n in zip(_key(F.col("key")), columns)], "f")
    parts = found.select(*columns, "f").unionByName(singles)
    hot_parts = F.broadcast(hot.select(F.col("key").alias("hot_key"), F.col("f").alias("hot_f"), F.col("word").alias("hot_word")))

    def with_part(table: DataFrame, side: str) -> DataFrame:
        """``f`` of the part in columns ``side`` 1 .. 4. Hot words are broadcast; rows that have their
        answer are spread over the join of the others."""
        at = table.join(hot_parts.drop("hot_word"), (F.col(f"{side}1") == F.col("hot_key")) & (F.col(f"{side}2") == 0), "left")
        lead = F.when(F.col("hot_f").isNull(), F.col(f"{side}1")).otherwise(F.xxhash64(*columns))
        keyed = at.withColumn(f"{side}1", lead)
        theirs = parts.select(*[F.col(c).alias(f"{side}{k + 1}") for k, c in enumerate(columns)], F.col("f").alias("part_f"))
        joined = keyed.join(theirs, [f"{side}{k + 1}" for k in range(LONGEST)], "left")
        return joined.withColumn(side, F.coalesce("hot_f", "part_f")).drop("hot_key", "hot_f", "part_f", *[f"{side}{k + 1}" for k in range(LONGEST)])

    cuts = []
    for n in range(2, LONGEST + 1):
        for k in range(1, n):
            cuts.append(F.when(F.col("size") == n, F.struct(F.lit(k).alias("k"), F.array(*_key(*w[:k])).alias("l"), F.array(*_key(*w[k:n])).alias("r"))))
    cut = found.select(*columns, "size", F.col("f").alias("a"), F.explode(F.array_compact(F.array(*cuts))).alias("c"))
    cut = cut.select(*columns, "size", "a", F.col("c.k").alias("k"), *[F.element_at(f"c.{s}", i + 1).alias(f"{s}{i + 1}") for s in "lr" for i in range(LONGEST)])
    sided = with_part(with_part(cut, "l"), "r")
    exact = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = sided.withColumn("score", exact).groupBy(*columns, "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))

    inside = [(n, i, m) for n in range(3, LONGEST + 1) for m in range(2, n) for i in range(n - m + 1)]
    held = found.select("f", F.explode(F.array_compact(F.array(*[F.when(F.col("size") == n, F.array(*_key(*w[i : i + m]))) for n, i, m in inside]))).alias("c"))
    longer = held.select(*[F.element_at("c", k + 1).alias(c) for k, c in enumerate(columns)], "f").groupBy(*columns).agg(F.max("f").alias("longer"))
    kept = scored.join(longer, columns, "left").filter(F.coalesce(F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"), F.lit(True)))
    kept = kept.select(*columns, "size", "a", F.col("least.score").alias("score"), F.col("least.l").alias("l"), F.col("least.r").alias("r"))

    word_of = kept.select("*", F.posexplode(F.array(*columns)).alias("place", "key")).filter("key <> 0")
    word_of = word_of.join(hot_parts.drop("hot_f"), F.col("key") == F.col("hot_key"), "left")
    word_of = word_of.withColumn("key", F.when(F.col("hot_word").isNull(), F.col("key")).otherwise(F.xxhash64(*columns)))
    spelt = word_of.join(each.select("key", "word"), "key", "left").withColumn("word", F.coalesce("hot_word", "word"))
    spelt = spelt.groupBy(*columns, "a", "l", "r", "score").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    langs = each.select(F.col("key").alias("w1"), "lang")
    hot_langs = F.broadcast(hot.select(F.col("key").alias("hot_key"), F.col("lang").alias("hot_lang")))
    named = spelt.join(hot_langs, F.col("w1") == F.col("hot_key"), "left").withColumn("w1", F.when(F.col("hot_lang").isNull(), F.col("w1")).otherwise(F.xxhash64("phrase")))
    named = named.join(langs, "w1", "left").select(F.coalesce("hot_lang", "lang").alias("lang"), "phrase", "a", "l", "r", "score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = named.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(of_lang), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
