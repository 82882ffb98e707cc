"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

A window is 10 consecutive words of a benchmark item (a shorter item is one window).
Words are ordered by rarity over the whole corpus. Containing a window means containing
every word of it, so the necessary prefix of the rarity order is one word long: the
window's rarest word. Document words are joined with these prefix words; the position
of the match fixes where the window would have to begin (positional bound) and the
document has to be long enough for it (length bound); the slice of that length is then
compared word by word, so what is found is exact.

The words of a document stay one array inside a single generated stage: the explode,
the broadcast join and the verification are pipelined, only hits are written out. The
benchmark side is broadcast in blocks of a checked size; more blocks mean more passes,
never a dropped window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, materialize

# What stands between words, before and after lower-casing; single characters match faster than ranges.
GAP_ANY = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
GAP = GAP_ANY[:-2] + "".join(f"\\x{c:02X}" for c in range(65, 91)) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 16 << 20  # of benchmark windows broadcast at once


def split_words(text: Column) -> Column:
    """Words after lower-casing A to Z; the array may begin or end with one empty string."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)  # where lower() does the same, faster
    return F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), GAP)


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """``items(item_id, text)`` -> ``(item_id, words)``, a row a window."""
    words = F.filter(split_words(F.col("text")), lambda w: w != "")
    rows = items.select("item_id", words.alias("all")).filter(F.size("all") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.size("all") - F.lit(width - 1), F.lit(1)))
    return rows.select("item_id", "all", F.explode(begins).alias("at")).select("item_id", F.slice("all", F.col("at"), width).alias("words")).distinct()


def _exploded(docs: DataFrame) -> DataFrame:
    """``docs(key, words)`` -> a row a word; the array rides along by reference."""
    return docs.select("key", "words", F.posexplode("words").alias("pos", "word"))


def _blocks(table: DataFrame, by: str, bytes_each: int) -> list[DataFrame]:
    """``table`` in hash blocks by ``by``, each measured to be of ``bytes_each`` at most (a row that
    is larger by itself is a block of its own)."""
    n = int((table.agg(F.sum("bytes")).first()[0] or 0) // bytes_each) + 1
    while True:
        if n == 1:
            return [table]
        block = F.pmod(F.xxhash64(by), F.lit(n))
        sizes = table.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).collect()  # a row a block
        if all(r.bytes <= bytes_each or r.rows == 1 for r in sizes):
            return [table.filter(block == r.block) for r in sorted(sizes)]
        n *= 2


def windows_of(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window_id, words)`` and who has them, ``(window_id, item_id)``."""
    named = item_windows(items, width).withColumn("window_id", F.xxhash64(F.concat_ws(" ", "words")))
    owners = materialize(named, "windows")
    return owners.select("window_id", "words").distinct(), owners.select("window_id", "item_id").distinct()


def find_hits(docs: DataFrame, windows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs(key, words)``, ``windows(window_id, words)`` -> ``(key, window_id, start, n)``: every
    occurrence of every window. ``key`` names a row or a text; its type is free."""
    windows = materialize(windows, "distinct-windows")
    vocabulary = windows.select(F.explode("words").alias("word")).distinct().withColumn("bytes", F.octet_length("word") + 32)
    vocabulary = materialize(vocabulary, "vocabulary")
    counts = None
    for block in _blocks(vocabulary, "word", block_bytes):
        part = _exploded(docs).select("word").join(F.broadcast(block.select("word")), "word").groupBy("word").agg(F.count("*").alias("seen"))
        counts = part if counts is None else counts.unionByName(part)
    rarity = materialize(counts, "rarity")
    # The rarest word of each window (ties: the smallest word) and its first place in it.
    ranked = windows.select("words", "window_id", F.explode("words").alias("word")).join(rarity, "word", "left").groupBy("window_id", "words").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("word"))).alias("p"))
    prefix = materialize(
        ranked.filter("p.seen > 0")
        .select(F.col("p.word").alias("prefix"), F.array_position("words", F.col("p.word")).cast("int").alias("at"), "words", F.size("words").alias("n"), "window_id")
        .withColumn("bytes", F.octet_length(F.concat_ws("", "words")) + F.size("words") * 16 + 96)
        .withColumnRenamed("words", "window"),
        "prefix",
    )
    found = None
    for block in _blocks(prefix, "window_id", block_bytes):
        start = F.col("pos") + 2 - F.col("at")  # 1-based first word of the window in the document
        part = (
            _exploded(docs)
            .join(F.broadcast(block.drop("bytes")), F.col("word") == F.col("prefix"))
            .filter((start >= 1) & (start + F.col("n") - 1 <= F.size("words")))
            .filter(F.slice("words", start, F.col("n")) == F.col("window"))
            .select("key", "window_id", start.alias("start"), "n")
        )
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit. Null and wordless texts have no words
    and no hits; items of null text have no window; items without an id count as one item
    that adds no string to the digest; repeated rows get a row each; equal ids with different
    texts are kept apart by the text's hash; empty tables give no row or no hit; other columns
    are ignored.
    """
    slim = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    keyed = slim.select(F.struct("doc_id", "text_hash").alias("key"), split_words(F.col("text")).alias("words"))
    windows, owners = windows_of(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), width)
    hits = materialize(find_hits(keyed, windows, block_bytes), "hits")
    covered = (
        hits.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("n_hit"))
    )
    # Documents with the same set of windows (at most their own words) share the list of items.
    sets = hits.groupBy("key").agg(F.sort_array(F.collect_set("window_id")).alias("windows")).withColumn("set_id", F.sha2(F.concat_ws(",", F.col("windows").cast("array<string>")), 256))
    sets = materialize(sets, "window-sets")
    lists = sets.groupBy("set_id").agg(F.first("windows").alias("windows")).select("set_id", F.explode("windows").alias("window_id")).join(owners, "window_id").select("set_id", F.struct("item_id").alias("item")).distinct()
    named = lists.groupBy("set_id").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item.item_id")), ",").alias("ids"))
    summary = covered.join(sets.select("key", "set_id"), "key").join(named, "set_id").select(F.col("key.doc_id").alias("hit_id"), F.col("key.text_hash").alias("hit_hash"), "n_hit", "n_items", F.sha2("ids", 256).alias("digest"))
    summary = materialize(summary, "contaminated")
    ends = lambda k: F.when(F.element_at("words", k) == "", 1).otherwise(0)
    sized = slim.select("doc_id", "text_hash", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), GAP_ANY).alias("words"))
    counted = sized.select("doc_id", "text_hash", F.when((F.size("words") == 1) & (F.element_at("words", 1) == ""), 0).otherwise(F.size("words") - ends(1) - ends(-1)).cast("long").alias("n_words"))
    joined = counted.join(summary, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without those that contain a window; all columns pass."""
    hash_c, id_c, of = fresh(docs, "hash", "hit_id", "hit_hash")
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    keyed = slim.select(F.struct("doc_id", "text_hash").alias("key"), split_words(F.col("text")).alias("words"))
    windows, _ = windows_of(items.select("item_id", "text"), width)
    hits = materialize(find_hits(keyed, windows, block_bytes).select("key").distinct(), "hits")
    dirty = hits.select(F.col("key.doc_id").alias(id_c), F.col("key.text_hash").alias(of))
    marked = docs.withColumn(hash_c, F.xxhash64("text"))
    return marked.join(dirty, F.col("doc_id").eqNullSafe(F.col(id_c)) & (F.col(hash_c) == F.col(of)), "left_anti").select(*docs.columns)
