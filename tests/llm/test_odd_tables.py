"""Long texts, hot ids, repeated rows, clashing columns and empty tables, for each operator."""

import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from planweave.llm import decontaminate, mixing, nearcopies, sharding, simhash, tokencount, toxicity, warc, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# -- the weighted hash tree, in plain Python ---------------------------------------------------


def spark_xxhash(values, seed=42):
    """Spark's xxhash64 of (long or null, string, int)."""
    m = (1 << 64) - 1
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    rot = lambda x, r: (x << r | x >> 64 - r) & m

    def mix(h):
        h = (h ^ h >> 33) * p2 & m
        h = (h ^ h >> 29) * p3 & m
        return h ^ h >> 32

    for kind, v in values:
        if v is None:
            continue
        if kind == "long":
            h = (seed + p5 + 8) & m
            h ^= rot(v * p2 & m, 31) * p1 & m
            seed = mix((rot(h, 27) * p1 + p4) & m)
        elif kind == "int":
            h = (seed + p5 + 4) & m
            h ^= (v & 0xFFFFFFFF) * p1 & m
            seed = mix((rot(h, 23) * p2 + p3) & m)
        else:
            seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return seed


def descend(doc_id, node):
    while node.shard is None:
        live = [c for c in node.children if c.weight > 0]
        if len(live) > 1:
            draw = lambda c: math.log(((spark_xxhash([("long", doc_id), ("string", c.name), ("int", sharding.SEED)]) >> 11) + 0.5) / (1 << 53)) / c.weight
            node = max(live, key=draw)
        else:
            node = live[0]
    return node.shard


def test_sharding_equals_a_plain_tree(spark):
    rows = [(i * 7919 - 40, f"text {i}") for i in range(400)] + [(None, "no id"), (5, None)]
    tree = sharding.even_tree(8)
    for r in sharding.assign(docs_of(spark, rows)).collect():
        assert r.shard == descend(r.doc_id, tree) and r.grown_shard == descend(r.doc_id, sharding.grown(tree))


def test_a_row_repeated_often_fills_several_buckets(spark):
    rows = [(7, "again")] * 500 + [(i, f"t{i}") for i in range(300)]
    out = sharding.assign(docs_of(spark, rows).repartition(3), bucket_rows=20).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())


# -- one very long text, one hot id ------------------------------------------------------------


def test_long_texts(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(500)]
    long = " ".join(rng.choice(words, 200_000).tolist())
    rows = [(1, long), (2, long), (3, "w1 w2 w3"), (4, None), (5, "x" * 300_000), (6, "\n" * 100_000)]
    docs = docs_of(spark, rows)
    from tokenizers import Tokenizer

    from planweave.llm import tokens

    library = Tokenizer.from_file(tokens.default_vocabulary())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs).collect()} == {i: len(x) for i, x in ids.items()}
    assert {r.doc_id: r.ids_crc32 for r in wavelet.token_output(docs).collect()} == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in ids.items()}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_rows(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 4}
    item = " ".join(long.split()[199_000:199_010])
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, bench).collect()}
    assert hit[1] == hit[2] == 10 and not any(hit[i] for i in (3, 4, 5, 6))
    sizes = {r.doc_id: r.size for r in mixing.mixed_rows(docs).collect()}
    assert sizes == {1: 200_000, 2: 200_000, 3: 3, 4: 0, 5: 1, 6: 0}


@pytest.mark.parametrize("operator", [lambda d: wavelet.token_output(d, partitions=4), lambda d: tokencount.token_counts(d), lambda d: simhash.near_duplicate_rows(d)])
def test_one_id_of_most_rows(spark, operator):
    rows = [(7, f"text {i % 50}") for i in range(600)] + [(i, "other") for i in range(20)]
    out = operator(docs_of(spark, rows).repartition(3)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)


def test_clashing_columns_are_ignored(spark):
    """Operators that return columns of their own take no notice of other columns' names."""
    rows = [(i, f"some words {i}") for i in range(30)]
    plain = docs_of(spark, rows)
    clash = plain
    for c in ("shard", "slot", "row", "bucket", "_k", "fp", "path", "ordinal", "n_tokens", "key", "words", "hit_id", "h", "size", "tie", "text_hash"):
        clash = clash.withColumn(c, F.lit("z"))
    bench = spark.createDataFrame([(1, "words 3", "q")], "item_id long, text string, words string")
    for f in (sharding.assign, simhash.near_duplicate_rows, tokencount.token_counts, wavelet.token_output, lambda d: mixing.mixed_rows(d), lambda d: decontaminate.contamination(d, bench)):
        assert sorted(map(str, f(clash).collect())) == sorted(map(str, f(plain).collect()))
    pages = spark.createDataFrame([(1, "u", "html", "x", "y")], "page_id long, url string, html string, payload string, sha1 string")
    assert warc.archived_pages(pages).count() == 1


def pipeline_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "one two three")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_of_odd_tables(spark, tmp_path):
    rows = [(i, f"plain words number {i} " + "zwicky " * (i % 2)) for i in range(40)] + [(3, "plain words number 3 zwicky ")] * 3 + [(None, None), (None, "lonely words"), (90, "has one two three inside")]
    odd = docs_of(spark, rows).withColumns({"_score": F.lit(0.5), "_size": F.lit(1), "_hash": F.lit("h"), "row": F.lit(2), "group": F.lit("g")})
    pipeline_tables(spark, tmp_path, odd)
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = Counter(r.doc_id for r in out)
    assert 90 not in kept and max(kept.values()) <= 3 and {r.doc_id for r in docs.collect()} == set(kept)


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline_tables(spark, tmp_path, docs_of(spark, []))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.keep_clean(docs_of(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert nearcopies.keep_one(docs_of(spark, [])).count() == 0
