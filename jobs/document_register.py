"""Register of the written documents that go with a set of drawings.

Every document of a source is set in columns of a note sheet: its width in Helvetica gives its
lines, its lines the sheets it takes. Documents of a source get their sheet numbers in order of
their ids; one whose text the source already has takes no sheet and points to the first. The
register is written by source, and beside it an index of the longest documents of each source with
a line that says how many more there are.

    python -m jobs.document_register INPUT OUTPUT [--config FILE]

INPUT: doc_id, text, lang, source (Parquet). OUTPUT: measured/ (the documents without their texts, in
blocks of the order of their ids), register/ and index/ (by source). Each run works out everything
from the input and replaces the output, so that a run that is repeated, after a failure or not, gives
the same result.

A source with a third of all documents is as good as any: numbers are sums within blocks of the order
of ids, added to the sums of the blocks before. A null text is an empty one and takes no sheet; a null
id comes first and a null source is a source; rows that are alike are numbered one after the other;
an empty table gives an empty register; further columns are ignored; texts may be of any length."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions import text
from planweave.operators import ordered, select

from .common import main, write_counted

log = logging.getLogger("jobs.document_register")
MEASURED = "doc_id long, lang string, source string, digest string, title string, width double, lines long, sheets long, block int"
REGISTER = "doc_id long, lang string, title string, width double, lines long, sheets long, same_as long, first_sheet string, last_sheet string, source string"


def measured(docs: DataFrame, config: dict) -> DataFrame:
    """Documents without their texts: width in points, lines and sheets if set on their own."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    width = text.document_width(body, config["font_size"])
    breaks = F.length(body) - F.length(F.translate(body, "\n", ""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.sha2(body.cast("binary"), 256).alias("digest"), text.escape_markup(F.substring(body, 1, config["title_characters"])).alias("title"),
        width.alias("width"), breaks.cast("long").alias("breaks"),
    )
    lines = F.ceil(F.col("width") / config["column_points"]).cast("long") + F.col("breaks")
    return sized.withColumn("lines", lines).withColumn("sheets", F.ceil(F.col("lines") / config["lines_a_sheet"]).cast("long")).drop("breaks")


def register(rows: DataFrame, config: dict) -> DataFrame:
    """``measured`` rows with a block number -> the register."""
    groups = rows.groupBy("source", "digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("source").alias("of"), F.col("digest").alias("text_of"), "first")
    at = rows.join(groups, F.col("source").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text_of")), "left").drop("of", "text_of")
    same = F.when(F.col("doc_id") != F.col("first"), F.col("first"))
    taken = at.withColumn("same_as", same).withColumn("sheets", F.when(same.isNotNull(), 0).otherwise(F.col("sheets")))
    summed = ordered.running_total(taken, ["source"], "block", ["doc_id", "digest"], "sheets", "upto")
    label = lambda number: F.when(F.col("sheets") > 0, F.concat(F.lit(config["prefix"]), F.lpad(number.cast("string"), F.greatest(F.length(number.cast("string")), F.lit(2)), F.lit("0"))))
    return summed.select("doc_id", "lang", "title", "width", "lines", "sheets", "same_as", label(F.col("upto") - F.col("sheets") + 1).alias("first_sheet"), label(F.col("upto")).alias("last_sheet"), "source")


def run(spark: SparkSession, source: str, output: str, config: dict) -> None:
    """Write the register of the documents at ``source``."""
    docs = spark.read.parquet(source)
    count = docs.count()
    log.info("read %d documents of %s", count, source)
    blocks = -(-count // config["rows_a_block"]) or 1
    # the written block numbers are what keeps the order: nothing later deals the rows out again
    dealt = measured(docs, config).repartitionByRange(blocks, F.col("doc_id").asc_nulls_first(), "digest")
    dealt.withColumn("block", F.spark_partition_id()).write.mode("overwrite").parquet(f"{output}/measured")
    rows = spark.read.schema(MEASURED).parquet(f"{output}/measured")
    kept = register(rows, config)
    _replace(kept, f"{output}/register", "register")
    written = spark.read.schema(REGISTER).parquet(f"{output}/register")
    listed = written.filter("same_as is null").withColumn("entry", F.concat_ws(" ", "first_sheet", "title"))
    index = select.with_overflow(listed, ["source"], [F.desc("lines"), "doc_id", "title"], config["listed"], "entry", "+%d more")
    _replace(index.select("position", "label", "source"), f"{output}/index", "index")


def _replace(df: DataFrame, path: str, what: str) -> None:
    """Write the whole of a table anew, by source."""
    df.repartition("source", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy("source").parquet(path)
    log.info("wrote %d rows of the %s to %s", df.sparkSession.read.schema(df.schema).parquet(path).count(), what, path)


def result(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REGISTER).parquet(f"{output}/register").withColumn("width", F.round("width", 6))


def sql(config: dict) -> str:
    """DuckDB SQL for ``result``."""
    count = lambda chars: "(length(body) - length(translate(body, '{}', '')))".format("".join(chars).replace("'", "''"))
    by_width: dict[int, list[str]] = {}
    for code, w in enumerate(text.REGULAR, 32):
        by_width.setdefault(w, []).append(chr(code))
    special = " + ".join(f"{w - text.OTHER} * {count(chars)}" for w, chars in sorted(by_width.items()) if w != text.OTHER)
    first = config["title_characters"]
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS body FROM documents),
m AS (
  SELECT doc_id, lang, source, sha256(body) AS digest,
         replace(replace(replace(replace(substr(body, 1, {first}), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS title,
         ({text.OTHER} * length(body) + {special}) * {config['font_size']}::DOUBLE / 1000 AS width,
         length(body) - length(replace(body, chr(10), '')) AS breaks FROM d),
l AS (SELECT *, CAST(ceil(width / {config['column_points']}::DOUBLE) AS BIGINT) + breaks AS lines, min(doc_id) OVER (PARTITION BY source, digest) AS first FROM m),
s AS (SELECT *, CASE WHEN doc_id <> first THEN first END AS same_as, CASE WHEN doc_id <> first THEN 0 ELSE CAST(ceil(lines / {config['lines_a_sheet']}) AS BIGINT) END AS sheets FROM l),
u AS (SELECT *, CAST(sum(sheets) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM s)
SELECT doc_id, lang, title, round(width, 6) AS width, lines, sheets, same_as, source,
       CASE WHEN sheets > 0 THEN '{config['prefix']}' || lpad(CAST(upto - sheets + 1 AS VARCHAR), greatest(2, length(CAST(upto - sheets + 1 AS VARCHAR)))::INT, '0') END AS first_sheet,
       CASE WHEN sheets > 0 THEN '{config['prefix']}' || lpad(CAST(upto AS VARCHAR), greatest(2, length(CAST(upto AS VARCHAR)))::INT, '0') END AS last_sheet
FROM u
"""


if __name__ == "__main__":
    main("document_register", "Write the sheet register of the documents.", run)
