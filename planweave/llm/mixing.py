"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Every source gets a budget of words (targets below). A budget of r times the source's
size is floor(r) whole passes and, for the rest, one more pass over the documents whose
hash lies below a threshold. The threshold is found without sorting documents: words
are summed by source and by the top 12 bits of a 60-bit hash of id and text on the scan,
the bucket in which the running sum meets the budget is refined by the next 12 bits, and
so on; each level aggregates only the documents of the open buckets (map-side combined),
keeps at most 4096 rows a source, and nests inside the level before it. Selection is then
a map over the documents against one row a source. Thresholds are nested: a larger budget
keeps every document that a smaller one took. Rows of one id and text share a hash; where
the budget ends among them, some of these copies are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
BITS = 60
STEP = 12
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, the same on every run and engine."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x01"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sizes(source, source_size)``, one row a source -> the same with ``target``.

    Sources in code point order, null last, weigh 5, 2, 1, repeating, and share the sum
    of all sizes; a target stops at ``cap`` times its source and the excess is shared
    again by weight. The end of that process is min(cap * size, level * weight) with one
    level for all, found by one running sum over sources in the order in which they
    reach their caps. The table has one row a source, whatever the documents' number.
    """
    alphabet = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(alphabet) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    open_ = weighed.withColumn("level", level).withColumn("free", F.col("most") > F.col("level") * F.col("weight"))
    # Once one source in this order is below its cap, all later ones are, at the same level.
    final = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("level"))))
    common = final.over(Window.partitionBy(F.lit(1)))["level"]
    return open_.select("source", "source_size", F.coalesce(F.when(F.col("free"), common * F.col("weight")), F.col("most")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``rows(source, h, size)``, ``budgets(source, rest)`` -> ``(source, below, copies, of)``:
    taking the rows with ``h < below`` and ``copies`` of the ``of`` rows with ``h = below``
    (rows of one hash have one size) comes as near to ``rest`` as whole rows in the order of
    hashes allow."""
    found = budgets.select("source", F.lit(0).cast("long").alias("low"), F.col("rest"))
    for level in range(BITS - STEP, -1, -STEP):
        # rows of a source whose hash starts like the open bucket
        wide = level + STEP
        mine = rows if wide == BITS else rows.join(found.select(F.col("source").alias("s"), F.col("low").alias("l")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", wide) == F.shiftright("l", wide))).select("source", "h", "size")
        hist = mine.groupBy("source", F.shiftright("h", level).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        joined = hist.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "inner")
        run = Window.partitionBy("source").orderBy("bucket")
        run_before = F.coalesce(F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # the first bucket whose end reaches the budget stays open; past the last bucket, nothing does
        reached = F.when(F.col("before") + F.col("words") >= F.col("rest"), F.struct("bucket", "before", "words", "n"))
        got = joined.withColumn("before", run_before).groupBy("source").agg(F.min(reached).alias("p"), F.first("rest").alias("rest"))
        if level:
            low = F.coalesce(F.shiftleft(F.col("p.bucket"), level), F.lit((1 << BITS) - 1))
            found = materialize(got.select("source", low.alias("low"), (F.col("rest") - F.coalesce(F.col("p.before"), F.lit(0))).alias("rest")), "thresholds")
    # Rows of one hash: stop before or after the one in which the budget ends, whichever is nearer.
    need, one = F.col("rest") - F.col("p.before"), F.col("p.words") / F.col("p.n")
    upto = F.ceil(need / one)
    copies = F.when(upto < 1, 0).when(upto * one - need < need - (upto - 1) * one, upto).otherwise(upto - 1)
    return got.select("source", F.coalesce(F.col("p.bucket"), F.lit(1 << BITS)).alias("below"), F.coalesce(copies, F.lit(0)).cast("long").alias("copies"), F.coalesce("p.n", F.lit(0)).cast("long").alias("of"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, columns: list | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with size, source_size, target, passes and taken under
    fresh names if they clash: returns ``columns + [size, source_size, target, taken]``.

    taken = size * passes. Null and wordless texts have size 0 and take 0; a null source
    is a source of its own; null and repeated ids are told apart by their texts, and of equal
    rows as many are taken as come nearest to the target; an empty table gives none; a source
    of size 0 has target 0.
    """
    rows = materialize(docs.select("source", order_hash(F.col("doc_id"), F.col("text")).alias("h"), words(F.col("text")).alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialize(targets(sizes, weights, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio + 1e-12), F.lit(int(cap)))
    plan = goal.withColumn("whole", whole)
    budgets = plan.select("source", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)).alias("rest"))
    cut = thresholds(rows.filter("size > 0"), budgets)
    none = F.lit(0).cast("long")
    of_source = plan.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = materialize(of_source.select("source", "source_size", "target", "whole", *[F.coalesce(c, none).alias(c) for c in ("below", "copies", "of")]), "mix")
    c = fresh(docs, "size", "source_size", "target", "taken", "key", "whole", "below", "h", "copies", "of")
    size, source_size, target, taken, key, whole_c, below, h, copies, of = c
    kept = columns or docs.columns
    own = docs.select(*kept, F.col("source").alias(key), words(F.col("text")).alias(size), order_hash(F.col("doc_id"), F.col("text")).alias(h))
    side = plan.select(F.col("source").alias("plan_source"), *[F.col(a).alias(b) for a, b in (("source_size", source_size), ("target", target), ("whole", whole_c), ("below", below), ("copies", copies), ("of", of))])
    joined = own.join(side, F.col(key).eqNullSafe(F.col("plan_source")), "left")
    split = (F.col(h) == F.col(below)) & (F.col(copies) > 0) & (F.col(copies) < F.col(of)) & (F.col(size) > 0)

    def out(table, more):
        passes = F.col(whole_c) + F.when(more & (F.col(whole_c) < int(cap)), 1).otherwise(0)
        return table.select(*kept, size, source_size, target, (F.col(size) * passes).cast("long").alias(taken))

    clear = (F.col(h) < F.col(below)) | ((F.col(h) == F.col(below)) & (F.col(copies) == F.col(of)))
    if not plan.filter("copies > 0 and copies < of").head(1):
        return out(joined, clear)
    # Some of equal rows: these rows are written, and their places in the files number them.
    tied = materialize(joined.filter(split), "tied")
    place = tied.select("*", F.col("_metadata.file_path").alias("tied_path"), F.col("_metadata.row_index").alias("tied_row"))
    counts = materialize(place.groupBy("tied_path", key).agg(F.count("*").alias("tied_n"), F.min("tied_row").alias("tied_first")), "tied-files")
    before = Window.partitionBy(key).orderBy("tied_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("tied_path").alias("p"), F.col(key).alias("k"), F.coalesce(F.sum("tied_n").over(before), none).alias("tied_before"))
    inside = Window.partitionBy("tied_path", key).orderBy("tied_row")  # one task's file
    numbered = place.withColumn("tied_rank", F.row_number().over(inside) - 1).join(offsets, (F.col("tied_path") == F.col("p")) & F.col(key).eqNullSafe(F.col("k")))
    return out(joined.filter(~F.coalesce(split, F.lit(False))), clear).unionByName(out(numbered, F.col("tied_before") + F.col("tied_rank") < F.col(copies)))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """Digest of ``mix``: doc_id, size, source_size, target, taken."""
    slim = docs.select("doc_id", "text", "source")
    return mix(slim, columns=["doc_id"]).toDF("doc_id", "size", "source_size", "target", "taken")


def repeat(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``docs`` as the mix reads it: each document once a pass it takes, all columns pass.
    Documents without words have nothing to take and go."""
    mixed = mix(docs, weights, cap)
    names = mixed.columns[len(docs.columns) :]
    size, taken = names[0], names[3]
    (turn,) = fresh(mixed, "turn")
    times = F.when(F.col(size) > 0, (F.col(taken) / F.col(size)).cast("int")).otherwise(0)
    return mixed.filter(F.col(taken) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
