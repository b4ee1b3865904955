"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source should be copied target / size times. The whole part
is certain; the fractions are rounded together: pairs of documents move words
from one to the other, at random and without bias, until one of the two fractions
is 0 or 1. The words of a source are kept at every step. Chunks of documents are
rounded within a row, each leaves one undecided document, and these are rounded
in chunks again, level by level, until a source has one left, which takes its
nearer end. Choices come from hashes, so reruns agree.

Defined results: a null text has size 0, and a source of size 0 the target 0;
equal rows are counted and rounded as one group whose members differ by one copy
at most; a null source is one source, last in order. Extra columns are kept by
``copy_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.runtime import broadcast_if_small, pin

WORD = r"[^\x20\x09-\x0D]+"
#: Documents or residuals rounded in one row of the tree.
FAN_IN = 64
#: Sources whose targets are broadcast.
MAX_SOURCES = 10_000
_UNIT = "struct<p:double,w:double,at:int>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(2**53))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``target`` words of each source: ``share`` of all words by weight, at most ``most`` times its own.

    Sources at their limit leave the rest to the others, by weight. With sources in
    order of limit per weight, those at the limit come first, which gives the level
    that the others reach. One row per source passes one task.
    """
    by_name = F.col("source").asc_nulls_last()  # bytes of UTF-8, which is the order of code points
    order = Window.orderBy(by_name)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    nth = F.row_number().over(order) - 1
    base = sizes.withColumn("weight", F.element_at(cycle, (nth % len(weights) + 1).cast("int")))
    base = base.withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    base = base.withColumn("_ratio", F.col("_limit") / F.col("weight"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("_ratio", by_name)
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    base = base.withColumn("_level", left / rest)
    # The first source whose limit is above the level sets the level of all after it.
    base = base.withColumn("_open", F.col("_level") < F.col("_ratio"))
    level = F.min(F.when(F.col("_open"), F.struct("_ratio", "_level"))).over(whole)["_level"]
    target = F.when(level.isNull(), F.col("_limit")).otherwise(F.least("_limit", level * F.col("weight")))
    return base.select("source", "source_size", "n_rows", F.round(target, 6).alias("target"))


def _round_chunk(units: Column, *key: Column) -> Column:
    """Round the fractions of an array of (p, w, at); gives the undecided last one and who took a copy.

    State: the undecided unit, the positions that took one, the number of steps.
    """
    none = F.lit(None).cast(_UNIT)
    start = F.struct(none.alias("rest"), F.array().cast("array<int>").alias("took"), F.lit(0).alias("n"))

    def unit(p: Column, of: Column) -> Column:
        return F.struct(p.alias("p"), of["w"].alias("w"), of["at"].alias("at"))

    def step(state: Column, new: Column) -> Column:
        old, n = state["rest"], state["n"] + 1
        up = F.least((1 - old["p"]) * old["w"], new["p"] * new["w"])  # words that may move to the old one
        down = F.least(old["p"] * old["w"], (1 - new["p"]) * new["w"])
        rise = uniform(*key, n) * (up + down) < down
        old_full = rise & ((1 - old["p"]) * old["w"] <= new["p"] * new["w"])
        new_empty = rise & ~old_full
        old_empty = ~rise & (old["p"] * old["w"] <= (1 - new["p"]) * new["w"])
        moved = F.when(rise, up).otherwise(-down)
        stay_old = unit(F.least(F.greatest(old["p"] + moved / old["w"], F.lit(0.0)), F.lit(1.0)), old)
        stay_new = unit(F.least(F.greatest(new["p"] - moved / new["w"], F.lit(0.0)), F.lit(1.0)), new)
        rest = F.when(old_full | old_empty, stay_new).otherwise(stay_old)
        took = (
            F.when(old_full, F.array_append(state["took"], old["at"]))
            .when(~old_empty & ~new_empty, F.array_append(state["took"], new["at"]))
            .otherwise(state["took"])
        )
        first = F.struct(new.alias("rest"), state["took"].alias("took"), n.alias("n"))
        next_ = F.struct(rest.alias("rest"), took.alias("took"), n.alias("n"))
        return F.when(old.isNull(), first).otherwise(next_)

    return F.aggregate(units, start, step)


def _tree(chunks: DataFrame, most_chunks: int) -> DataFrame:
    """source, chunk -> whether the chunk's undecided unit takes a copy.

    ``chunks``: source, chunk (numbered from 0 in its source), rest.
    """
    levels, now, n, level = [], chunks.select("source", "chunk", "rest"), most_chunks, 0
    while n > 1:
        level += 1
        n = -(-n // FAN_IN)
        children = now.withColumn("parent", F.floor(F.col("chunk") / FAN_IN).cast("long"))
        member = F.struct(F.lit(-1.0) * F.col("rest.w"), "chunk", "rest.p")
        grouped = children.groupBy("source", "parent").agg(F.array_sort(F.collect_list(member.cast("struct<nw:double,chunk:long,p:double>"))).alias("m"))
        units = F.transform("m", lambda m, i: F.struct(m["p"].alias("p"), (-m["nw"]).alias("w"), i.alias("at")))
        rounded = grouped.withColumn("r", _round_chunk(units, F.col("source"), F.col("parent"), F.lit(level)))
        rounded = pin(rounded.select("source", "parent", "m.chunk", F.col("r.rest").alias("rest"), F.col("r.took").alias("took")))
        levels.append(rounded)
        now = rounded.select("source", F.col("parent").alias("chunk"), "rest")
    wins = now.select("source", "chunk", (F.col("rest.p") >= 0.5).alias("win"))
    for rounded in reversed(levels):
        up = rounded.join(wins.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"), "win"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("parent") == F.col("_c")))
        each = up.select("source", "took", "rest", "win", F.posexplode("chunk").alias("at", "chunk"))
        took = F.array_contains("took", F.col("at")) | ((F.col("rest.at") == F.col("at")) & F.col("win"))
        wins = each.select("source", "chunk", took.alias("win"))
    return wins


def plan_mix(units: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Copies for rows of (key, source, size, ...): adds source_size, target and copies.

    Rows that are equal in all columns are one group of ``_n``; a group's odd copy goes to one of them.
    """
    columns = units.columns
    counted = pin(units.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))
    sizes = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("_n")).cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    targets = pin(source_targets(sizes, weights, share, most))
    chunks_of = F.ceil(F.col("n_rows") / FAN_IN).cast("long")
    most_chunks = targets.agg(F.max(chunks_of)).first()[0] or 1
    named = targets.withColumnRenamed("source", "_source")
    # One row per source; beyond the bound Spark splits the hot sources of a shuffled join.
    rows = counted.join(broadcast_if_small(named, MAX_SOURCES), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_rate", rate).withColumn("_copies", F.floor("_rate").cast("long"))
    rows = rows.withColumn("_odd", (F.col("_rate") - F.col("_copies")) * F.col("_n"))
    rows = rows.withColumn("_sure", F.floor("_odd").cast("long")).withColumn("_p", F.col("_odd") - F.col("_sure"))
    rows = rows.withColumn("_hash", F.xxhash64(*columns)).withColumn("chunk", F.pmod("_hash", chunks_of))
    carried = [*columns, "source_size", "target", "_n", "_copies", "_sure", "_p", "_hash"]
    member = F.struct((-F.col("size")).alias("neg"), "_hash", *[c for c in carried if c != "_hash"])
    grouped = rows.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(member)).alias("m"))
    open_ = F.filter(
        F.transform("m", lambda m, i: F.struct(m["_p"].alias("p"), m["size"].cast("double").alias("w"), i.alias("at"))),
        lambda u: (u["p"] > 0) & (u["w"] > 0),
    )
    decided = pin(grouped.withColumn("r", _round_chunk(open_, F.col("source"), F.col("chunk"), F.lit(0))))
    wins = _tree(decided.filter("r.rest is not null").select("source", "chunk", F.col("r.rest").alias("rest")), most_chunks)
    wins = wins.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"), "win")
    whole = decided.join(wins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")), "left")
    each = whole.select("chunk", F.col("r.rest.at").alias("_rest"), F.col("r.took").alias("_took"), "win", F.posexplode("m").alias("_at", "_m"))
    chosen = F.array_contains("_took", F.col("_at")) | ((F.coalesce(F.col("_rest"), F.lit(-1)) == F.col("_at")) & F.coalesce("win", F.lit(False)))
    empty = (F.col("_m.size") == 0) & (uniform(F.col("_m._hash"), F.lit("empty")) < F.col("_m._p"))
    extra = F.col("_m._sure") + F.when(chosen | empty, 1).otherwise(0)
    out = each.select("_m.*", extra.alias("_extra"))
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    copies = (F.col("_copies") + F.when(F.col("_k") <= F.col("_extra"), 1).otherwise(0)).cast("long")
    return out.select(*columns, "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``docs``."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = plan_mix(slim, weights, share, most)
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))


def copy_documents(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with its columns.

    Rows meet their copies by key, source, text and a number among equal rows.
    """
    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*columns)
    parts = {"id": F.col("doc_id"), "src": F.col("source"), "hash": F.xxhash64("text"), "crc": F.crc32(text.cast("binary"))}
    marked = docs.select(row.alias("row"), *[c.alias(n) for n, c in parts.items()])
    slim = docs.select(parts["id"].alias("id"), "source", parts["hash"].alias("hash"), parts["crc"].alias("crc"), word_count(F.col("text")).alias("size"))
    mixed = plan_mix(slim, weights, share, most)
    totals = mixed.groupBy("id", "source", "hash", "crc").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"))
    totals = totals.toDF("id2", "src2", "hash2", "crc2", "total", "rows")
    joined = marked.join(totals, [F.col(n).eqNullSafe(F.col(f"{n}2")) for n in parts])
    others = [F.col(f"row.{c}") for c in ("lang", "n_chars") if c in columns]
    nth = F.row_number().over(Window.partitionBy(*parts).orderBy(*(others or ["id"])))
    each = F.floor(F.col("total") / F.col("rows"))
    n = each + F.when(F.col("nth") <= F.col("total") - each * F.col("rows"), 1).otherwise(0)
    repeated = joined.withColumn("nth", nth).withColumn("n", n.cast("int")).filter("n > 0")
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


WEIGHTS = (3.0, 1.0, 2.0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_documents(docs, WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")
