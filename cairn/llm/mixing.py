"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

A document's size is the number of ``[^\\x20\\x09-\\x0D]+`` in its text.  Each
source is given its share, by weight, of the budget; a share above ``max_epochs``
times the source's size is clamped to that, and the excess is shared among the
others by weight, until none is above.  In order of clamp over weight the
clamped sources are a prefix, so the level at which the water stands follows from
running sums over one row a source.

A source's rate, target over size, is whole repetitions plus a fraction.  Every
document is taken the whole number of times; which take the fractional repetition
is settled from the largest size to the smallest.  Of the n documents of one size
as many are taken as come nearest to what is still missing to the source's target
up to there, rounded by a seeded start, and the remainder is carried on to the next
size.  So a document is drawn with about the probability of the fraction, and a
source's words end within about its smallest documents of the target.  Among
equal sizes the smallest seeded digests are taken, of one id by a digest of the text.

The carrying fold runs over one array of (size, count) for each source, as long as
the source has distinct sizes; rows aren't gathered.  Ranks by digest aren't a
window over a source or a size either, since one text may be a third of all rows:
a size with more than ``GROUP_ROWS`` documents is cut into buckets by the first
digits of the digest, running counts over the buckets give each bucket's first
rank, and rows are numbered within a bucket.

Defined results: a null text or one without words has the size 0 and is taken 0
times its rate's words; a null source is a source, last in order; repeated rows
are documents of their own; a null doc_id is like an id of its own text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20
GROUP_ROWS = 512
_BLOCK = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), a row a source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(max_epochs))
    # the source that is clamped first has the least room for its weight
    by_room = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    after = by_room.rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(W.partitionBy()) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    open_ = F.col("most") / F.col("weight") > F.col("level")
    level = F.min(F.when(open_, F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(W.partitionBy())["level"]
    rows = rows.withColumn("water", level)
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.col("water")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _digest(doc_id: Column, size: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string")))


def _source_key(source: Column) -> Column:
    """A key without nulls in the same order: a null comes after every string."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source))


def _extra_by_size(counted: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    """(key, size, extra, source_size, target, whole): how many documents of each size take one repetition more."""
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "key", F.col("size").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    sizes = counted.withColumn("u", chance).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("size", "n", "u")), asc=False).alias("sizes"))
    sizes = sizes.join(goal, "key")
    zero = F.lit(0.0)

    def take(state, g):
        size, n = g["size"].cast("double"), g["n"].cast("double")
        due = state["left"] + F.col("part") * n * size
        count = F.when(g["size"] > 0, F.floor(due / F.greatest(size, F.lit(1.0)) + g["u"])).otherwise(F.floor(F.col("part") * n + g["u"]))
        count = F.greatest(F.lit(0).cast("bigint"), F.least(g["n"], count))
        return F.struct((due - count.cast("double") * size).alias("left"), F.concat(state["taken"], F.array(count)).alias("taken"))

    none = F.array().cast("array<bigint>")
    # blocks keep the growing arrays short, so that the fold is linear
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / _BLOCK).cast("int")), lambda i: F.slice(F.col("sizes"), i * _BLOCK + 1, F.lit(_BLOCK)))

    def block(state, part):
        inner = F.aggregate(part, F.struct(state["left"].alias("left"), none.alias("taken")), take)
        return F.struct(inner["left"].alias("left"), F.concat(state["parts"], F.array(inner["taken"])).alias("parts"))

    taken = F.flatten(F.aggregate(blocks, F.struct(zero.alias("left"), F.array().cast("array<array<bigint>>").alias("parts")), block)["parts"])
    rows = sizes.select("key", "source_size", "target", "whole", F.explode(F.arrays_zip(F.col("sizes").alias("g"), taken.alias("extra"))).alias("x"))
    return rows.select("key", F.col("x.g.size").alias("size"), F.col("x.extra").alias("extra"), "source_size", "target", "whole")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repeats) of every document, then the columns named in ``keep``."""
    stored = Stored(docs.sparkSession)
    keep = keep or []
    size = word_count(F.col(text))
    slim = docs.select(F.col(doc_id).alias("doc_id"), _source_key(F.col(source).cast("string")).alias("key"), size.alias("size"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    slim = slim.withColumn("digest", _digest(F.col("doc_id"), F.col("size"), seed))
    if not keep:  # small rows that are read twice
        slim = stored.put(slim, "sizes")
    counted = stored.put(slim.groupBy("key", "size").agg(F.count("*").alias("n")), "counts")
    sources = counted.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sources.withColumnRenamed("key", "source"), weights, max_epochs, share).withColumnRenamed("source", "key")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_epochs)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    goal = goal.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    goal = goal.select("key", F.col("source_size").cast("bigint").alias("source_size"), "target", "whole", "part")
    shares = _extra_by_size(counted, goal, seed)

    # a bucket is a prefix of the digest, so the order by (size, bucket, digest) is the one by (size, digest)
    digits = F.least(F.lit(8), F.ceil(F.log(16.0, F.col("n") / float(GROUP_ROWS)))).cast("int")
    wide = counted.filter(F.col("n") > GROUP_ROWS).select("key", "size", digits.alias("digits"))  # a row for GROUP_ROWS documents at most
    rows = slim.join(wide, ["key", "size"], "left").withColumn("bucket", F.substring("digest", F.lit(1), F.coalesce("digits", F.lit(0)))).drop("digits")
    large = rows.join(wide.select("key", "size"), ["key", "size"], "left_semi").groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    small = counted.filter(F.col("n") <= GROUP_ROWS).select("key", "size", F.lit("").alias("bucket"), "n")
    before = W.partitionBy("key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    groups = small.unionByName(large).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    groups = groups.join(shares, ["key", "size"])
    rank = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("digest", F.col("doc_id").asc_nulls_last(), "text_key"))
    rows = rows.withColumn("rank", rank).join(groups, ["key", "size", "bucket"])
    repeats = F.col("whole") + F.when(F.col("first") + F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.cast("int").alias("repeats"), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its columns and, last, ``repeat`` from 1."""
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    at = {k: f"c{columns.index(options.pop(k, k))}" for k in ("doc_id", "text", "source")}
    out = mix(named, **at, **options, keep=named.columns)
    out = out.filter("repeats > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "repeat")
