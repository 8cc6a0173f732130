"""Mixing sources to target weights by pivotal dependent rounding, native.

Every document of a source is to be copied ratio = target / size-of-source
times. The whole part of the ratio is taken as it is; the fraction is rounded
to 0 or 1 so that a source's words stay at its target: two fractions at a time
exchange mass, counted in words, until one of them is 0 or 1; a coin weighted
by the room either way decides the direction, so that each document keeps its
probability. What remains of a block goes on to the next level of a reduction
tree; a source ends with at most one document whose rounding moves its words.

Blocks hold documents of like size, dealt by a hash, so that neither a source
with a third of all rows nor one size is ever in one task. A block folds inside
one row's array. Coins are hashes of doc_id, level and seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, need, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3.0
#: Documents of one block on average, and blocks that meet at the next level.
BLOCK = 64
SEED = 20
_EPS = 1e-9


def targets(sizes: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target of every source of ``sizes(source, size)``.

    Sources by code point, null last, weigh ``weights`` in turn and share all words;
    a target stops at ``ceiling`` times its source's words, and the rest is shared
    again by weight. At the end every source has least(weight * level, ceiling * words)
    of one level, which is found in the order of ceiling * words / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    per = per.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(rank, F.lit(len(weights))).cast("int")))
    per = per.withColumn("cap", F.lit(float(ceiling)) * F.col("source_size")).withColumn("at", F.col("cap") / F.col("w"))
    order = Window.orderBy("at", F.asc_nulls_last("source"))
    everything = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    # the first source, in that order, whose ceiling the level doesn't reach
    first = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", (-F.col("level")).alias("minus")))).over(everything)
    per = per.withColumn("level", -first["minus"])
    return per.select("source", "source_size", F.coalesce(F.least(F.col("w") * F.col("level"), "cap"), "cap").alias("target"))


def _id(prefix: str = "") -> list[Column]:
    """Whether doc_id is null, and doc_id: no real id stands for a null one."""
    return [F.col("doc_id").isNull().alias(f"{prefix}none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias(f"{prefix}id")]


def _coin(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items: Column) -> Column:
    """Struct of the one unit left open (null if none) and the units decided, by pivotal steps along ``items``."""
    unit = "struct<none:boolean,id:bigint,dup:int,size:bigint,p:double>"
    start = F.struct(F.lit(None).cast(unit).alias("open"), F.array().cast(f"array<{unit}>").alias("done"))
    whole = lambda u: (u["p"] <= _EPS) | (u["p"] >= 1 - _EPS)
    with_p = lambda u, p: F.struct(u["none"].alias("none"), u["id"].alias("id"), u["dup"].alias("dup"), u["size"].alias("size"), p.alias("p"))
    def step(acc, u):
        o = acc["open"]
        # mass in words: a takes from b at most up, gives b at most down
        up = F.least((1 - o["p"]) * o["size"], u["p"] * u["size"])
        down = F.least(o["p"] * o["size"], (1 - u["p"]) * u["size"])
        moved = F.when(_coin(o["id"], u["id"], o["dup"], u["dup"], o["none"], u["none"], F.lit(SEED)) < down / (up + down), up).otherwise(-down)
        a = with_p(o, o["p"] + moved / o["size"])
        b = with_p(u, u["p"] - moved / u["size"])
        pair = F.array(a, b)
        still = F.get(F.filter(pair, lambda x: ~whole(x)), F.lit(0))
        return (
            F.when(whole(u), F.struct(o.alias("open"), F.concat(acc["done"], F.array(u)).alias("done")))
            .when(o.isNull(), F.struct(u.alias("open"), acc["done"].alias("done")))
            .otherwise(F.struct(still.alias("open"), F.concat(acc["done"], F.filter(pair, whole)).alias("done")))
        )

    return F.aggregate(items, start, step)


def mix(docs: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of ``docs(doc_id, text, source)``.

    taken = copies * size words. Null texts have size 0 and nothing to take; null
    doc_ids and repeated rows are rows like others; a null source is a source; an
    empty table gives an empty result; other columns are dropped.
    """
    docs = docs.select(*need(docs, "doc_id", "text", "source"))
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(1))
    sizes = cut(sizes.withColumn("dup", F.row_number().over(same)))
    aims = cut(targets(sizes, weights, ceiling))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("whole", F.floor(ratio + _EPS)).withColumn("part", F.greatest(ratio - F.floor(ratio + _EPS), F.lit(0.0)))

    parts = aims.where(F.col("part") > _EPS).select(F.col("source").alias("s"), "part")
    open_ = sizes.where("size > 0").join(parts, F.col("source").eqNullSafe(F.col("s"))).select("source", *_id(), "dup", "size", F.col("part").alias("p"))
    # classes of like size: eight to a doubling
    open_ = open_.withColumn("c", F.floor(F.log2("size") * 8).cast("int"))
    dealt = open_.groupBy("source", "c").count().select(F.col("source").alias("s"), F.col("c").alias("k"), F.ceil(F.col("count") / BLOCK).alias("blocks"))
    open_ = open_.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("c") == F.col("k"))).withColumn("block", F.pmod(F.xxhash64("none", "id", "dup", F.lit(SEED)), F.col("blocks")))
    most = dealt.agg(F.max("blocks")).first()[0] or 0
    done = None
    levels, blocks = 1, most
    while blocks > 1:
        levels, blocks = levels + 1, -(-blocks // BLOCK)
    at = open_
    for level in range(levels + 1):
        last = level == levels  # all classes of a source meet: at most 8 * 63 units
        keys = ["source"] if last else ["source", "c", "block"]
        unit = F.struct("none", "id", "dup", "size", "p")
        # large documents first: the one left at the end is small
        items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), unit.alias("u")))), lambda x: x["u"])
        folded = at.groupBy(*keys).agg(items.alias("items")).select(*keys, _fold(F.col("items")).alias("f"))
        folded = cut(folded)
        decided = folded.select("source", F.explode("f.done").alias("u")).select("source", "u.*")
        done = decided if done is None else done.union(decided)
        at = folded.where("f.open is not null").select(*keys, "f.open.*")
        if not last:
            at = at.withColumn("block", F.floor(F.col("block") / BLOCK))
    final = at.select("source", "none", "id", "dup", "size", F.when(_coin(F.col("id"), F.col("dup"), F.col("none"), F.lit(SEED + 1)) < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    extra = done.union(final).where("p > 0.5").select(F.col("source").alias("s2"), "none", "id", F.col("dup").alias("d2"), F.col("size").alias("z2"), F.lit(1).alias("more"))
    out = sizes.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    out = out.join(extra, (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("doc_id").isNull() == F.col("none")) & F.col("source").eqNullSafe(F.col("s2")) & (F.col("dup") == F.col("d2")) & (F.col("size") == F.col("z2")), "left")
    copies = (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def take(docs: DataFrame, weights=WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, those without words once.

    Rows of one doc_id, source and text are interchangeable: together they are there
    as often as the mix takes them together.
    """
    names = docs.columns
    by = ["__none", "__id", "__s", "__z"]
    key = [*_id("__"), F.xxhash64("source").alias("__s")]
    decided = mix(docs, weights, ceiling).select(*key, F.col("size").alias("__z"), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("__copies"))
    # a key's numbers of copies with how many rows have each: a few, however often rows repeat
    times = decided.groupBy(*by, "__copies").agg(F.count(F.lit(1)).alias("__rows")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__copies", "__rows"))).alias("__all"))
    rows = docs.select(*names, *key, word_count(F.col("text")).alias("__z")).join(times, by)
    single = rows.where(F.size("__all") == 1).withColumn("__n", F.get("__all", F.lit(0))["__copies"])
    same = Window.partitionBy(*by).orderBy("text")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("n"))
    of_row = F.aggregate("__all", start, lambda acc, x: F.struct((acc["seen"] + x["__rows"]).alias("seen"), F.coalesce(acc["n"], F.when(F.col("__k") <= acc["seen"] + x["__rows"], x["__copies"])).alias("n")), lambda acc: acc["n"])
    mixed = rows.where(F.size("__all") > 1).withColumn("__k", F.row_number().over(same)).withColumn("__n", of_row).drop("__k")
    both = single.unionByName(mixed).where("__n > 0")
    return both.select(*names, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__i")).select(*names)
