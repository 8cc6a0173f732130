"""SimHash fingerprints of documents, native.

Terms are pairs of neighbouring words (and the last word); a term weighs more
the longer its first word is. Every term's 64-bit hash votes on
each bit with its weight. The votes of a text are summed in packed counters,
three to a long, over stretches of at most ``STRETCH`` terms, so a very long
text is spread over tasks and no counter overflows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut, need

BITS = 64
#: Bits that near fingerprints differ in at most, and blocks of bits of the tables: 20 tables whose keys are about 32 bits.
RADIUS, BLOCKS = 3, 6
#: Rows of at most three longs that are broadcast; beyond, they are joined.
MAX_SMALL = 1_000_000
#: Terms counted in one set of packed counters: STRETCH * MAX_WEIGHT stays under 2**21.
STRETCH, MAX_WEIGHT = 1 << 17, 8
#: Rows of one bucket of neighbouring doc_ids; bounds what a window task sorts at once.
BUCKET_ROWS = 1000
#: A bucket of equal width may hold so many times BUCKET_ROWS before ranges are cut by sampling instead.
UNEVEN = 8
_FIELD = 1 | (1 << 21) | (1 << 42)


def fingerprints(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns and ``fingerprint`` (16 hex digits) of every row; ``key`` must be unique.

    Null, empty and blank texts have no terms and the fingerprint of all zeros.
    """
    w = texts.select(*key, F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\u000b\f\r", "     "), " "), lambda x: x != "").alias("__w"))
    hashed = w.select(*key, F.transform("__w", lambda x, i: F.struct(F.xxhash64(x, F.get("__w", i + 1)).alias("h"), F.least(F.lit(MAX_WEIGHT), 1 + F.shiftright(F.length(x), 2)).alias("w"))).alias("__t"))
    long = hashed.select(*key, F.posexplode_outer("__t").alias("__i", "__x")).select(*key, F.shiftright(F.coalesce("__i", F.lit(0)), STRETCH.bit_length() - 1).alias("__s"), F.coalesce("__x.h", F.lit(0)).alias("__h"), F.coalesce("__x.w", F.lit(0)).cast("long").alias("__w"))
    lanes = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(F.lit(_FIELD)) * F.col("__w")).alias(f"__v{j}") for j in range(21)]
    lanes.append(F.sum(F.shiftrightunsigned("__h", 63) * F.col("__w")).alias("__v21"))
    packed = long.groupBy(*key, "__s").agg(F.sum("__w").alias("__total"), *lanes)
    votes = [F.shiftrightunsigned(f"__v{bit % 21 if bit < 63 else 21}", 21 * (bit // 21 % 3)).bitwiseAND(F.lit((1 << 21) - 1)) for bit in range(BITS)]
    whole = packed.groupBy(*key).agg(F.sum("__total").alias("__total"), *[F.sum(b).alias(f"__b{i}") for i, b in enumerate(votes)])
    # 16 groups of four bits, each a hex digit: the value is never one deep expression
    digits = []
    for d in range(15, -1, -1):
        four = sum((F.when(2 * F.col(f"__b{4 * d + i}") > F.col("__total"), 1 << i).otherwise(0) for i in range(1, 4)), F.when(2 * F.col(f"__b{4 * d}") > F.col("__total"), 1).otherwise(0))
        digits.append(F.substr(F.lit("0123456789abcdef"), four + 1, F.lit(1)))
    return whole.select(*key, F.concat(*digits).alias("fingerprint"))


def as_long(fingerprint: Column) -> Column:
    """The 64 bits of a fingerprint as a long."""
    high = F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(fingerprint, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(as_long(a).bitwiseXOR(as_long(b))) / F.lit(float(BITS))


def _some(df: DataFrame) -> DataFrame:
    """``df``, a frame from ``cut``, broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_SMALL else df


def _masks(radius: int, blocks: int) -> list[int]:
    """Permuted block tables: of ``blocks`` equal blocks of bits, at least ``blocks - radius`` agree in two fingerprints ``radius`` apart; a mask for each choice of that many."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in keep) for keep in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _tables(one: DataFrame, masks: list[int]) -> DataFrame:
    """A row of each fingerprint for each table: t, the agreeing bits k, and all bits."""
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.col("bits").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)])
    return one.select("bits", F.explode(table).alias("x")).select("x.t", "x.k", "bits")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, distance): all pairs of different fingerprints at most ``radius`` bits apart, a < b.

    A pair is kept only in the first table in which it meets. Equal fingerprints are
    one row here: copies cost nothing; ``prints`` joins the pairs back to its rows.
    A dense cluster gives all its pairs: ``near_classes`` does without them.
    """
    one = prints.select("fingerprint").where("fingerprint is not null").distinct().withColumn("bits", as_long(F.col("fingerprint")))
    masks = _masks(radius, blocks)
    rows = _tables(one, masks)
    a, b = rows.alias("p"), rows.alias("q")
    apart = F.col("p.bits").bitwiseXOR(F.col("q.bits"))
    met = F.col("p.t") == F.array_min(F.array(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, i).otherwise(len(masks)) for i, m in enumerate(masks)]))
    pairs = a.join(b, (F.col("p.t") == F.col("q.t")) & (F.col("p.k") == F.col("q.k")) & (as_hex("p.bits") < as_hex("q.bits")) & (_apart("p.bits", "q.bits") <= radius) & met)
    return pairs.select(as_hex("p.bits").alias("a"), as_hex("q.bits").alias("b"), _apart("p.bits", "q.bits").alias("distance"))


def as_hex(bits: str) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def near_classes(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(bits, class) of the fingerprints (as longs) that others are at most ``radius`` bits from; class: the least that links reach.

    The block tables without their pairs: in each group of a table all are compared
    with the least one, a row each. Groups whose members are not of one class by then
    are compared in full, but only links between classes come out of that.
    """
    one = cut(prints.select(as_long(F.col("fingerprint")).alias("bits")).where("bits is not null").distinct())
    rows = _tables(one, _masks(radius, blocks))
    hubs = _some(cut(rows.groupBy("t", "k").agg(F.min("bits").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "k", "hub")))
    grouped = cut(rows.join(hubs, ["t", "k"]))
    links = cut(grouped.where((F.col("bits") != F.col("hub")) & (_apart("bits", "hub") <= radius)).select("bits", "hub").distinct())
    first = cut(components(links, "bits", "hub").toDF("bits", "class"))
    classed = grouped.join(_some(first), "bits", "left").select("t", "k", "bits", F.coalesce("class", "bits").alias("class"))
    mixed = _some(cut(classed.groupBy("t", "k").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("t", "k")))
    left = cut(classed.join(mixed, ["t", "k"], "left_semi"))
    p, q = left.toDF("t", "k", "bits", "class"), left.toDF("t", "k", "bits2", "class2")
    across = cut(p.join(q, ["t", "k"]).where((F.col("class") < F.col("class2")) & (_apart("bits", "bits2") <= radius)).select("class", "class2").distinct())
    second = _some(cut(components(across, "class", "class2").toDF("class", "root")))
    # classes of one fingerprint are in no component so far
    named = first.union(across.select(F.explode(F.array("class", "class2")).alias("bits")).select("bits", F.col("bits").alias("class"))).distinct()
    return named.join(second, "class", "left").select("bits", F.coalesce("root", "class").alias("class"))


def with_next(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, text (null: empty), place (``b``, ``n``) and ``next``: the text of the row after it in descending doc_id.

    The last row's next is the first row. Rows of equal doc_id follow each other in
    the order of their texts. Ranges of doc_id bucket the rows; a window looks ahead
    inside a bucket, and each bucket's first text, one row a bucket, is joined to the
    bucket before it. Rows of null doc_id come last.
    """
    docs = docs.select(*need(docs, "doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    buckets = max(1, stats["n"] // BUCKET_ROWS)
    lo, hi = stats["lo"] or 0, stats["hi"] or 0
    width = (hi - lo) // buckets + 1
    even = F.coalesce(F.floor((F.lit(hi) - F.col("doc_id")) / F.lit(width)), F.lit(buckets)).cast("int")
    most = docs.groupBy(even.alias("b")).count().agg(F.max("count")).first()[0] or 0
    if most <= UNEVEN * BUCKET_ROWS:
        placed = docs.withColumn("b", even)
    else:  # ids in clusters: Spark samples the ranges
        # written, as another run of the sampling could cut them elsewhere
        placed = cut(docs.repartitionByRange(buckets, F.desc_nulls_last("doc_id")).withColumn("b", F.spark_partition_id()))
    order = Window.partitionBy("b").orderBy(F.desc_nulls_last("doc_id"), "text")
    ahead = placed.select("b", "doc_id", "text", F.lead(F.struct("text")).over(order).alias("lead"), F.row_number().over(order).alias("n"))
    firsts = ahead.where("n = 1").select("b", "text")
    ring = Window.orderBy("b")
    after = firsts.select("b").select("b", F.coalesce(F.lead("b").over(ring), F.first("b").over(ring)).alias("to"))
    joint = after.join(firsts.select(F.col("b").alias("to"), F.struct("text").alias("first")), "to").select("b", "first")
    return ahead.join(joint, "b").select("b", "n", "doc_id", "text", F.coalesce("lead", "first")["text"].alias("next"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    Edited: the last floor(n_chars / 3) code points make way for the first as many of
    the next document, in descending doc_id. near_class is the smallest doc_id whose
    fingerprint links of at most RADIUS bits reach (null if none of them has one);
    texts without words all have the fingerprint of zeros, and so one class. Null texts count as empty; repeated rows
    each have a row; an empty table gives an empty result; other columns are dropped.
    """
    texts = with_next(docs)
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    texts = texts.select("b", "n", "doc_id", n.alias("n_chars"), "text", F.concat(F.substr("text", F.lit(1), n - tail), F.substr("next", F.lit(1), tail)).alias("edited"))
    about = texts.select("b", "n", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    both = texts.select("b", "n", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x")).select("b", "n", "x.kind", "x.text")
    prints = fingerprints(both, ["b", "n", "kind"])
    wide = prints.groupBy("b", "n").agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    rows = cut(about.join(wide, ["b", "n"]))
    order = Window.partitionBy("b").orderBy("n")
    firsts = rows.where("n = 1").select("b", "fingerprint")
    ring = Window.orderBy("b")
    after = firsts.select("b", F.coalesce(F.lead("fingerprint").over(ring), F.first("fingerprint").over(ring)).alias("first"))
    classes = _some(cut(near_classes(rows)))
    named = rows.withColumn("following", F.lead("fingerprint").over(order)).join(after, "b").withColumn("bits", as_long(F.col("fingerprint")))
    named = cut(named.join(classes, "bits", "left").withColumn("class", F.coalesce("class", "bits")).drop("bits"))
    least = cut(named.groupBy("class").agg(F.min("doc_id").alias("near_class")))
    out = named.join(least, "class")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("following", "first")).alias("near_next"), "near_class",
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
