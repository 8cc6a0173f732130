"""Ranked search: BM25 over text columns, vectors, and both by reciprocal ranks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wefthread.functions.text import MARKED, PLAIN, occurrences, tokens

K1, B = 1.2, 0.75
RRF_K, CANDIDATES = 60, 50


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Without:
    left: object
    right: object


class QueryError(ValueError):
    """A malformed query."""


_LEX = re.compile(r'\s*(?:(?P<quote>"(?:[^"]|"")*")|(?P<word>[^\s"():*^+{}\[\]\\/.,;!?\'<>=|&$#@%~`-]+)|(?P<sign>[()*:]))')


def tokens_of(text: str) -> list[str]:
    """The driver's form of ``tokens``."""
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(MARKED, PLAIN)))


def parse(query: str, columns: list[str]):
    """Barewords side by side must all match; AND, OR, NOT, "phrases", pre*, column:term and parentheses."""
    items, at = [], 0
    while at < len(query.rstrip()):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise QueryError(f"syntax error near {query[at:at + 10]!r}")
        items.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    if not items:
        raise QueryError("empty query")
    pos = 0

    def peek(k=0):
        return items[pos + k] if pos + k < len(items) else (None, None)

    def either():
        nonlocal pos
        parts = [both()]
        while peek() == ("word", "OR"):
            pos += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def both():
        nonlocal pos
        parts = [without()]
        while peek()[0] and peek()[1] not in ("OR", ")", "NOT"):
            if peek() == ("word", "AND"):
                pos += 1
            parts.append(without())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def without():
        nonlocal pos
        left = one()
        while peek() == ("word", "NOT"):
            pos += 1
            left = Without(left, one())
        return left

    def one():
        nonlocal pos
        kind, text = peek()
        if (kind, text) == ("sign", "("):
            pos += 1
            inner = either()
            if peek() != ("sign", ")"):
                raise QueryError("missing )")
            pos += 1
            return inner
        column = None
        if kind == "word" and peek(1) == ("sign", ":"):
            if text not in columns:
                raise QueryError(f"no such column: {text}")
            column = text
            pos += 2
            kind, text = peek()
        if kind not in ("quote", "word") or text in ("AND", "OR", "NOT"):
            raise QueryError("syntax error")
        pos += 1
        raw = text[1:-1].replace('""', '"') if kind == "quote" else text
        words = tuple(tokens_of(raw))
        if not words:
            raise QueryError("a term without letters or digits")
        prefix = peek() == ("sign", "*")
        pos += prefix
        return Phrase(words, prefix, column)

    tree = either()
    if pos != len(items):
        raise QueryError("syntax error")
    return tree


def phrases(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Without):
        return phrases(tree.left)
    return [p for part in tree.parts for p in phrases(part)]


@dataclass(frozen=True)
class Index:
    """An inverted index: postings(bucket, token, id, column, positions), lengths(id, d), and the corpus's rows and mean length."""

    postings: DataFrame
    lengths: DataFrame
    columns: tuple[str, ...]
    rows: int
    mean: float


#: Folders of postings by hash of the token: a query reads those of its words.
BUCKETS = 64
#: Characters of text whose postings one task makes, sorts and writes: what a task holds doesn't grow with the table.
BLOCK = 4 << 20


def postings(docs: DataFrame, id_col: str, columns: list[str], blocks: int) -> DataFrame:
    """(token, id, column, positions): texts are dealt by id, so no place of a word is dealt again."""
    toks = docs.select(id_col, *columns).repartition(blocks, id_col).select(F.col(id_col).alias("id"), *[tokens(F.col(c)).alias(c) for c in columns])
    place = lambda c: lambda t, i: F.struct(F.lit(c).alias("column"), i.alias("at"), t.alias("token"))
    flat = toks.select("id", F.explode(F.concat(*[F.transform(c, place(c)) for c in columns])).alias("x")).select("x.token", "id", "x.column", "x.at")
    return flat.groupBy("token", "id", "column").agg(F.sort_array(F.collect_list("at")).alias("positions"))  # no more places than a text has words


def write_index(docs: DataFrame, id_col: str, columns: list[str], folder: str) -> None:
    """Writes the postings of ``docs`` to ``folder``: a row for each token, document and column, sorted by token in each bucket's files.

    Texts are dealt by id, so all places of a token in a document are in one task: they are gathered there, and only postings are dealt by bucket.
    """
    size = docs.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long"))).first()[0] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BLOCK + 1)
    toks = docs.select(F.col(id_col).alias("id"), *[tokens(F.col(c)).alias(c) for c in columns])
    toks.select("id", sum((F.size(c) for c in columns), F.lit(0)).alias("d")).write.parquet(f"{folder}/lengths")
    posted = postings(docs, id_col, columns, blocks)
    posted = posted.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int"))
    # a frequent token's rows spread over tasks: the bucket alone would be one key
    spread = max(8, 2 * blocks // BUCKETS)
    posted.repartition(blocks, F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{folder}/postings")


def read_index(spark, folder: str, id_type: str, columns: list[str]) -> Index:
    lengths = spark.read.schema(f"id {id_type}, d int").parquet(f"{folder}/lengths")
    postings = spark.read.schema(f"token string, id {id_type}, column string, positions array<int>, bucket int").parquet(f"{folder}/postings")
    rows, mean = lengths.agg(F.count(F.lit(1)), F.avg("d")).first()
    return Index(postings, lengths, tuple(columns), rows, mean or 0.0)


def _less(i: int):
    return lambda x: x - i


def _counts(index: Index, p: Phrase, k: int) -> DataFrame:
    """(id, f): how often phrase number k stands in each document that has it."""
    post = index.postings if p.column is None else index.postings.where(F.col("column") == p.column)

    def word(i: int) -> DataFrame:
        w = p.words[i]
        if p.prefix and i == len(p.words) - 1:
            some = post.where(F.startswith("token", F.lit(w)))
            if len(p.words) == 1:
                return some.select("id", "column", "positions")
            return some.groupBy("id", "column").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        bucket = F.pmod(F.xxhash64(F.lit(w)), F.lit(BUCKETS)).cast("int")
        return post.where((F.col("bucket") == bucket) & (F.col("token") == w)).select("id", "column", "positions")

    rows = word(0)
    for i in range(1, len(p.words)):
        after = word(i).withColumnRenamed("positions", "after")
        met = F.array_intersect("positions", F.transform("after", _less(i)))
        rows = rows.join(after, ["id", "column"]).select("id", "column", met.alias("positions")).where(F.size("positions") > 0)
    return rows.groupBy("id").agg(F.sum(F.size("positions")).alias("f")).select("id", F.lit(k).alias("k"), "f")


def bm25_indexed(index: Index, query: str, limit: int | None = None) -> DataFrame:
    """(id, score) as from ``bm25``, read from an index: only postings of the query's words, and the lengths of what they match.

    Corpus statistics count all rows; ties go by id.
    """
    tree = parse(query, list(index.columns))
    found = phrases(tree)
    every = list(dict.fromkeys([*found, *_all(tree)]))
    number = {p: i for i, p in enumerate(every)}
    rows = None
    for p, k in number.items():
        own = _counts(index, p, k)
        rows = own if rows is None else rows.union(own)
    wide = rows.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("f"))), F.lit(0)).alias(f"__f{k}") for k in number.values()])
    stats = wide.agg(*[F.count_if(F.col(f"__f{k}") > 0).alias(f"__n{k}") for k in number.values()])
    f = {p: F.col(f"__f{k}") for p, k in number.items()}
    hits = wide.where(_matches(tree, f)).join(index.lengths, "id").crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for p in found:
        score = score + _gain(f[p], F.col(f"__n{number[p]}"), F.lit(index.rows), F.col("d"), F.lit(index.mean))
    out = hits.select("id", score.alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def _gain(tf: Column, n: Column, rows: Column, d: Column, mean: Column) -> Column:
    idf = F.log((rows - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * d / mean))


def _matches(t, f: dict) -> Column:
    if isinstance(t, Phrase):
        return f[t] > 0
    if isinstance(t, Without):
        return _matches(t.left, f) & ~_matches(t.right, f)
    out = None
    for part in t.parts:
        m = _matches(part, f)
        out = m if out is None else (out & m if isinstance(t, Both) else out | m)
    return out


def bm25(docs: DataFrame, id_col: str, columns: list[str], query: str, keep: Column | None = None, limit: int | None = None) -> DataFrame:
    """(id_col, score) of the rows that match, best first in ``limit``; ties by id.

    For tables without an index, as a store's symbols, whose texts are short. Corpus
    statistics count all rows, ``keep`` filters results only. Counts are made row by
    row where the text is read; only one row of statistics is sent around.
    """
    tree = parse(query, columns)
    found = phrases(tree)
    every = list(dict.fromkeys(found))
    bare = {c: F.col(f"__t_{c}") for c in columns}
    rows = docs.select(id_col, (F.lit(True) if keep is None else keep).alias("__keep"), *[tokens(F.col(c)).alias(f"__t_{c}") for c in columns])

    def count(p: Phrase) -> Column:
        return sum((occurrences(bare[c], list(p.words), p.prefix) for c in columns if p.column in (None, c)), F.lit(0))

    others = [p for p in _all(tree) if p not in every]
    f = {p: f"__f{i}" for i, p in enumerate([*every, *others])}
    rows = rows.select(id_col, "__keep", sum((F.size(t) for t in bare.values()), F.lit(0)).alias("__d"), *[count(p).alias(n) for p, n in f.items()])
    stats = rows.agg(F.count(F.lit(1)).alias("__n"), F.avg("__d").alias("__avg"), *[F.count_if(F.col(f[p]) > 0).alias(f"__n{f[p]}") for p in every])
    hits = rows.where(_matches(tree, {p: F.col(n) for p, n in f.items()}) & F.col("__keep")).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for p in found:
        score = score + _gain(F.col(f[p]), F.col(f"__n{f[p]}"), F.col("__n"), F.col("__d"), F.col("__avg"))
    out = hits.select(id_col, score.alias("score"))
    return out.orderBy(F.desc("score"), id_col).limit(limit) if limit else out


def _all(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Without):
        return _all(tree.left) + _all(tree.right)
    return [p for part in tree.parts for p in _all(part)]


def cosine(vector: Column, query: list[float]) -> Column:
    """0 where either has no length or lengths differ."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = sum(x * x for x in query) ** 0.5
    return F.when((F.size(vector) != len(query)) | (norm == 0) | F.lit(own == 0), F.lit(0.0)).otherwise(dot / (norm * F.lit(own)))


def vector_search(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], limit: int) -> DataFrame:
    """(id_col, score) of the nearest; ties by id. Malformed (null) vectors are left out."""
    rows = vectors.where(F.col(vector_col).isNotNull()).select(id_col, cosine(F.col(vector_col), query).alias("score"))
    return rows.orderBy(F.desc("score"), id_col).limit(limit)


def ranked(hits: DataFrame, id_col: str, name: str, *more: str) -> DataFrame:
    """Places from 0 of at most CANDIDATES hits: sorted in one task, as they are so few."""
    return hits.select(id_col, *more, (F.row_number().over(Window.orderBy(F.desc("score"), id_col)) - 1).alias(name))


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Reciprocal rank fusion of two bounded lists; without text hits the vector scores stand.

    Both lists go into one aggregate, so that neither is evaluated twice, not even to learn that the first is empty.
    """
    place = F.lit(None).cast("int")
    a = ranked(text_hits, id_col, "__a").select(id_col, "__a", place.alias("__b"), F.lit(None).cast("double").alias("__score"))
    b = ranked(vector_hits.select(id_col, F.col("score").cast("double").alias("score")), id_col, "__b", "score").select(id_col, place.alias("__a"), "__b", F.col("score").alias("__score"))
    part = lambda c: F.coalesce(1.0 / (F.lit(RRF_K + 1) + F.col(c)), F.lit(0.0))
    both = a.union(b).groupBy(id_col).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"), F.max("__score").alias("__score"))
    empty = F.max("__a").over(Window.partitionBy(F.lit(1))).isNull()  # a hundred rows
    return both.select(id_col, F.when(empty, F.col("__score")).otherwise(part("__a") + part("__b")).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def grouped(hits: DataFrame, id_col: str, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits by process, (process_id, step_index, id, score), and hits of no process. steps(process_id, step_index, id_col)."""
    return steps.join(hits, id_col).select("process_id", "step_index", id_col, "score"), hits.join(steps, id_col, "left_anti")
