"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles. Two sets of similarity
0.8 or more share at least need = ceil(0.8 * size) shingles of either, so the
first size - need + l shingles of both, in one order for all, share l. The order
puts shingles that many documents hold last. A document takes the l of least
estimated cost, its postings and the sets that are sent for the candidates they
bring: long texts, and those of shingles that are common in spite of the order,
lengthen their prefix and ask for as many more shared ones before a pair is verified.

1. One pass over the texts: size and 128-bit key of every set, and shingles seen
   often within a stretch of documents. Equal sets are one node from here on.
2. Postings (shingle, set) of the prefixes, packed into blocks by shingle. A list
   gives rows in proportion to its sets, less those that no other set of it can be
   similar to by size and place. Lists of up to SHORT sets give their pairs, which are
   counted: a pair goes on if it shares min(l) shingles and what can follow the last
   shared place allows the similarity. Longer lists give star rows (least set of the
   list, member). A pair that shares a long list is in that star's group, one that
   shares only short lists is counted in full; so neither loses a similar pair.
3. Each group (a star, or the pairs of one set) gets its members' sets once.
   Members similar to the hub are linked to it; only the others are compared with
   the group: shared prefix shingles first, the whole sets where min(l) are shared.
   Groups beyond GROUP or GROUP_SHINGLES are compared in blocks, the loose members against all.
4. Components of the links by distributed star contraction, joined to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import components, cut, need, trimmed

WORDS = 5
#: Similarity as a ratio of integers.
NUMERATOR, DENOMINATOR = 80, 100
#: Common shingles that the order knows, at most: 16 bytes each are broadcast.
MAX_COMMON = 1_000_000
#: Shingles of documents that are counted together, and the count there from which one is reported.
STRETCH, OFTEN = 1_000_000, 2
#: Prefixes are lengthened by at most MAX_MATCH - 1. A posting's bytes; other sets that a shingle not known as common brings, on average.
MAX_MATCH, POSTING, UNKNOWN = 8, 16, 0.05
#: Postings that a map task packs at once; postings of a block of shingles on average.
PACK, BLOCK_POSTINGS = 300_000, 200_000
#: Sets of a list that still gives its pairs, no more than 5.5 for each set of it.
SHORT = 12
#: Sets of a list whose sizes and places are compared one by one, in place, before it gives rows.
TRIED = 64
#: Members of a group that one task compares, and their shingles: long texts fill a task before many members do.
GROUP, GROUP_SHINGLES = 500, 1_500_000
#: Bytes of a shingle's hash in the sets that are sent: within one group, 48 bits tell shingles apart.
HASH_BYTES = 6
#: Rows of ids and groups (24 bytes at most) that are broadcast to pick sets; beyond, they are joined.
MAX_IDS = 2_000_000


def least_shared(n):
    """Shingles that a set of ``n`` shares with any similar one, at least."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, bounds in shingles.text_slices(batch, "text"):
        values, at = shingles.grams(shingles.Words(data, bounds, True), WORDS)
        yield i, j, *shingles.distinct(values, at)


def _keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (11, 12):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(shingles.mix(values, salt), dtype=np.uint64)])
        out.append(shingles.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64), salt))
    return out[0], out[1]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "k1", "k2", "shingle", "seen"]
    held: list[np.ndarray] = []

    def common() -> pa.RecordBatch:
        token, seen = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
        token, seen = token[seen >= OFTEN], seen[seen >= OFTEN]
        held.clear()
        nothing = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([nothing] * 4 + [pa.array(token.view(np.int64)), pa.array(seen.astype(np.int64))], names)

    for batch in batches:
        for i, j, values, at in _sets(batch):
            k1, k2 = _keys(values, at)
            ids = batch.column(0).slice(i, j - i).cast(pa.int64())
            nothing = pa.nulls(j - i, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at).astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), nothing, nothing], names)
            held.append(values)
            if sum(map(len, held)) >= STRETCH:
                yield common()
    yield common()


class Order:
    """The order of shingles: by how common (0 where unknown), then by hash; and prefixes in it."""

    def __init__(self, token: np.ndarray, seen: np.ndarray):
        by = np.argsort(token)
        self.token, self.seen = token[by], seen[by]

    def common(self, values: np.ndarray) -> np.ndarray:
        if not len(self.token):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(self.token, values), len(self.token) - 1)
        return np.where(self.token[at] == values, self.seen[at], 0)

    def prefixes(self, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values in order within each set, and each set's prefix length and number of matches."""
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        seen = self.common(values)
        moved = np.flatnonzero(np.bincount(owner[seen > 0], minlength=len(n)))  # other sets stay in hash order
        if len(moved):
            pick = np.isin(owner, moved)
            where = np.flatnonzero(pick)
            by = where[np.lexsort((values[where], seen[where], owner[where]))]
            values, seen = values.copy(), seen.copy()
            values[where], seen[where] = values[by], seen[by]
        least = least_shared(n)
        sums = np.concatenate([[0], np.cumsum(seen)])
        best, match = np.full(len(n), np.inf), np.ones(len(n), np.int64)
        for l in range(1, MAX_MATCH + 1):
            length = n - least + l
            met = sums[np.minimum(at[:-1] + length, at[1:])] - sums[at[:-1]] + UNKNOWN * length
            cost = np.where(l <= least, POSTING * length + HASH_BYTES * n * met / l**2, np.inf)
            match = np.where(cost < best, l, match)
            best = np.minimum(cost, best)
        return values, np.minimum(n - least + match, n), match


def _post(order: Order, blocks: int):
    """Blocks of postings: shingle, number of the set in the blob, place in the order; then key, size and match of its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            if not held:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], ["block", "postings"])
            base = np.cumsum([0] + [len(x[3]) for x in held])
            token, place = (np.concatenate([x[k] for x in held]) for k in (0, 2))
            owner = np.concatenate([x[1] + base[i] for i, x in enumerate(held)])
            key, n, match = (np.concatenate([x[k] for x in held]) for k in (3, 4, 5))
            held.clear()
            block = (shingles.mix(token, 31) % np.uint64(blocks)).astype(np.int64)
            by = np.argsort(block, kind="stable")
            name, at = np.unique(block[by], return_index=True)
            blobs = []
            for own in np.split(by, at[1:]) if len(by) else ():
                sets, number = np.unique(owner[own], return_inverse=True)
                head = np.array([len(own), len(sets)], np.int64)
                blobs.append(b"".join(x.tobytes() for x in (head, token[own], number.astype(np.uint32), place[own].astype(np.uint32), key[sets], n[sets].astype(np.uint32), match[sets].astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(blobs, pa.binary())], ["block", "postings"])

        for batch in batches:
            for _, _, values, at in _sets(batch):
                k1, _ = _keys(values, at)
                _, fresh = np.unique(k1, return_index=True)
                values, length, match = order.prefixes(values, at)
                take = length[fresh]
                owner = np.repeat(np.arange(len(fresh)), take)
                place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                held.append((values[at[:-1][fresh][owner] + place], owner, place, k1[fresh], np.diff(at)[fresh], match[fresh]))
                size += len(owner)
                if size >= PACK:
                    size = 0
                    yield packed()
        yield packed()

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    m, d = np.frombuffer(blob, np.int64, 2)
    at, out = 16, []
    for kind, n in ((np.uint64, m), (np.uint32, m), (np.uint32, m), (np.uint64, d), (np.uint32, d), (np.uint32, d)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return tuple(out)


_PAIR = "a long, b long, c int, pa int, pb int, na int, nb int, least int"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a block's postings: pairs of short lists with the shingles they share here; star rows of long lists, of which c is null."""
    held = [_unpack(x.as_py()) for batch in batches for x in batch.column(1)]
    if not held:
        return
    base = np.cumsum([0] + [len(x[3]) for x in held])
    token, place = (np.concatenate([x[k] for x in held]) for k in (0, 2))
    owner = np.concatenate([x[1].astype(np.int64) + base[i] for i, x in enumerate(held)])
    key, n, match = (np.concatenate([x[k] for x in held]) for k in (3, 4, 5))
    held.clear()
    # sets get numbers in the order of their keys, so that copies from several tasks are one
    keys, first_of, number = np.unique(key, return_index=True, return_inverse=True)
    n, match, owner = n[first_of].astype(np.int64), match[first_of].astype(np.int64), number[owner]
    by = np.lexsort((owner, token))
    token, owner, place = token[by], owner[by], place[by].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    again = np.zeros(len(token), bool)
    again[1:] = ~new[1:] & (owner[1:] == owner[:-1])
    new, owner, place = new[~again], owner[~again], place[~again]
    listed = np.cumsum(new) - 1
    # a list without those of its sets that are similar to no other of it, by size and by place
    pick = _possible(listed, n[owner], place)
    listed, owner, place = listed[pick], owner[pick], place[pick]
    at = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]]) if len(listed) else np.zeros(0, int)
    size = np.diff(np.append(at, len(owner)))
    left, right = [], []
    for k in range(2, SHORT + 1):
        lists = at[size == k]
        if len(lists):
            i, j = np.triu_indices(k, 1)
            left.append((lists[:, None] + i).ravel())
            right.append((lists[:, None] + j).ravel())
    if left:
        left, right = np.concatenate(left), np.concatenate(right)
        can = _can(n[owner[left]], n[owner[right]], place[left], place[right])
        left, right = left[can], right[can]
        a, b, pa_, pb = owner[left], owner[right], place[left], place[right]
        by = np.lexsort((b, a))
        a, b, pa_, pb = a[by], b[by], pa_[by], pb[by]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, int)
        if len(start):
            c = np.diff(np.append(start, len(a)))
            pa_, pb = np.maximum.reduceat(pa_, start), np.maximum.reduceat(pb, start)
            a, b = a[start], b[start]
            columns = [keys[a].view(np.int64), keys[b].view(np.int64), *(x.astype(np.int32) for x in (c, pa_, pb, n[a], n[b], np.minimum(match[a], match[b])))]
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in columns], ["a", "b", "c", "pa", "pb", "na", "nb", "least"])
    long = np.repeat(size > SHORT, size)
    if long.any():
        which, member = listed[long], owner[long]
        # sizes too far apart can't be similar: a list falls apart where the next size is out of reach
        by = np.lexsort((n[member], which))
        which, member = which[by], member[by]
        split = np.ones(len(member), bool)
        split[1:] = (which[1:] != which[:-1]) | (DENOMINATOR * n[member[:-1]] < NUMERATOR * n[member[1:]])
        part = np.cumsum(split) - 1
        start = np.flatnonzero(split)
        hub = np.minimum.reduceat(member, start)[part]
        alone = np.diff(np.append(start, len(member)))[part] == 1
        star = np.unique(np.stack([hub[~alone], member[~alone]], 1), axis=0)
        for k in range(0, len(star), 50_000):
            x = star[k : k + 50_000]
            nothing = pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys[x[:, 0]].view(np.int64)), pa.array(keys[x[:, 1]].view(np.int64))] + [nothing] * 6, ["a", "b", "c", "pa", "pb", "na", "nb", "least"])


def _can(na, nb, pa_, pb):
    """Whether sets of these sizes that share a shingle at these places may be similar: before it they share what both have, after it too."""
    most = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)
    return ((NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (na + nb)) & (DENOMINATOR * np.minimum(na, nb) >= NUMERATOR * np.maximum(na, nb))


def _possible(listed: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of lists (numbers in order), the rows that may be similar to another of their list; those of lists above TRIED all stay."""
    at = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]]) if len(listed) else np.zeros(0, int)
    size = np.diff(np.append(at, len(listed)))
    out = np.repeat(size > TRIED, size)
    for k in np.unique(size[(size > 1) & (size <= TRIED)]).tolist():
        rows = at[size == k][:, None] + np.arange(k)
        some = np.zeros(rows.shape, bool)
        for d in range(1, k):
            can = _can(n[rows[:, :-d]], n[rows[:, d:]], place[rows[:, :-d]], place[rows[:, d:]])
            some[:, :-d] |= can
            some[:, d:] |= can
        out[rows[some]] = True
    return out


def _ordered(order: Order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, at in _sets(batch):
                key, _ = _keys(values, at)
                values, length, match = order.prefixes(values, at)
                narrow = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
                blobs = pa.array([narrow[HASH_BYTES * at[k] : HASH_BYTES * at[k + 1]] for k in range(j - i)], pa.binary())
                own = batch.column(0).slice(i, j - i).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([own, pa.array(key.view(np.int64)), pa.array(length.astype(np.int32)), pa.array(match.astype(np.int32)), blobs], ["doc", "key", "prefix", "match", "tokens"])

    return run


class _Group:
    """Sets of one group, their shingles numbered."""

    def __init__(self, rows: list[tuple[int, int, int, int, bytes]]):
        self.doc, self.key = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.prefix, self.match = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        self.n = np.array([len(r[4]) // HASH_BYTES for r in rows])
        tokens = np.zeros((self.n.sum(), 8), np.uint8)
        tokens[:, :HASH_BYTES] = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, HASH_BYTES)
        vocabulary, ids = np.unique(tokens.view("<u8").ravel(), return_inverse=True)
        del tokens
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.ids = ids.astype(np.int32)
        start = np.concatenate([[0], np.cumsum(self.prefix)])
        self.heads = self.ids[np.arange(start[-1]) + np.repeat(self.at[:-1] - start[:-1], self.prefix)]
        self.heads_at = start[:-1]
        self.flag = np.zeros(len(vocabulary), np.int32)

    def shared(self, i: int, others: np.ndarray | None = None) -> np.ndarray:
        own = self.ids[self.at[i] : self.at[i + 1]]
        self.flag[own] = 1
        if others is None or 3 * len(others) > len(self.n):
            out = np.add.reduceat(self.flag[self.ids], self.at[:-1])
            out = out if others is None else out[others]
        else:
            out = np.array([self.flag[self.ids[self.at[k] : self.at[k + 1]]].sum() for k in others], np.int64)
        self.flag[own] = 0
        return out

    def shared_heads(self, i: int) -> np.ndarray:
        own = self.ids[self.at[i] : self.at[i] + self.prefix[i]]
        self.flag[own] = 1
        out = np.add.reduceat(self.flag[self.heads], self.heads_at)
        self.flag[own] = 0
        return out

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        shared = self.shared(i, others)
        return DENOMINATOR * shared >= NUMERATOR * (self.n[i] + self.n[others] - shared)


def _solve(rows: list[tuple[bool, bool, int, int, int, int, bytes]], star: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """Links (of documents) that join the sets of a group, and keys of the members that aren't similar to the hub.

    rows: (is hub, is loose, doc, key, prefix, match, tokens). With ``star`` the hub's
    links are found here; otherwise the loose rows are known.
    """
    unique = {}
    for hub, loose, *row in rows:
        old = unique.get(row[1])
        unique[row[1]] = (hub or (old is not None and old[0]), loose or (old is not None and old[1]), row)
    rows = sorted(unique.values(), key=lambda r: r[2][:2])
    g = _Group([tuple(r[2]) for r in rows])
    size = len(rows)
    root = np.arange(size)  # of each member, its class within the group
    links = []
    loose = np.array([r[1] for r in rows])
    for h in np.flatnonzero([r[0] for r in rows]) if star else ():
        rest = np.flatnonzero((root != root[h]))
        linked = rest[g.similar(h, rest)] if len(rest) else rest
        links += [(int(g.doc[h]), int(g.doc[k])) for k in linked]
        root[np.isin(root, root[linked])] = root[h]
        loose = loose | (root != root[h])
    if star:
        hubs = np.flatnonzero([r[0] for r in rows])
        loose = root != root[hubs[0]] if len(hubs) else np.ones(size, bool)
    for i in np.flatnonzero(loose):
        other = root != root[i]
        other &= DENOMINATOR * np.minimum(g.n, g.n[i]) >= NUMERATOR * np.maximum(g.n, g.n[i])
        other &= ~loose | (np.arange(size) > i)
        if not other.any():
            continue
        other &= g.shared_heads(i) >= np.minimum(g.match, g.match[i])
        k = np.flatnonzero(other)
        if not len(k):
            continue
        k = k[g.similar(i, k)]
        _, one = np.unique(root[k], return_index=True)
        for x in k[one]:
            links.append((int(g.doc[i]), int(g.doc[x])))
            root[root == root[x]] = root[i]
    return links, [int(x) for x in g.key[loose]]


def _by_group(star: bool):
    """Links as (hub, a, b) and, with ``star``, loose members as (hub, key, null), from rows sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def solved() -> pa.RecordBatch:
            links, loose = _solve(held, star)
            out = [(key[0], a, b) for a, b in links] + [(key[0], x, None) for x in loose] * star
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["hub", "a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for hub, i, j, *row in zip(*columns):
                if (hub, i, j) != key and held:
                    yield solved()
                key = (hub, i, j)
                held.append(tuple(row))
        if held:
            yield solved()

    return run


def _some(df: DataFrame) -> DataFrame:
    """``df``, a few numbers a row, broadcast where it has few rows. It is counted first: it should be a frame from ``cut``."""
    return F.broadcast(df) if df.count() <= MAX_IDS else df


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, k1, k2) of all rows, and links (a, b) between documents of different sets.

    The links join just the sets that chains of similar pairs join: they lose no
    component, but pairs of sets that are already joined are not all among them.
    """
    spark = docs.sparkSession
    docs = docs.select(*need(docs, "doc_id", "text"))
    long = "doc_id long, n long, k1 long, k2 long, shingle long, seen long"
    described = cut(docs.mapInArrow(trimmed(_describe), long))
    rows = described.where("k1 is not null").select("doc_id", "n", "k1", "k2")
    common = described.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "shingle").limit(MAX_COMMON).toArrow()
    order = Order(common["shingle"].to_numpy().view(np.uint64), common["seen"].to_numpy())
    del common
    postings = rows.agg(F.sum(F.col("n") * (DENOMINATOR - NUMERATOR) / DENOMINATOR + 1)).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, int(postings // BLOCK_POSTINGS) + 1)

    posted = docs.mapInArrow(trimmed(_post(order, blocks)), "block long, postings binary").repartition(blocks, "block")
    met = posted.mapInArrow(trimmed(_pairs), _PAIR).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("least").alias("least"), F.max(F.col("c").isNull()).alias("star"))
    reach = F.col("c") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    goes_on = (F.col("c") >= F.col("least")) & ((NUMERATOR + DENOMINATOR) * reach >= NUMERATOR * (F.col("na") + F.col("nb")))
    met = met.where(F.col("star") | goes_on)
    stars = cut(met.select("a", F.explode(F.array("a", "b")).alias("b")).distinct().toDF("hub", "key"))
    nodes = rows.where("n > 0 and doc_id is not null").groupBy(F.col("k1").alias("key"), "k2", "n").agg(F.min("doc_id").alias("doc"))
    members = cut(stars.join(nodes, "key").select("hub", "key", "doc", (F.col("hub") == F.col("key")).alias("is_hub"), "n"))

    chosen = cut(members.select("doc").distinct())
    sets = docs.join(_some(chosen), docs["doc_id"] == chosen["doc"], "left_semi").mapInArrow(trimmed(_ordered(order)), "doc long, key long, prefix int, match int, tokens binary")

    blocks_of = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int")
    # groups of more than one part: few, so that no group's rows meet in one task to learn of it
    large = cut(members.groupBy("hub").agg(blocks_of.alias("parts")).where("parts > 1"))
    dealt = members.join(_some(large), "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    # the hub goes to every part of its group
    placed = dealt.select("hub", "key", "doc", "is_hub", F.explode(F.when(F.col("is_hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))).alias("i"))

    def solve(where: DataFrame, star: bool) -> DataFrame:
        with_sets = sets.join(_some(where), ["doc", "key"]).select("hub", "i", "j", "is_hub", "loose", "doc", "key", "prefix", "match", "tokens")
        sorted_ = with_sets.repartition(max(parts, 1), "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "doc")
        return cut(sorted_.mapInArrow(trimmed(_by_group(star)), "hub long, a long, b long"))

    found = solve(cut(placed.withColumn("j", F.lit(0)).withColumn("loose", F.lit(False))), True)
    links = found.where("b is not null").select("a", "b")
    # loose members of groups of several parts meet the whole group
    loose = found.where("b is null").select("hub", F.col("a").alias("key")).distinct().join(_some(large), "hub").join(members.select("hub", "key", "doc", "n"), ["hub", "key"])
    loose = cut(loose.select("hub", "key", "doc", "n", "parts"))
    if loose.limit(1).count():
        wide = cut(loose.groupBy("hub").agg(blocks_of.alias("rows")))
        left = loose.join(_some(wide), "hub").select("hub", "key", "doc", F.pmod(F.xxhash64("key", F.lit(1)), F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("loose"))
        right = dealt.join(_some(wide), "hub").select("hub", "key", "doc", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), mine.alias("j"), F.lit(False).alias("loose"))
        both = left.union(right).select("hub", "key", "doc", "i", "j", "loose", F.lit(False).alias("is_hub"))
        links = links.union(solve(cut(both), False).where("b is not null").select("a", "b"))
    return rows, links


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach, the row's own included.
    Texts of no words (null, empty, blank) have no shingles and link with nothing; a
    text of one to four words has one shingle, its sequence. Repeated rows each have
    a row; rows of one doc_id and different texts count as one node; a null doc_id
    takes the smallest of the rows with its set, or null. An empty table gives an empty
    result; other columns are dropped.
    """
    rows, links = similar_sets(docs)
    nodes = cut(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")))
    # ids with several sets join these
    several = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo != hi").select("doc_id")
    several = cut(several)
    if several.limit(1).count():
        links = links.union(rows.join(_some(several), "doc_id").join(nodes, ["k1", "k2", "n"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    classes = components(links)
    named = nodes.join(classes, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("c"))
    out = rows.join(named, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id and, of several, the least in its other columns.

    Rows of null doc_id stay, one of each text.
    """
    found = cut(jaccard_components(docs))
    names = docs.columns
    own = docs.where("doc_id is not null").join(_some(cut(found.where("component_id != doc_id").select("doc_id").distinct())), "doc_id", "left_anti")
    again = cut(found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    others = ["text", *(c for c in names if c not in ("doc_id", "text"))]
    one = own.join(_some(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("least")).select("doc_id", "least.*").select(*names)
    lone = docs.where("doc_id is null").dropDuplicates(["text"])
    return own.join(_some(again), "doc_id", "left_anti").select(*names).union(one).union(lone.select(*names))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
