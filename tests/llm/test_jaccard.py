"""op2 against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wefthread.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            n = len(s & t)
            if n and 100 * n >= 80 * (len(s) + len(t) - n):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "1 as n", "2 as k1", "3 as hub")
    return sorted(map(tuple, jaccard.jaccard_components(docs).collect()))


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(map(tuple, jaccard.op2_jaccard_join(spark, "/root/testdata/sf0.01").collect()))
    assert got == brute(rows)


def family(rng, size, n=60, edits=4):
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("group", [2000, 5])
def test_near_copies_at_the_border(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    rng = random.Random(group)
    texts = family(rng, 60) + family(rng, 30, 25, 2) + family(rng, 30, 8, 1) + [" ".join(f"u{rng.randrange(9)}" for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 7))
    got = run(spark, rows)
    want = brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) not in (1, len(want))


def test_longer_prefixes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 1)
    rng = random.Random(5)
    rows = list(enumerate(family(rng, 40) + family(rng, 40, 30, 3)))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [3, 4, 24, 25, 500])
def test_clusters_of_near_copies(spark, size):
    rng = random.Random(size)
    rows = list(enumerate(family(rng, size) + family(rng, size, 80, 9) + family(rng, 40, 30, 3), 1))
    assert run(spark, rows) == brute(rows)


def test_a_list_gives_rows_in_proportion(spark):
    rng = random.Random(3)
    for size in (2, 3, 24, 200):
        texts = [f"{'a b c d e f g h'} {' '.join(str(rng.randrange(10**6)) for _ in range(4))}" for _ in range(size)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(size)), pa.array(texts)], ["doc_id", "text"])
        order = jaccard.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        posted = list(jaccard._post(order, 1)(iter([batch])))
        lists = Counter(jaccard._unpack(posted[0].column(1)[0].as_py())[0].tolist())
        made = sum(b.num_rows for b in jaccard._pairs(iter(posted)))
        assert made <= 5.5 * sum(n for n in lists.values() if n > 1)


def test_one_id_with_several_texts(spark):
    rng = random.Random(4)
    one, two = family(rng, 9), family(rng, 9)
    rows = [(5, one[0]), (5, two[0]), (3, one[1]), (2, two[1]), (5, one[2]), (9, one[3]), (8, two[2]), (8, "a lone text of some words")]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "é É"), (7, "É é"), (8, long), (9, long + " more"), (10, "a b c d e"), (11, "a b c d e"), (12, "Ünï ödd"), (13, "Ünï ödd")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1] * 3) == [(1, 0, 1)] * 3
    assert run(spark, [(4, "q r s t u v")] * 2 + [(None, "q r s t u v"), (None, "z")][:0]) == [(4, 2, 4)] * 2
    assert run(spark, []) == []


def test_keep_one_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b b b", "en", "a", 1), (1, "a a a", "en", "a", 1), (4, "B b b", "en", "a", 1)], DOCS)
    assert [(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()] == [(1, "a a a")]
    assert jaccard.keep_one(docs.limit(0)).collect() == []


def test_keep_one(spark):
    text = " ".join(f"k{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text, "en", "a", 1), (2, text + " z", "en", "b", 1), (9, "", "en", "c", 0), (8, None, None, None, None), (2, text + " z", "en", "b", 1), (None, "lone", None, None, None)], DOCS)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 8, 9]
