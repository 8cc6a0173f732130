"""op4, op5 and op9 against brute force on small tables."""

import hashlib
import math
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from wefthread.llm import mixing, simhash, urls
from wefthread.llm.common import components

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_components_match_union_find(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50, 60), (60, 55), (7, 7), (None, 3), (100, 99)]
    got = dict(components(frame(spark, edges, "a int, b int")).collect())
    assert got == {**{i: 10 for i in range(10, 41)}, 50: 50, 60: 50, 55: 50, 100: 99, 99: 99}
    assert components(frame(spark, [], "a int, b int")).collect() == []


def test_url_rules_match_oracle(spark):
    got = {tuple(r) for r in urls.op9_url_filter(spark, SF).select("page_id", "host", "path", "rule", "verdict", "source").collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    assert got == set(con.execute(urls.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01"])
def test_url_aliases_match_oracle(spark, where):
    folder = f"/root/testdata/{where}"
    got = sorted(tuple(r) for r in urls.url_aliases(spark, folder).select("page_id", "host", "path", "rule", "verdict", "source").collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    assert got == sorted(con.execute(urls.ALIAS_SQL).fetchall())
    assert {r[4] for r in got if r[5] == "alias"} == {"allow", "block"}


def test_relative_links_resolve_as_in_the_library(spark):
    bases = ["http://a.net/x/y/z.html?q=1#f", "https://A.org", "http://b.com/", "http://c.de/d/"]
    links = ["http://o.net/1", "//o.net/2", "/es/x", "e/f", "./g", "../h", "../../../i", "?k=2", "j?x=../y", "l/../m/./n", "..", ".", "o#p", "a&amp;b"]
    rows = [(b, x) for b in bases for x in links]
    got = {(r.base, r.to): r.url for r in frame(spark, rows, "base string, to string").withColumn("url", urls.resolve(F.col("to"), F.col("base"))).collect()}
    for b, x in rows:
        assert got[b, x] == urljoin(b, x.replace("&amp;", "&")), (b, x)
    none = frame(spark, [("http://a.net/x", x) for x in ("", "#top", "mailto:a@b.cd", "javascript:x()")] + [("no scheme", "/a"), (None, "/a"), ("http://a.net/", None)], "base string, to string")
    assert {r.url for r in none.select(urls.resolve(F.col("to"), F.col("base")).alias("url")).collect()} == {None}


def test_a_harmless_canonical_page_blocks_nobody(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.net/es", ""), (2, "http://b.net/es", link % "http://fine.org/page"), (3, "http://fine.org/page", ""),
        (4, "http://c.org/x/1", link % "/es/new"), (5, "http://e.net/q", link % "/es/new"), (6, "http://f.org/long", "<link " + "data-x='y' " * 400 + "rel=canonical href=//g.net/fr/z>"),
        (7, "http://h.org/in", '<base href="http://i.net/es/"><meta http-equiv=refresh content="0; url=page">'), (8, "http://j.org/up", '<meta http-equiv="refresh" content="5; URL=../es/">'),
    ]
    by = {r.page_id: (r.verdict, r.source) for r in urls.filter_urls(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert by[1] == by[2] == by[3] == by[4] == by[8] == ("allow", "default")
    assert by[5] == by[6] == by[7] == ("block", "alias")


def test_url_edges(spark):
    page = lambda i, url, html="": (i, url, html)
    rows = [
        page(1, "http://A.Example.COM/en/x?q=1#f"), page(2, "http://www.example.com/en/x"), page(3, None), page(4, "no scheme"),
        page(5, "https://x.org/a", '<link rel="canonical" href="https://y.net/es/b">'),
        page(6, "https://z.org/a", '<meta http-equiv="refresh" content="0; url=https://x.org/a#top">'),
        page(7, "https://w.org/1", '<link href="https://y.net/fr/1" rel=canonical><link rel="canonical" href="http://ok.com/">'),
        page(8, "https://x.org/a/", None), page(8, "https://x.org/a/", None), page(9, "://net", ""), page(None, "https://net/es/", ""),
        page(10, "https://examplexcom/en/", ""), page(11, "https://net/es", ""), page(12, "https://new.org/r", ""),
    ]
    pages = frame(spark, rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as verdict")
    redirects = frame(spark, [("https://new.org/r", "https://deep.net/fr/old"), (None, "x")], "src string, dst string")
    got = urls.filter_urls(pages, redirects=redirects).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (by[2].rule, by[2].verdict) == ("www.example.com/en/", "allow")
    assert (by[3].host, by[3].path, by[3].rule, by[3].verdict) == ("", "", None, "allow") == (by[4].host, by[4].path, by[4].rule, by[4].verdict)
    assert [by[i].verdict for i in (5, 6, 8)] == ["block"] * 3 and by[5].source == "alias"
    assert by[7].verdict == "allow"
    assert (by[9].host, by[9].path) == ("net", "") and by[None].rule == "net/es/"
    assert by[10].rule is None and by[11].rule is None and by[12].verdict == "block"
    assert urls.filter_urls(pages.limit(0)).collect() == []


def water(sizes, weights=(5, 2, 1), ceiling=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > ceiling * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: ceiling * sizes[s] for s in over}


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01"])
def test_mix_hits_targets(spark, where):
    rows = mixing.op4_mixing(spark, f"/root/testdata/{where}").collect()
    again = mixing.op4_mixing(spark, f"/root/testdata/{where}").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in spark.read.parquet(f"/root/testdata/{where}/documents.parquet").collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    expected = water(sizes)
    for s, t in target.items():
        assert math.isclose(t, expected[s], rel_tol=1e-9)
        assert abs(taken[s] - t) <= max(r.size for r in rows if source[r.doc_id] == s)


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", None, "x", 1), (1, "a b c", None, "x", 1), (None, None, None, None, None), (3, "", "en", "y", 0), (4, "w " * 3000, "en", "y", 0), (5, "q", "e", None, 1)]
    docs = frame(spark, rows, DOCS).selectExpr("*", "1 as taken", "2 as s", "3 as size")
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == [(-1, 0), (1, 3), (1, 3), (3, 0), (4, 3000), (5, 1)]
    assert mixing.mix(docs.limit(0)).collect() == []


def test_null_ids_are_no_real_ids(spark):
    rows = [(i, "w " * n, "en", "a", 0) for n in range(1, 31) for i in (None, -1, 0, None)] + [(9, "w " * 40, "en", "b", 0)] * 50
    docs = frame(spark, rows, DOCS)
    got = mixing.mix(docs).collect()
    kept = mixing.take(docs).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40
        assert sum(len(r.text.split()) for r in kept if r.source == s) == sum(r.taken for r in own)


def test_pivotal_keeps_probabilities(spark):
    rows = [(i, "w " * (1 + i % 50), "en", "ab"[i % 3 == 0], 0) for i in range(3000)]
    got = mixing.mix(frame(spark, rows, DOCS)).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert {r.copies for r in own} <= {math.floor(own[0].target / own[0].source_size), math.floor(own[0].target / own[0].source_size) + 1}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50
        half = [r.copies for r in own if r.size > 25]
        assert abs(sum(half) / len(half) - own[0].target / own[0].source_size) < 0.05


def edited_by_hand(rows):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        out.append((i, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    return out


def test_edited_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.compare_edited(docs).collect()
    expected = edited_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(expected)
    text = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for r in got:
        assert seen.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.1


def test_edited_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    rows = [(i * i, "é%d wörd 𝒳 " % i * (i % 5), "en", "s", 0) for i in range(40)] + [(10**12, None, None, None, None), (10**12, "", "", "", 0), (9, "x", "", "", 1)]
    docs = frame(spark, rows, DOCS).selectExpr("*", "1 as b", "2 as n", "3 as fingerprint")
    got = simhash.compare_edited(docs).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edited_by_hand(rows))
    assert simhash.compare_edited(docs.limit(0)).collect() == []


def votes_by_hand(spark, text):
    words = text.split(" ")
    total, bits = 0, [0] * 64
    rows = [(w, words[i + 1] if i + 1 < len(words) else None) for i, w in enumerate(words)]
    hashes = [r[0] for r in spark.createDataFrame(rows, "x string, y string").selectExpr("xxhash64(x, y)").collect()]
    for w, h in zip(words, hashes):
        weight = min(8, 1 + len(w) // 4)
        total += weight
        for b in range(64):
            bits[b] += weight * (h >> b & 1)
    return sum((2 * v > total) << b for b, v in enumerate(bits))


def test_fingerprint_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STRETCH", 4)
    texts = ["one", "a bb cccc ddddd eeeeee fffffff gggggggg", "x y " * 20 + "z"]
    got = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()
    for r in got:
        assert int(r.fingerprint, 16) == votes_by_hand(spark, texts[r.k])


def test_near_fingerprints_match_brute_force(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for v in base for _ in range(4)}
    texts = sorted(f"{v:016x}" for v in values)
    got = {(r.a, r.b, r.distance) for r in simhash.near_fingerprints(spark.createDataFrame([(t,) for t in texts] * 2, "fingerprint string")).collect()}
    want = {(a, b, d) for a in texts for b in texts if a < b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want and want


def classes_by_hand(values, radius=3):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_near_classes_match_brute_force(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for v in base for _ in range(5)}
    dense = rng.getrandbits(64)
    values |= {dense ^ sum(1 << b for b in rng.sample(range(0, 64, 3), rng.randrange(8))) for _ in range(150)}
    rows = [(f"{v:016x}",) for v in values] * 2 + [(None,)]
    got = {r.bits & (2**64 - 1): r["class"] & (2**64 - 1) for r in simhash.near_classes(spark.createDataFrame(rows, "fingerprint string")).collect()}
    want = classes_by_hand(values)
    groups = lambda by: {frozenset(v for v in by if by[v] == c) for c in set(by.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}
    assert simhash.near_classes(spark.createDataFrame([], "fingerprint string")).collect() == []


def test_near_class_of_documents(spark):
    rows = simhash.op5_fingerprints(spark, "/root/testdata/sf0.01").collect()
    by = classes_by_hand({int(r.fingerprint, 16) for r in rows})
    least = {}
    for r in rows:
        c = by[int(r.fingerprint, 16)]
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert all(r.near_class == least[by[int(r.fingerprint, 16)]] for r in rows)
    assert len(set(least.values())) < len(rows)


def test_clustered_ids_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(simhash, "UNEVEN", 0)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 10)
    rows = [(i, f"text {i} {'x' * (i % 40)}", "en", "a", 0) for i in [*range(50), 10**9, 10**9 + 3, 10**15]]
    got = simhash.compare_edited(frame(spark, rows, DOCS)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edited_by_hand(rows))
