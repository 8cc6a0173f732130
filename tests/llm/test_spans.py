"""op8 and op10: patterns against plain regular expressions, models on held-out examples."""

import hashlib
import random
import re

import numpy as np
import pytest

from wefthread.llm import pii, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def plain_pii(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        double = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(d[::-1])]
        if 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in double) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2]), x[1]))


def plain_secrets(text):
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(*m.span(), "assign") for m in re.finditer(assign, text) if len(m.group(2)) >= 8]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda x: (x[0], secret_scan.KINDS.index(x[2]), x[1]))


def odd_texts():
    rng = random.Random(8)
    atoms = ["a@b.c", "x@", "@y.z", "a.b+c@d-e.f.g", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "0000255.1.1.1", "4539 1488 0343 6467", "4539148803436467", "1-2-3", "+1 (017) 555-7713", "+33", "++49 30 1234567 ", " ", "\n", "é", "..", "@@", "12345678901234567890123"]
    more = ["password = \"hunter2hunter\"", "TOKEN:abc", "api_key='AAAAaaaa1111=='", "paſſword=longenough1", "toKen=longenough2", "AKIA", "AKIAABCDEFGHIJKLMN", "deadbeef" * 4, "secret  :  x.y.z-1234", "passwd=", "abcdef" * 6, "0f" * 15, "G", "=", "\""]
    return ["".join(rng.choice(atoms + more) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]


def test_patterns_match_plain_expressions(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + odd_texts()
    for text in texts:
        assert pii.base_spans(text) == plain_pii(text)
        assert secret_scan.base_spans(text) == plain_secrets(text)
    assert any(plain_pii(t) for t in texts) and any(plain_secrets(t) for t in texts)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "0f" * 9 + "g" * 300_000, "+1" + "(" * 300_000, "@" * 100_000, "at " * 20_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)
    secret_scan.base_spans(text)
    assert len(list(pii.windows(text[:60_000]))) >= 0


@pytest.mark.parametrize("which", [pii, secret_scan])
def test_queries(spark, which):
    plain = plain_pii if which is pii else plain_secrets
    found = pii.find_pii if which is pii else secret_scan.find_secrets
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "", "", 0), (9002, "é a@b.cd token=abcdefgh1 +1 (017) 555-7713", "", "", 0), (9002, "é a@b.cd token=abcdefgh1 +1 (017) 555-7713", "", "", 0), (None, "x@y.zz", "", "", 0)], DOCS)
    rows = docs.union(odd).selectExpr("*", "1 as spans", "2 as kind")
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    got = pii.digest(found(rows), which.KINDS).collect()
    assert len(got) == rows.count()
    for r in got:
        base = plain(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        for kind in which.KINDS:
            assert r[f"n_{kind}"] == sum(x[2] == kind for x in base)
        spans = r.spans.split(",") if r.spans else []
        assert set(pii.written(base).split(",") if base else []) <= set(spans)
        order = [(int(x.split(":")[1]), which.KINDS.index(x.split(":")[0])) for x in spans]
        assert order == sorted(order)
    assert found(rows.limit(0)).collect() == []


def test_crf_finds_held_out_entities():
    crf = pii.model()
    found = good = gold = 0
    for words, spans in pii.examples(300, 99):
        best = set(crf.best(words))
        found, good, gold = found + len(best), good + len(best & set(spans)), gold + len(spans)
    assert good / gold > 0.93 and good / found > 0.95
    for kind, name in enumerate(pii.KINDS):
        held = [(words, x) for words, spans in pii.examples(300, 98) for x in spans if x[2] == kind]
        assert np.mean([x in crf.best(words) for words, x in held]) > 0.9, name


def test_blocks_of_words_change_nothing(monkeypatch):
    crf = pii.model()
    words = sum((w for w, _ in pii.examples(60, 44)), [])
    whole = crf.best(words)
    for block in (1, 2, 5, 64):
        monkeypatch.setattr(pii, "BLOCK", block)
        assert crf.best(words) == whole
    assert crf.best([]) == []


def test_apart():
    rng = random.Random(2)
    for _ in range(200):
        base = sorted((a, a + rng.randrange(1, 30), "ip") for a in (rng.randrange(200) for _ in range(8)))
        cuts = sorted(rng.sample(range(220), 12))
        spans = [(a, b, "card") for a, b in zip(cuts[::2], cuts[1::2])]
        assert pii.apart(spans, base) == [x for x in spans if not any(x[0] < e and s < x[1] for s, e, _ in base)]


def test_crf_search_is_exact():
    rng = np.random.default_rng(3)
    crf = pii.SemiMarkov(rng.normal(0, 1, (len(pii.KINDS) + 1, pii._SHAPES)))
    for words, _ in pii.examples(40, 5):
        words = words[:7]
        f, s = crf.scores(words)
        n = len(words)

        def best(i, e):
            if i == n:
                return 0.0
            options = [s[i, 0, 0] + best(i + 1, e)]
            if e:
                options += [s[i, l, k] - pii.MARGIN + best(i + l + 1, e - 1) for l in range(min(pii.LENGTH, n - i)) for k in range(1, 5)]
            return max(options)

        spans = crf.best(words)
        inside = {x for a, b, _ in spans for x in range(a, b)}
        value = sum(s[a, b - a - 1, k + 1] - pii.MARGIN for a, b, k in spans) + sum(s[i, 0, 0] for i in range(n) if i not in inside)
        assert abs(value - best(0, pii.ENTITIES)) < 1e-9 and len(spans) <= pii.ENTITIES


def test_network_on_held_out_findings():
    net = secret_scan.model()
    rows = secret_scan.findings(800, 77)
    x, mask = (np.stack(v) for v in zip(*(secret_scan.encode(t, s, e) for t, s, e, _ in rows)))
    p = net.probability(x, mask, np.array([secret_scan.shape(t, s, e) for t, s, e, _ in rows])) >= net.threshold
    y = np.array([r[3] for r in rows]) == 1
    assert p[y].mean() > 0.9 and p[~y].mean() < 0.02


def test_network_gradient():
    net = secret_scan.CharacterNetwork(1)
    rows = secret_scan.findings(12, 3)
    x, mask = (np.stack(v) for v in zip(*(secret_scan.encode(t, s, e) for t, s, e, _ in rows)))
    extra, y = np.array([secret_scan.shape(t, s, e) for t, s, e, _ in rows]), np.array([r[3] for r in rows], float)

    def loss():
        z = net._forward(x, mask, extra)[-1]
        return (np.logaddexp(0, z) - y * z).mean()

    grads = net._gradient(x, mask, extra, y)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in g.shape)
            old, eps = net.p[name][at], 1e-5
            net.p[name][at] = old + eps
            up = loss()
            net.p[name][at] = old - eps
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-5


def test_redact(spark):
    docs = spark.createDataFrame([(1, "x token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" y", "en", "s", 53), (2, "clean", "en", "s", 5), (3, None, None, None, None)], DOCS)
    got = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert got[1].text == "x [SECRET]\" y" and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text) == ("clean", None)


def test_contact_lists_are_read_to_the_end():
    for count in (4, 5, 9, 30):
        names = [f"ann{'abcdefghij'[i % 10]}{'klm'[i // 10]}" for i in range(count)]
        text = "please write to " + " or to ".join(f"{n} at firm dot com" for n in names) + " as ever"
        got = {text[s:e] for s, e, k in pii.model_spans(text, pii.model()) if k == "email"}
        assert got == {f"{n} at firm dot com" for n in names}
    text = "mail " + " ".join(f"u{i}@firm.org" for i in range(6)) + " or ann at firm dot com today"
    assert "ann at firm dot com" in {text[s:e] for s, e, _ in pii.model_spans(text, pii.model())}


def test_keys_inside_long_runs_are_found_as_alone():
    rng = random.Random(77)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(rng.randrange(24, 48))) for _ in range(100)]
    words = "usr share documentation packages licenses common templates archive".split()
    network = secret_scan.model()

    def found(*around):
        n = 0
        for key in keys:
            text = f"see {around[0]}{key}{around[1]} and"
            at = text.index(key)
            n += any(s <= at + 4 and e >= at + len(key) - 4 for s, e, _, _ in secret_scan.scan([text], network)[0])
        return n

    alone = found("", "")
    assert alone >= 90
    for mark in "/._":
        path = mark.join(words)
        assert found(path + mark, mark + path) >= alone - 3
        assert found(path + mark, "") >= alone - 3
    plain = [rng.choice("/.-_").join(rng.choice(words) for _ in range(rng.randrange(8, 30))) for _ in range(200)]
    assert sum(map(bool, secret_scan.scan(plain, network))) <= 2


def test_candidates_keep_what_patterns_leave():
    text = "x " + "a1" * 10 + "token=abcdefgh12" + " " + "Zq9" * 8 + "0123456789abcdef0123456789abcdef" + "Zq9" * 8 + ".."
    base = secret_scan.base_spans(text)
    covered = {i for s, e, _ in base for i in range(s, e)}
    runs = secret_scan.candidates(text, base)
    assert len(runs) == 3 and all(not covered & set(range(s, e)) for s, e in runs)
    whole = "Ab3" * 300
    read = {i for s, e, _ in secret_scan.looks(whole, 0, 900) for i in range(s, e)}
    assert read == set(range(900)) and all(e - s <= secret_scan.INSIDE for s, e, _ in secret_scan.looks(whole, 0, 900))
