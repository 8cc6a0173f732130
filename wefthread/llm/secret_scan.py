"""Secrets: fixed patterns, and a small convolutional network over characters.

The patterns (``base_spans``) always stand. Candidates for the network are all
long unbroken runs of key-like characters, less what patterns cover. Of a run over
INSIDE characters it looks at every part between separators and at overlapping
windows, to the last character. It reads a look and AROUND characters on either side: an embedding of character
classes, one convolution, the strongest response of each filter inside the
candidate and around it, and a logistic output. Its outputs are calibrated
(temperature and shift) on held-out findings, and the threshold is the highest
that still finds RECALL of them.

The tables hold no labelled findings. They are generated (``findings``): keys of
many forms where keys are written, and ids, hashes, names and paths where they
aren't. Fitted once in a driver, in numpy; executors only apply it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import need, trimmed
from .pii import digest

KINDS = ("assign", "access", "hex")
#: Kind of the network's spans.
OTHER = "assign"
AROUND, INSIDE = 28, 64
MIN_LENGTH = 16
RECALL = 0.95
FINDINGS, EPOCHS, SEED = 3000, 12, 10
#: Rows that are redacted at a time.
ROWS = 1000
_EMBED, _FILTERS, _WIDTH = 8, 24, 5

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{MIN_LENGTH},}}")
_PART = re.compile(rf"[A-Za-z0-9+]{{{MIN_LENGTH},}}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as in KINDS."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(*m.span(), "hex") for m in _hex(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _hex(text: str) -> Iterator[re.Match]:
    # few texts have a digit, and hardly one a long run of hex letters without any
    return _HEX.finditer(text) if any(map(text.__contains__, "0123456789")) or re.search(r"[a-f]{32}", text) else iter(())


# --- the network -------------------------------------------------------------


def _class(c: str) -> int:
    """Lower, upper and digits by value; other characters by kind; 0 is beyond the text."""
    o = ord(c)
    if 97 <= o <= 122:
        return 1 + (o - 97)
    if 65 <= o <= 90:
        return 27 + (o - 65)
    if 48 <= o <= 57:
        return 53 + (o - 48)
    special = "+/_.=-:\"' \n,;()[]{}@#$&?<>|\\"
    k = special.find(c)
    return 63 + k if k >= 0 else 63 + len(special)


_CLASSES = 64 + len("+/_.=-:\"' \n,;()[]{}@#$&?<>|\\")
_LENGTH = 2 * AROUND + INSIDE


def encode(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of a look, at most INSIDE, and of those around it, and where it is."""
    end = min(end, start + INSIDE)
    before, inner, after = text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]
    x, mask = np.zeros(_LENGTH, np.int32), np.zeros(_LENGTH, bool)
    for at, part in ((AROUND - len(before), before), (AROUND, inner), (AROUND + len(inner), after)):
        x[at : at + len(part)] = [_class(c) for c in part]
    mask[AROUND : AROUND + len(inner)] = True
    return x, mask


def shape(text: str, start: int, end: int) -> list[float]:
    """Length, kinds of characters and how evenly they are spread, beside the characters themselves."""
    s = text[start:end]
    n = len(s)
    _, seen = np.unique(np.frombuffer(s.encode("ascii", "replace"), np.uint8), return_counts=True)
    entropy = -(seen / n * np.log2(seen / n)).sum()
    turns = sum((a.isalpha() != b.isalpha()) or (a.isupper() != b.isupper()) for a, b in zip(s, s[1:]))
    return [min(n, 100) / 100, sum(c.isdigit() for c in s) / n, sum(c.isupper() for c in s) / n, entropy / 6, turns / n, (s.count("/") + s.count(".")) / n, s.count("-") / n, s.count("_") / n]


_EXTRA = 8


class CharacterNetwork:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (_CLASSES, _EMBED)), "conv": rng.normal(0, 0.2, (_WIDTH * _EMBED, _FILTERS)), "bias": np.zeros(_FILTERS),
            "out": rng.normal(0, 0.1, 2 * _FILTERS + _EXTRA), "shift": np.zeros(1),
        }
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray, mask: np.ndarray, extra: np.ndarray):
        p = self.p
        e = p["embed"][x]
        n = x.shape[1] - _WIDTH + 1
        cols = np.concatenate([e[:, i : i + n] for i in range(_WIDTH)], 2)
        z = np.maximum(cols @ p["conv"] + p["bias"], 0)
        inside = mask[:, _WIDTH // 2 : _WIDTH // 2 + n, None]
        a, b = np.where(inside, z, 0.0), np.where(inside, 0.0, z)
        ia, ib = a.argmax(1), b.argmax(1)
        h = np.concatenate([np.take_along_axis(a, ia[:, None], 1)[:, 0], np.take_along_axis(b, ib[:, None], 1)[:, 0], extra], 1)
        return cols, ia, ib, h, h @ p["out"] + p["shift"][0]

    def logits(self, x: np.ndarray, mask: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256], mask[i : i + 256], extra[i : i + 256])[-1] for i in range(0, len(x), 256)] or [np.zeros(0)])

    def probability(self, x, mask, extra) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x, mask, extra) + self.offset)))

    def fit(self, rows: list[tuple[str, int, int, int]]) -> CharacterNetwork:
        """rows: (text, start, end, label). A fifth calibrates and sets the threshold."""
        rng = np.random.default_rng(SEED)
        x, mask = (np.stack(v) for v in zip(*(encode(t, s, e) for t, s, e, _ in rows)))
        extra = np.array([shape(t, s, e) for t, s, e, _ in rows])
        y = np.array([r[3] for r in rows], float)
        held = np.arange(len(y)) % 5 == 0
        own = np.flatnonzero(~held)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
                step += 1
                for k, g in self._gradient(x[part], mask[part], extra[part], y[part]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        z, t = self.logits(x[held], mask[held], extra[held]), y[held]
        a, b = 1.0, 0.0
        for _ in range(300):  # calibration: logistic regression on the logit
            q = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 0.05 * ((q - t) * z).mean(), b - 0.2 * (q - t).mean()
        self.scale, self.offset = max(a, 1e-3), b
        p = 1 / (1 + np.exp(-(self.scale * z + self.offset)))
        found = np.sort(p[t == 1])
        self.threshold = float(found[int(np.floor((1 - RECALL) * len(found)))]) if len(found) else 0.5
        return self

    def _gradient(self, x, mask, extra, y) -> dict[str, np.ndarray]:
        cols, ia, ib, h, z = self._forward(x, mask, extra)
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {"out": h.T @ d, "shift": np.array([d.sum()])}
        dh = d[:, None] * self.p["out"]
        conv, bias, embed = np.zeros_like(self.p["conv"]), np.zeros(_FILTERS), np.zeros_like(self.p["embed"])
        f = np.arange(_FILTERS)
        for at, part, value in ((ia, dh[:, :_FILTERS], h[:, :_FILTERS]), (ib, dh[:, _FILTERS : 2 * _FILTERS], h[:, _FILTERS : 2 * _FILTERS])):
            part = np.where(value > 0, part, 0.0)
            picked = np.take_along_axis(cols, at[:, :, None], 1)  # batch, filter, width * embed
            conv += np.einsum("bfc,bf->cf", picked, part)
            bias += part.sum(0)
            back = part[:, :, None] * self.p["conv"].T[f]  # batch, filter, width * embed
            back = back.reshape(len(y), _FILTERS, _WIDTH, _EMBED)
            for i in range(_WIDTH):
                np.add.at(embed, np.take_along_axis(x, at + i, 1), back[:, :, i])
        return g | {"conv": conv, "bias": bias, "embed": embed}


def findings(count: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is it a secret) of made-up candidates in made-up surroundings."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    lower, upper, ten = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = "an the er on re ti en ou st ing ed ai que tion de la mente ung che keit ich tz zu ber sch ein pf und heit ver os ado wh ble nd sh ly or ll rr".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(2, 6)))
    key = lambda: rng.choice([
        lambda: pick(lower + upper + ten, rng.randrange(20, 48)), lambda: pick(lower + upper + ten + "+/", rng.randrange(24, 64)) + rng.choice(["", "=", "=="]), lambda: rng.choice(["sk_live_", "ghp_", "xoxb-", "key-", "pk_test_"]) + pick(lower + upper + ten, rng.randrange(16, 40)),
        lambda: pick(upper + ten, rng.randrange(20, 32)), lambda: "eyJ" + pick(lower + upper + ten + "_-", 20) + "." + pick(lower + upper + ten + "_-", 30),
    ])()
    plain = lambda: rng.choice([
        *[lambda: rng.choice([str, str.title])("".join(word() for _ in range(6))[: rng.randrange(16, 40)].ljust(16, "a"))] * 3, lambda: "/".join(word() for _ in range(6)).ljust(16, "a"), lambda: ".".join(word() for _ in range(5)).ljust(16, "a"), lambda: "-".join(word() for _ in range(6)).ljust(16, "a"),
        lambda: "_".join(word() for _ in range(5)).upper().ljust(16, "A"), lambda: pick(ten, rng.randrange(16, 30)), lambda: "-" * rng.randrange(16, 60), lambda: "=" * rng.randrange(16, 60), lambda: "." * rng.randrange(16, 60),
        lambda: f"{pick(ten, 4)}-{pick(ten, 2)}-{pick(ten, 2)}T{pick(ten, 2)}.{pick(ten, 6)}", lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: f"{word()}.{pick(ten, 2)}.{word()}.example.com".ljust(16, "a"),
        lambda: word().title() + word().title() + word().title() + "HandlerFactoryBean", lambda: "".join(word() for _ in range(6)).upper()[:40].ljust(16, "A"), lambda: (word() + ".").join(["", "", "", "", ""]).strip(".").ljust(16, "e"),
    ])()
    cue = lambda: rng.choice(["key: ", "auth=", "credential = \"", "Bearer ", "client_secret=", "export AUTH='", "private key ", "access: "])
    out = []
    for _ in range(count):
        secret = rng.random() < 0.5
        body = key() if secret else plain()
        before = prose() + " " + (cue() if rng.random() < (0.7 if secret else 0.15) else "")
        after = rng.choice(["", "\"", "'", ".", ","]) + " " + prose()
        out.append((before + body + after, len(before), len(before) + len(body), int(secret)))
    return out


_MODEL: list[CharacterNetwork] = []


def model() -> CharacterNetwork:
    if not _MODEL:
        _MODEL.append(CharacterNetwork().fit(findings(FINDINGS, SEED)))
    return _MODEL[0]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of key-like characters, less the base spans (by start)."""
    out = []
    k, reach = 0, 0  # the next base span, and the end of those before
    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        at = max(at, min(reach, end))
        while k < len(base) and base[k][0] < end:
            out.append((at, base[k][0]))
            reach = max(reach, base[k][1])
            at = max(at, min(reach, end))
            k += 1
        out.append((at, end))
    bare = []
    for s, e in out:
        while e > s and text[e - 1] in ".-":
            e -= 1
        if e - s >= MIN_LENGTH:
            bare.append((s, e))
    return bare


def looks(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """(start, end, is a window) of what the network reads of a candidate, MIN_LENGTH to INSIDE characters each."""
    if end - start <= INSIDE:
        return [(start, end, False)]

    def slide(s: int, e: int, window: bool) -> list[tuple[int, int, bool]]:
        return [(x, x + INSIDE, window) for x in range(s, e - INSIDE, INSIDE // 2)] + [(max(s, e - INSIDE), e, window)]

    out = []
    for m in _PART.finditer(text, start, end):
        out += slide(*m.span(), False)
    return out + slide(start, end, True)


def _joined(found: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Stretches of the looks taken for secrets; a window only where no part is one."""
    parts = _union([(s, e) for s, e, window in found if not window])
    lone, k = [], 0
    for s, e in sorted((s, e) for s, e, window in found if window):
        while k < len(parts) and parts[k][1] <= s:
            k += 1
        if k == len(parts) or parts[k][0] >= e:
            lone.append((s, e))
    return _union(parts + lone)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_secrets(docs: DataFrame, network: CharacterNetwork | None = None) -> DataFrame:
    """doc_id, spans array<struct<start,end,kind,base>> of every row of ``docs(doc_id, text)``.

    Code points, ends exclusive, by start and kind. Null texts count as empty;
    repeated rows each have a row; an empty table gives an empty result; other
    columns are dropped.
    """
    network = network or model()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[dict(zip(("start", "end", "kind", "base"), x)) for x in spans] for spans in scan([t.as_py() or "" for t in batch.column(1)], network)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(*need(docs, "doc_id", "text")).mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string,base:boolean>>")


def scan(texts: list[str], network: CharacterNetwork) -> list[list[tuple[int, int, str, bool]]]:
    """The spans of each text; the network reads the candidates of all of them together."""
    out: list[list[tuple[int, int, str, bool]]] = []
    waiting: list[tuple[int, int, int, bool]] = []
    found: dict[int, list[tuple[int, int, bool]]] = {}

    def decide() -> None:
        if waiting:
            x, mask = (np.stack(v) for v in zip(*(encode(texts[i], s, e) for i, s, e, _ in waiting)))
            p = network.probability(x, mask, np.array([shape(texts[i], s, e) for i, s, e, _ in waiting]))
            for (i, s, e, window), q in zip(waiting, p):
                if q >= network.threshold:
                    found.setdefault(i, []).append((s, e, window))
            waiting.clear()

    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append([(s, e, k, True) for s, e, k in base])
        for s, e in candidates(text, base):
            for look in looks(text, s, e):
                waiting.append((i, *look))
                if len(waiting) >= 1024:
                    decide()
    decide()
    for i, own in found.items():
        out[i] += [(s, e, OTHER, False) for s, e in _joined(own)]
    for spans in out:
        spans.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return out


def redact(docs: DataFrame, mark: str = "[SECRET]", network: CharacterNetwork | None = None) -> DataFrame:
    """``docs`` with each secret's characters (of overlapping ones, their union) replaced by ``mark``, and n_chars to match."""
    network = network or model()
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = batch.column(at).to_pylist()
            found = scan([t or "" for t in texts], network)
            changed = [i for i, spans in enumerate(found) if spans]
            counts = batch.column(size).to_pylist()
            for i in changed:
                text, parts, end = texts[i], [], 0
                for s, e, _, _ in found[i]:
                    if s >= end:
                        parts += [text[end:s], mark]
                    end = max(end, e)
                texts[i] = "".join(parts) + text[end:]
                counts[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at], columns[size] = pa.array(texts, batch.schema.field(at).type), pa.array(counts, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(trimmed(run), docs.schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS)
