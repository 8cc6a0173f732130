"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns (``base_spans``) always stand. The model reads the surroundings of
words that may belong to an entity and scores whole segments of up to LENGTH
words by features of the segment as one: digits, groups, separators, checksum,
words before. A Viterbi search over segment ends and types picks boundaries and
types together. It finds what patterns can't: spelled-out addresses, numbers in groups.

There are no labelled entities in the tables; the model is fitted by conditional
likelihood on generated windows with known spans (``examples``), once in a driver.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need

KINDS = ("email", "ip", "card", "phone")
LENGTH, CONTEXT = 7, 3
#: Entities that one search may find: as many as there are.
ENTITIES = float("inf")
#: How much better the best labelling must be than the one without an entity.
MARGIN = 1.0
EPOCHS, EXAMPLES, SEED = 12, 400, 8
#: Words whose segments are scored at once.
BLOCK = 1024
#: Whether the model may report 13-19 digits that fail the checksum as a card: mistyped ones are personal data, too.
UNCHECKED_CARDS = True

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By the at-signs, so that a long run without one is read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as in KINDS."""
    out = [(s, e, "email") for s, e in _emails(text)]
    if any(map(text.__contains__, "0123456789")):
        for m in _IP.finditer(text):
            if all(len(x) < 4 and int(x) <= 255 or int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdecimal() for c in m.group()) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# --- the model ---------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What makes a word a candidate: a digit, an at-sign, or a spelled-out one.
_TRIGGER = re.compile(r"[0-9@]|[\[({]\s*(?:at|dot)\s*[\])}]|(?<![^\x20\x09-\x0D])(?:at|AT|At|dot|DOT|Dot)(?![^\x20\x09-\x0D])")
_CUES = {
    "email": {"mail", "email", "e-mail", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "node"},
    "card": {"card", "visa", "mastercard", "amex", "account", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone"},
}
_AT = {"at", "(at)", "[at]", "{at}", "@"}
_DOT = {"dot", "(dot)", "[dot]", "{dot}", "."}
_TOP = {"com", "org", "net", "edu", "io", "de", "fr", "es", "gov", "info", "example"}
_STRIP = ".,;:!?|\"'()[]{}<>"
_SHAPES = 22


def features(words: list[str], i: int, j: int) -> np.ndarray:
    """Of the segment words[i:j] as a whole."""
    part = words[i:j]
    bare = [w.strip(_STRIP).lower() if w.lower() not in _AT | _DOT else w.lower() for w in part]
    joined = " ".join(part).strip(_STRIP)
    digits = sum(c.isdecimal() for c in joined)
    letters = sum(c.isalpha() for c in joined)
    n = max(1, len(joined.replace(" ", "")))
    ats = sum(w in _AT for w in bare) + joined.count("@") - sum(w == "@" for w in bare)
    dots = sum(w in _DOT for w in bare)
    numeric = letters == 0 and digits > 0
    groups = re.findall(r"[0-9]+", joined)
    before = [w.strip(_STRIP).lower() for w in words[max(0, i - 2) : i]]
    spelled = ats == 1 and bare[0] not in _AT | _DOT and bare[-1] in _TOP and len(part) >= 3 and dots >= 1 and all((w in _AT | _DOT) == (k % 2 == 1) for k, w in enumerate(bare))
    quad_in_words = len(part) == 7 and all(w in _DOT for w in bare[1::2]) and all(w.isdecimal() and w.isascii() and len(w) <= 3 and int(w) <= 255 for w in bare[::2])
    quad = numeric and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    d = "".join(groups)
    fours = numeric and len(groups) == 4 and all(len(g) == 4 for g in groups)
    return np.array(
        [
            1.0, len(part) == 1, (len(part) - 1) / LENGTH, digits / n, letters / n, numeric and digits < 7, numeric and 7 <= digits <= 12, numeric and 13 <= digits <= 19,
            numeric and digits > 19, fours or (numeric and len(groups) == 1 and 15 <= digits <= 16), numeric and 14 <= digits <= 19 and luhn(d), quad and "." in joined and joined.count(".") == 3,
            quad_in_words, spelled, ats == 1 and "@" in joined and "." in joined.split("@")[-1], numeric and joined.startswith("+") and 9 <= digits <= 15,
            numeric and "(" in joined and 9 <= digits <= 12, numeric and 3 <= len(groups) <= 5 and 9 <= digits <= 12 and all(2 <= len(g) <= 4 for g in groups), *(any(b in _CUES[k] for b in before) for k in KINDS),
        ],
        float,
    )


class SemiMarkov:
    """Weights of whole-segment features for each type and of outside words; w[0] is for words outside."""

    def __init__(self, weights: np.ndarray):
        self.w = weights

    def scores(self, words: list[str], first: int = 0, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Features f[i, l] of the segment of l + 1 words from word first + i, and its scores as each kind."""
        n = len(words)
        f = np.zeros((n - first if count is None else count, LENGTH, _SHAPES))
        for i in range(len(f)):
            for l in range(min(LENGTH, n - first - i)):
                f[i, l] = features(words, first + i, first + i + l + 1)
        return f, f @ self.w.T

    def fit(self, windows: list[tuple[list[str], list[tuple[int, int, int]]]]) -> SemiMarkov:
        """Gradient steps on the conditional log-likelihood, by forward and backward sums over segments."""
        ready = []
        for words, spans in windows:
            f, _ = self.scores(words)
            gold = {(i, j - i - 1): k for i, j, k in spans}
            ready.append((f, gold))
        total = np.zeros_like(self.w)
        for epoch in range(EPOCHS):
            for f, gold in ready:
                grad = -self._expected(f)
                covered = set()
                for (i, l), k in gold.items():
                    grad[k + 1] += f[i, l]
                    covered.update(range(i, i + l + 1))
                for i in range(len(f)):
                    if i not in covered:
                        grad[0] += f[i, 0]
                grad -= 0.002 * self.w
                total += grad**2
                self.w = self.w + 0.5 * grad / np.sqrt(total + 1e-3)
        return self

    def _segments(self, f: np.ndarray, n: int | None = None) -> np.ndarray:
        """Scores of segments, of which the last ends n words after the first begins."""
        s = f @ self.w.T
        s[:, 1:, 0] = -np.inf  # outside words are segments of one
        n = len(f) if n is None else n
        for l in range(LENGTH):
            s[max(0, n - l) :, l] = -np.inf
        return s

    def _expected(self, f: np.ndarray) -> np.ndarray:
        s = self._segments(f)
        n = len(f)
        each = np.logaddexp.reduce(s, 2)
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0.0
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - l - 1] + each[j - l - 1, l] for l in range(min(LENGTH, j))])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + l + 1] + each[i, l] for l in range(min(LENGTH, n - i))])
        out = np.zeros_like(self.w)
        for l in range(min(LENGTH, n)):
            i = np.arange(n - l)
            p = np.exp(ahead[i, None] + s[i, l] + behind[i + l + 1, None] - ahead[n])
            out += p.T @ f[i, l]
        return out

    def best(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, kind) of the best labelling whose entities beat their outside reading by MARGIN each."""
        n = len(words)
        kinds, tops, outside = [], [], []
        for i in range(0, n, BLOCK):  # features take 1.2 kB a word: they are made for a block at a time
            m = min(BLOCK, n - i)
            f, _ = self.scores(words[max(0, i - 2) : i + m + LENGTH - 1], i - max(0, i - 2), m)
            s = self._segments(f, n - i)
            kinds.append(s[:, :, 1:].argmax(2))
            tops += (s[:, :, 1:].max(2) - MARGIN).tolist()
            outside += s[:, 0, 0].tolist()
        kind, top = np.concatenate(kinds) if n else np.zeros((0, LENGTH), int), tops
        value, back = [0.0], [(0, False)]
        for j in range(1, n + 1):
            options = [(value[j - 1] + outside[j - 1], j - 1, False)]
            options += [(value[j - l - 1] + top[j - l - 1][l], j - l - 1, True) for l in range(min(LENGTH, j))]
            best = max(options, key=lambda x: x[0])
            value.append(best[0])
            back.append(best[1:])
        j, out = n, []
        while j > 0:
            i, entity = back[j]
            if entity:
                out.append((i, j, int(kind[i, j - i - 1])))
            j = i
        return out[::-1]


def examples(count: int, seed: int) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Windows of made-up words with entities of known boundaries, and look-alikes that are none."""
    rng = random.Random(seed)
    syllables = "an the er on re ti en ou st ing ed ai que tion de la mente ung che".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    top = lambda: rng.choice(sorted(_TOP - {"example"}))
    at, dot = lambda: rng.choice(["at", "(at)", "[at]", "AT"]), lambda: rng.choice(["dot", "(dot)", "[dot]"])

    def entity(kind: int) -> list[str]:
        if kind == 0:
            return rng.choice([lambda: [word(), at(), word(), dot(), top()], lambda: [word(), dot(), word(), at(), word(), dot(), top()], lambda: [f"{word()}@{word()}.{top()}"], lambda: [word(), at(), word(), dot(), word(), dot(), top()]])()
        if kind == 1:
            parts = [str(rng.randrange(256)) for _ in range(4)]
            return rng.choice([[".".join(parts)], f" {dot()} ".join(parts).split(), ["[.]".join(parts)]])
        if kind == 2:
            return rng.choice([lambda: [digits(16)], lambda: [digits(4) for _ in range(4)], lambda: ["-".join(digits(4) for _ in range(4))], lambda: [digits(4), digits(6), digits(5)]])()
        return rng.choice([lambda: [f"+{digits(2)}", digits(3), digits(3), digits(4)], lambda: [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"{digits(3)}-{digits(3)}-{digits(4)}"], lambda: [f"+{digits(11)}"]])()

    def noise() -> list[str]:
        return rng.choice([
            lambda: [digits(rng.randrange(1, 7))], lambda: [f"{digits(1)}.{digits(1)}"], lambda: [f"{digits(4)}-{digits(2)}-{digits(2)}"], lambda: ["at", word()], lambda: [word(), "dot", word()],
            lambda: [f"@{word()}"], lambda: ["at", digits(2)], lambda: [f"v{digits(1)}.{digits(1)}.{digits(1)}"], lambda: [digits(3), word(), digits(3)], lambda: [f"{digits(2)}:{digits(2)}"], lambda: [digits(rng.randrange(20, 40))],
            lambda: [f"{word()}{digits(3)}"], lambda: [f"${digits(3)}.{digits(2)}"], lambda: ["(at)", word()], lambda: [digits(3), digits(3)], lambda: ["%x" % rng.getrandbits(160)],
        ])()

    out = []
    for _ in range(count):
        words: list[str] = []
        spans = []
        for _ in range(rng.randrange(1, 4)):
            words += [word() for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.5:
                words += noise()
                continue
            kind = rng.randrange(4)
            if rng.random() < 0.3:
                words.append(rng.choice(sorted(_CUES[KINDS[kind]])) + rng.choice(["", ":"]))
            part = entity(kind)
            spans.append((len(words), len(words) + len(part), kind))
            part[-1] += rng.choice(["", "", ".", ","])
            words += part
        words += [word() for _ in range(rng.randrange(0, 3))]
        out.append((words, spans))
    return out


_MODEL: list[SemiMarkov] = []


def model() -> SemiMarkov:
    if not _MODEL:
        _MODEL.append(SemiMarkov(np.zeros((len(KINDS) + 1, _SHAPES))).fit(examples(EXAMPLES, SEED)))
    return _MODEL[0]


def windows(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the surroundings of candidates, in code points; they don't overlap."""
    open_ = None
    for m in _TRIGGER.finditer(text):
        start = m.start()
        for _ in range(CONTEXT + 1):
            start = _before(text, start)
        end = m.end()
        for _ in range(CONTEXT + 1):
            end = _after(text, end)
        if open_ and start <= open_[1]:
            open_ = (open_[0], max(end, open_[1]))
        else:
            if open_:
                yield open_
            open_ = (start, end)
    if open_:
        yield open_


_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word's characters that a window looks at, at most; longer ones are no entity.
_REACH = 200


def _before(text: str, at: int) -> int:
    low = max(0, at - _REACH)
    while at > low and text[at - 1] in _SPACES:
        at -= 1
    while at > low and text[at - 1] not in _SPACES:
        at -= 1
    return at


def _after(text: str, at: int) -> int:
    high = min(len(text), at + _REACH)
    while at < high and text[at] in _SPACES:
        at += 1
    while at < high and text[at] not in _SPACES:
        at += 1
    return at


def model_spans(text: str, crf: SemiMarkov) -> Iterator[tuple[int, int, str]]:
    for start, end in windows(text):
        words = [(m.group(), m.start() + start, m.end() + start) for m in _WORD.finditer(text[start:end])]
        words = [w if len(w[0]) <= _REACH else ("_", w[1], w[2]) for w in words]
        for a, b, kind in crf.best([w[0] for w in words]):
            s, e = words[a][1], words[b - 1][2]
            while s < e and text[s] in _STRIP.replace("(", "").replace("[", "") + "\"'":
                s += 1
            while e > s and text[e - 1] in ".,;:!?|\"'> ":
                e -= 1
            if s < e and (UNCHECKED_CARDS or KINDS[kind] != "card" or luhn("".join(c for c in text[s:e] if c in "0123456789"))):
                yield s, e, KINDS[kind]


def apart(spans: Iterable[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans, in order, that meet none of the base spans, by start."""
    out, k, reach = [], 0, 0
    for s, e, kind in spans:
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= s:
            out.append((s, e, kind))
    return out


def find_pii(docs: DataFrame, crf: SemiMarkov | None = None) -> DataFrame:
    """doc_id, spans array<struct<start,end,kind,base>> of every row of ``docs(doc_id, text)``.

    Code points, ends exclusive, by start and kind. The model's spans that meet a
    pattern's are left out: patterns stand. Null texts count as empty; repeated rows
    each have a row; an empty table gives an empty result; other columns are dropped.
    """
    crf = crf or model()
    schema = "doc_id long, spans array<struct<start:int,end:int,kind:string,base:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = apart(model_spans(text, crf), base)
                spans = [(s, e, k, True) for s, e, k in base] + [(s, e, k, False) for s, e, k in more]
                spans.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                out.append([dict(zip(("start", "end", "kind", "base"), x)) for x in spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(*need(docs, "doc_id", "text")).mapInArrow(run, schema)


def digest(found: DataFrame, kinds=KINDS) -> DataFrame:
    """doc_id, a count for each kind of the patterns' spans, base_sha256, spans (all) as text."""
    base = F.filter("spans", lambda x: x["base"])
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(F.encode(text(base), "UTF-8"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return F.filter("spans", lambda x: x["base"] & (x["kind"] == F.lit(kind)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))
