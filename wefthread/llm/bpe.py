"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string's prefix is a prefix of choices: each prefix has
exactly one token with which its encoding can end. Token t may end the prefix of
length i if t is its suffix and t may follow the last token of the prefix before
t; two tokens may be neighbours if merging their joined bytes gives back just
the two. So one array holds the last token of every prefix; following it
backwards reads off the encoding, more bytes extend it exactly, and after an
edit it is computed anew only until it agrees with what was there.

The ranks decide the merges: of all neighbouring parts whose union has a rank,
the lowest rank merges first. A piece that is itself a token is that token.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import need, trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Encodings of pieces that a Python worker keeps, twice: a full table becomes the old one, from which pieces in use return.
CACHE_PIECES = 200_000
#: Prefixes of up to SHARED bytes whose last tokens a worker keeps.
SHARED, SHARED_PREFIXES = 24, 300_000
#: Rows that are encoded before they are handed on.
PART_ROWS = 512
#: Longer texts are split into pieces step by step.
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        top = max(self.bytes_of) + 1
        self._size = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)])
        self._start = np.cumsum(self._size) - self._size
        self._table = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self._pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        #: Of the tokens that end in given three bytes, the longest one's length.
        self._tails: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 2:
                self._tails[token[-3:]] = max(len(token), self._tails.get(token[-3:], 2))
        self._prefixes: dict[bytes, int] = {}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for bytes {missing[:5]}")

    def merge(self, data: bytes) -> list[bytes]:
        """The definition, for short strings: merge the lowest rank until none is left."""
        parts, rank, never = [data[i : i + 1] for i in range(len(data))], self.ranks.get, 1 << 62
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], never)
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            x, y = self.bytes_of[a], self.bytes_of[b]
            ok = self._pairs[key] = self.merge(x + y) == [x, y]
        return ok

    def may_start(self, a: int) -> bool:
        ok = self._alone.get(a)
        if ok is None:
            ok = self._alone[a] = len(self.merge(self.bytes_of[a])) == 1
        return ok

    def extend(self, data: bytes, last: list[int], until: int) -> None:
        """Grow ``last``, where last[i] ends the prefix of length i, to the prefix of length ``until``."""
        rank, tail, known = self.ranks.get, self._tails.get, self._pairs.get
        for i in range(len(last), until + 1):
            most = tail(data[i - 3 : i], 2) if i > 2 else i
            for j in range(i - most if i > most else 0, i):
                t = rank(data[j:i])
                if t is None:
                    continue
                if j:
                    ok = known(last[j] << 32 | t)
                    if ok is None:
                        ok = self.may_follow(last[j], t)
                else:
                    ok = self.may_start(t)
                if ok:
                    last.append(t)
                    break
            else:
                raise AssertionError("a prefix without a last token")

    def back(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last, known = [-1], self._prefixes
        n = min(len(piece), SHARED)
        for i in range(1, n + 1):  # the prefix's last token, from an earlier piece that began alike
            t = known.get(piece[:i])
            if t is None:
                break
            last.append(t)
        else:
            i = n + 1
        self.extend(piece, last, len(piece))
        if len(known) > SHARED_PREFIXES:
            known.clear()
        for i in range(i, n + 1):
            known[piece[:i]] = last[i]
        return self.back(last)

    def decode(self, ids) -> bytes:
        """The bytes of the tokens, gathered from one table of all tokens' bytes."""
        ids = np.asarray(ids, np.int64)
        n = self._size[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        return self._table[np.repeat(self._start[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


class PrefixEncoding:
    """The encoding of bytes that grow and change, by merges alone (no splitting pattern)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:end]; returns how many prefixes were computed anew."""
        old, longest = self.last, self.vocabulary.longest
        shift = len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        same = 0
        for i in range(start + 1, len(self.data) + 1):
            self.vocabulary.extend(self.data, self.last, i)
            # a state looks back at most `longest` bytes and states; as many equal ones in a row settle the rest
            same = same + 1 if i > start + len(new) and old[i - shift] == self.last[i] else 0
            if same >= longest:
                self.last += old[i - shift + 1 :]
                return i - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        return self.vocabulary.back(self.last)


class TextEncoder:
    """Texts to ids as little-endian unsigned 32-bit integers, each match of the pattern by itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            ids = self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 64:
            self.known[piece] = found
        return found

    def _turn(self) -> None:
        if len(self.known) >= CACHE_PIECES:
            self.old, self.known = self.known, {}

    def encode(self, text: str) -> bytes:
        self._turn()
        get, ids = self.known.get, self._ids
        if len(text) <= LONG_TEXT:
            return b"".join([get(p) or ids(p) for p in self.pattern.findall(text)])
        out = bytearray()
        for m in self.pattern.finditer(text):
            p = m.group()
            out += self.known.get(p) or ids(p)
            self._turn()
        return bytes(out)


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each vocabulary in a Python worker; its tables stay from task to task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(Vocabulary(read_ranks(path)), pattern)
    return _ENCODERS[path, pattern]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False, forget: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``, the little-endian bytes, with ``keep_ids``) of every row.

    ``path`` is the vocabulary's place on every executor. The ids are decoded again
    and hashed. Null texts count as empty; repeated rows each have a row; an empty
    table gives an empty result; other columns are dropped. Rows stay in their
    partitions: nothing is shuffled. With ``forget`` a worker keeps no encoder after
    a task, so that other steps of the session have its memory.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # few rows at a time: ids take more room than their texts
            for i in range(0, batch.num_rows, PART_ROWS):
                yield batch.slice(i, PART_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        if forget:
            _ENCODERS.clear()
        for batch in parts(batches):
            n, a, b, kept = [], [], [], []
            for text in batch.column(1):
                ids = enc.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                h = hashlib.sha256()
                each = np.frombuffer(ids, "<u4")
                for i in range(0, len(each), 1 << 16):
                    h.update(enc.vocabulary.decode(each[i : i + (1 << 16)]))
                b.append(h.hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return docs.select(*need(docs, "doc_id", "text")).mapInArrow(trimmed(run), schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
