"""Text functions as column expressions: folding, tokens, names, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their plain forms (fixed values).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; a null text has none."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1), F.array().cast("array<string>"))


def occurrences(toks: Column, phrase: list[str], prefix: bool = False) -> Column:
    """How often ``phrase`` stands in ``toks``; with ``prefix`` its last word may go on."""
    spaced = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    return F.regexp_count(spaced, F.lit(f"(?= {' '.join(phrase)}{'' if prefix else ' '})"))


def name_words(name: Column) -> Column:
    """An identifier's words of three letters or more: split at ``_``, ``-``, spaces and capitals, lower-cased."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"[_\-]+", " "), r"(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), r"\s+"), lambda w: F.octet_length(w) >= 3)


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and with ``..`` taken back."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """All folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def is_test_uid(uid: Column) -> Column:
    return F.lower(uid).rlike(r"\.test\.|\.spec\.|__tests__|/test/|/tests/|_test\.|_spec\.")
