"""Column functions on strings: tokens, k-grams, shingles, edit distance (TXT-*)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates words; Spark and DuckDB read it alike.
SEPARATORS = r"[^\p{L}\p{N}]+"
#: Letters from U+00C0 to U+017E that don't decompose into a plain one and a mark.
_WHOLE = {"Æ": "E", "æ": "e", "Ð": "D", "ð": "d", "Ø": "O", "ø": "o", "Þ": "T", "þ": "t", "ß": "S", "×": "*", "÷": "/", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ĳ": "J", "ĳ": "j", "ĸ": "k", "Ŀ": "L", "ŀ": "l", "Ł": "L", "ł": "l", "ŉ": "n", "Ŋ": "N", "ŋ": "n", "Œ": "O", "œ": "o", "Ŧ": "T", "ŧ": "t"}
_ACCENTED = "".join(map(chr, range(0xC0, 0x17F)))
_PLAIN = "".join(_WHOLE.get(c) or unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
PUNCTUATION = r"[!-/:-@\[-`{-~]"
_PAIR, _JOINT = r"[0-9]+[.,\-]", r"(?:[.,\-][0-9]+)?"
#: Tokens that words and punctuation alone don't make; the first that matches anywhere wins.
PATTERNS = [
    r"https?://[^\s]+",
    r"[\w.]+@[A-Za-z.0-9\-]+",
    r"[+][-0-9,]+",
    r"(?:[0-9]{4}|[0-9]{2})[/\-][0-9]{2}[/\-][0-9]{2}",
    _PAIR + r"[0-9]+" + _JOINT * 3,
    "'em",
    "[a-zA-Z]+'[a-zA-Z]+",
    r"[0-9]{2}:[0-9]{2}(?::[0-9]{2})?",
    r"[0-9]+[.,/][0-9]+",
    r"\w[.]\w[.]",
    r"\$[0-9]+",
    r"\w+-[0-9a-zA-Z]+",
    r"\w+\.(?:doc|ppt|xlsx)",
]


def words(text: Column) -> Column:
    """Lower-cased words in order; null for null."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda x: x != "")


def printable_tokens(text: Column, keep_punctuation: bool = False) -> Column:
    """Letters and printable ASCII make chunks, which punctuation splits; its signs are tokens of their own, or dropped."""
    if keep_punctuation:
        return F.regexp_extract_all(text, F.lit(PUNCTUATION + r"|[\p{L}0-9]+"), F.lit(0))
    return F.filter(F.split(text, r"[^\p{L}0-9]+"), lambda x: x != "")


def printable_chunks(text: Column) -> Column:
    """Runs of letters and printable ASCII, as they stand between anything else."""
    return F.filter(F.split(text, r"[^\p{L}!-~]+"), lambda x: x != "")


def pattern_tokens(text: Column, patterns: Sequence[str] = PATTERNS) -> Column:
    """Tokens of each chunk, where the first listed pattern that matches anywhere in it is taken whole.

    What stands before it is split at punctuation, what follows is read again with all patterns. The
    order of patterns, not of places, decides, which an alternation can't say; so this is a vectorised UDF.
    """
    compiled = [re.compile(p, re.ASCII) for p in patterns]
    chunk, plain = re.compile(r"(?:[^\W\d_]|[!-~])+"), re.compile(r"(?:[^\W\d_]|[0-9])+")

    def split(s: str) -> list[str]:
        done: list[str] = []
        for part in chunk.findall(s):
            at = 0
            while hit := next((m for p in compiled if (m := p.search(part, at)) and m.group()), None):
                done += [*plain.findall(part[at : hit.start()]), hit.group()]
                at = hit.end()
            done += plain.findall(part[at:])
        return done

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else split(x))

    return run(text)


def plain_letters(text: Column) -> Column:
    """Letters from U+00C0 to U+017E without their marks, one for one; some have a stand-in (æ is e, × is *)."""
    return F.translate(text, _ACCENTED, _PLAIN)


def kgrams(term: Column, k: int) -> Column:
    """Substrings of k characters of ^term$, in order; none for a term too short."""
    framed = F.concat(F.lit("^"), term, F.lit("$"))
    at = F.sequence(F.lit(1), F.greatest(F.length(framed) - (k - 1), F.lit(1)))
    return F.when(F.length(framed) >= k, F.transform(at, lambda i: F.substring(framed, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, k: int, hashed: bool = True, include_last: bool = True) -> Column:
    """Distinct character k-grams, lower-cased after cutting; hashed by CRC-32 unless told not to.

    The characters are split off once, so that the time is linear in the text's length.
    """
    less = k - (1 if include_last else 0)  # of k-grams fewer than characters
    empty = F.array().cast("array<string>")
    # bound as a variable, the characters are split off once and not for every k-gram again
    split = F.array(F.filter(F.split(text, ""), lambda c: c != ""))
    grams = lambda chars: F.when(F.size(chars) > less, F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - less, F.lit(1))), lambda i: F.lower(F.array_join(F.slice(chars, i, F.lit(k)), "")))).otherwise(empty)
    cut = F.transform(split, grams)[0]
    return F.array_distinct(F.transform(cut, lambda s: F.crc32(F.encode(s, "utf-8"))) if hashed else cut)


def indel_at_most_two(a: Column, b: Column) -> Column:
    """Whether the edit distance with insertions and deletions of cost 1 and replacements of cost 2 is at most 2.

    At that distance words are equal, or differ by one or two insertions only, or are of one length
    and become equal when each loses one character.
    """
    lev, apart = F.levenshtein(a, b), F.abs(F.length(a) - F.length(b))
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return (a == b) | ((lev <= 2) & apart.isin(1, 2) & (lev == apart)) | ((apart == 0) & (lev <= 2) & F.arrays_overlap(drop(a), drop(b)))


def indel_distance(a: Column, b: Column) -> Column:
    """That distance in general, as a vectorised UDF: length of both less twice their longest common subsequence."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s, t):
            if s is None or t is None:
                return None
            row = [0] * (len(t) + 1)
            for c in s:
                before = 0
                for j, d in enumerate(t, 1):
                    before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
            return len(s) + len(t) - 2 * row[-1]

        return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def query_terms(query: str) -> list[str]:
    """A query's words in lower case."""
    return query.lower().split()


def query_words(query: Column) -> Column:
    """The same of a column."""
    return F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda x: x != "")


def hash_slot(term: Column, slots: int) -> Column:
    """Place of a term in a table of ``slots``: its characters as digits to the base 31."""
    codes = F.transform(F.split(term, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c)).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(slots)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def content_type(uri: Column) -> Column:
    """Media type by the suffix of the path; a path that ends in / is that of its index.html."""
    path = F.lower(F.regexp_extract(uri, r"^[^?#]*", 0))
    path = F.when(path.endswith("/"), F.concat(path, F.lit("index.html"))).otherwise(path)
    kinds = {"html?": "text/html", "css": "text/css", "txt": "text/plain", "js": "application/javascript", "json": "application/json", "png": "image/png", "jpe?g": "image/jpeg", "gif": "image/gif"}
    out = F.lit("application/octet-stream")
    for suffix, kind in kinds.items():
        out = F.when(path.rlike(rf"\.{suffix}$"), kind).otherwise(out)
    return out


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy, HH:mm:ss")
