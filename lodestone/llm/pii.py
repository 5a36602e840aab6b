"""Offset-preserving PII detection under disguise.

Three transducers rewrite a text and keep, for every character they emit, the source span it stands
for: homoglyphs (full-width, styled, Cyrillic and Greek look-alikes; invisible characters vanish),
digits spelled as words in four languages, and "(at)" / "dot" disguises. Identifiers are looked for
in the rewritten text, and their spans are mapped back to source characters.

A transducer runs only if its trigger occurs in the text; a text without a digit, "@" or "::" after
that has no identifier. Every pattern starts at the border of a run of its characters, so that the time
is linear in the text's length.

What only looks like an identifier is left alone: card numbers must pass the Luhn check and IBANs theirs,
SSNs lie in the ranges that are given out, an address of four numbers after "version" is none, a secret's
value isn't a plain word, and a bare number is a phone number only after a word that says so.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import give_back, text_of

_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһԛԝкмтвнАВЕКМНОРСТХУІЈЅαορνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑‒–—―−․。｡﹒·∙⁎",
        "aeopcyxijsdhqwkmtbhABEKMHOPCTXYIJSaopviktuxABEZHIKMNOPTYX-------......*",
        strict=False,
    )
)


def _homoglyphs() -> dict[str, str]:
    table = dict(_LOOKALIKES)
    for lo, hi in ((0x2070, 0x209F), (0x2460, 0x24FF), (0x2100, 0x214F), (0xFE50, 0xFE6F), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x1F100, 0x1F16F)):
        for c in map(chr, range(lo, hi + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and 32 < ord(plain) < 127:
                table[c] = plain
    for zero in (0x660, 0x6F0, 0x966):
        table |= {chr(zero + i): str(i) for i in range(10)}
    table |= dict.fromkeys("           　", " ")
    return table | dict.fromkeys("­​‌‍⁠﻿", "")


HOMOGLYPHS = _homoglyphs()
_SPELLED = {}
for _words in (
    "zero one two three four five six seven eight nine",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
):
    _SPELLED |= {w: str(i) for i, w in enumerate(_words.split())}
_SPELLED["oh"] = "0"

_LATIN1 = [c for c in HOMOGLYPHS if ord(c) < 256]
#: Last labels after which "name at host dot label", without brackets, is read as an address.
TOP_LABELS = frozenset("com org net edu gov mil int info biz io co ai app dev me eu uk us de fr es it nl ch at be pt br mx ar cl ca au nz in jp cn ru pl se no dk fi cz ie".split())
_NUMBER = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:{_NUMBER}|\d+)(?:[ \t.,\-()]{{1,3}}(?:{_NUMBER}|\d+))*[ \t.,\-()]{{1,3}}{_NUMBER}(?:[ \t.,\-()]{{1,3}}(?:{_NUMBER}|\d+))*(?!\w)", re.I)
_GAP = re.compile(r"[ \t.,\-()]{2,3}|[,.()]")
_SPELLED_WORD = re.compile(rf"(?<!\w){_NUMBER}(?!\w)", re.I)
_BREAKS = str.maketrans(dict.fromkeys(",.-()\t\n", " "))
_LABEL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+-")
_AT = re.compile(r"[ \t]{0,2}[\[({<][ \t]{0,2}(?:at|arroba|@)[ \t]{0,2}[\])}>][ \t]{0,2}|[ \t]{1,2}(?:at|arroba)[ \t]{1,2}|[ \t]{0,2}@[ \t]{0,2}", re.I)
_DOT = r"(?:[ \t]{0,2}[\[({<][ \t]{0,2}(?:dot|punto|point|punkt|\.)[ \t]{0,2}[\])}>][ \t]{0,2}|[ \t]{1,2}(?:dot|punto|point|punkt)[ \t]{1,2}|\.)"
_DOT_RE, _DOT_BEFORE = re.compile(_DOT, re.I), re.compile(_DOT + r"\Z", re.I)
#: No dot is longer, so what stands before a label is one exactly if the characters just before it are.
_DOT_WIDTH = 16
#: In every text in which the at/dot transducer would change something.
_AT_TRIGGER = re.compile(r"[\[({<][ \t]{0,2}(?:at|arroba|@|dot|punto|point|punkt|\.)[ \t]{0,2}[\])}>]|[ \t](?:dot|punto|point|punkt)[ \t]|[ \t]@|@[ \t]", re.I)
_TOP = re.compile(r"[A-Za-z]{2,24}(?![A-Za-z0-9])")
_BRACKET = re.compile(r"[\[({<]")

_SECRET_WORDS = ("token", "secret", "key", "passw", "pwd", "akia", "gh", "sk-")
_TRIGGER = re.compile(r"[0-9@]|::")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_CALL = r"(?:phone|telephone|tel|call|mobile|cell|fax|sms|whatsapp|teléfono|telefono|móvil|téléphone|portable|telefon|handy|mobil)"
PATTERNS = [
    ("SECRET", re.compile(r"(?<![A-Za-z])(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([^\s\"']{6,})", re.I)),
    ("SECRET", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_\-]{20,})(?![A-Za-z0-9])")),
    ("EMAIL", re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}")),
    ("IBAN", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("IP", re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)")),
    ("IP", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])")),
    ("SSN", re.compile(r"(?<![\d\-])(?!000|666|9)\d{3}([\- ])(?!00)\d{2}\1(?!0000)\d{4}(?![\d\-])")),
    ("CARD", re.compile(r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])")),
    ("PHONE", re.compile(r"(?<![\w+])(?:\+|00(?!\d{14}))[1-9]\d{0,2}[ .\-]{0,2}(?:\(\d{1,4}\)[ .\-]{0,2})?\d(?:[ .\-]{0,2}\d){5,11}(?!\d)")),
    ("PHONE", re.compile(r"(?<![\w+\-.])\d(?:[ \-]\d){6,11}(?![\d\-])")),
    ("PHONE", re.compile(r"(?<![\w+\-.])(?:\(\d{3}\)[ .\-]{0,2}|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])")),
    ("PHONE", re.compile(rf"(?<!\w){_CALL}(?:[ \t]?(?:no|nr|number|número|numéro|nummer|at|me at|us at))?[.:]?[ \t]{{0,2}}(\d{{7,15}})(?!\w)", re.I)),
]
_SPACED, _VERSION = PATTERNS[-3][1], re.compile(r"(?:\bv|\bver|\bversions?|\breleases?|\brev|\bsection|\bchapter|§)[.:]?[ \t]{0,2}\Z", re.I)
_DIGITS = re.compile(r"\d")


class Mapped:
    """A rewritten text; ``cuts`` holds (place in it, place in the source, length here, length there) of each rewrite."""

    def __init__(self, text: str):
        self.text, self.layers = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply sorted, disjoint replacements (start, end, new)."""
        if not edits:
            return
        out, here, at, new_at = [], [], 0, 0
        for lo, hi, new in edits:
            out += [self.text[at:lo], new]
            new_at += lo - at
            here.append((new_at, lo, len(new), hi - lo))
            new_at += len(new)
            at = hi
        out.append(self.text[at:])
        self.text = "".join(out)
        self.layers.append(([x[0] for x in here], here))

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        """The source span of the characters [lo, hi) of the rewritten text."""
        for starts, cuts in reversed(self.layers):
            lo, hi = self._back(starts, cuts, lo, False), self._back(starts, cuts, hi - 1, True)
        return lo, hi

    @staticmethod
    def _back(starts, cuts, at: int, end: bool) -> int:
        i = bisect.bisect_right(starts, at) - 1
        if i < 0:
            return at + end
        new_at, old_at, n, m = cuts[i]
        if at < new_at + n:
            return old_at + m if end else old_at
        return at - new_at - n + old_at + m + end


def _lookalikes(text: str) -> list[str]:
    """The characters of HOMOGLYPHS that occur in the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return sorted(HOMOGLYPHS.keys() & set(text))
    return [c for c in _LATIN1 if c in text]


def _spelled(low: str) -> bool:
    """Whether a number word stands next to another one or to digits."""
    if low.isascii():
        words = low.translate(_BREAKS).split()
    else:
        for c in ",.-()":
            low = low.replace(c, " ")
        words = low.split()
    hits = [i for i, w in enumerate(words) if w in _SPELLED]
    return any(b - a == 1 for a, b in zip(hits, hits[1:], strict=False)) or any((i and words[i - 1].isdigit()) or words[i + 1 : i + 2] and words[i + 1].isdigit() for i in hits)


def deobfuscate(text: str) -> Mapped:
    """The text after the three transducers."""
    m = Mapped(text)
    if not text.isascii() and (odd := _lookalikes(text)):
        m.rewrite([(x.start(), x.end(), HOMOGLYPHS[x.group()]) for x in re.finditer("[" + re.escape("".join(odd)) + "]", text)])
    low = m.text.lower()
    if _spelled(low):
        edits = []
        for run in _SPELLED_RUN.finditer(m.text):
            words = [(x.start(), x.end(), _SPELLED[x.group().lower()]) for x in _SPELLED_WORD.finditer(m.text, run.start(), run.end())]
            if len(words) + len(_DIGITS.findall(run.group())) >= 7:
                edits += words
                # separators other than one blank or hyphen between digits would hide the number
                edits += [(run.start() + x.start(), run.start() + x.end(), "-") for x in _GAP.finditer(run.group())]
        m.rewrite(sorted(edits))
    if _AT_TRIGGER.search(m.text):
        m.rewrite(_addresses(m.text))
    return m


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """The rewrites of disguised addresses: around each at, as many dotted labels as there are on either side.

    The last label is of 2 to 24 letters. An at in words, without a bracket, counts only before a dot in
    words or brackets and a known last label ("look at example.com", "look at the dot product"). Labels
    are walked through from the at, so that the time is linear and their number and length have no bound.
    """
    edits: list[tuple[int, int, str]] = []
    done = 0
    for x in _AT.finditer(text):
        lo, hi = x.span()
        if lo < done or not (dots := _name_before(text, lo, done)) or not (tail := _host_after(text, hi)):
            continue
        after, end, top = tail
        if "@" not in x.group() and not _BRACKET.search(x.group()) and not (any(text[a:b] != "." for a, b in after) and text[top:end].lower() in TOP_LABELS):
            continue
        edits += [(a, b, new) for a, b, new in [*((a, b, ".") for a, b in reversed(dots[1:])), (lo, hi, "@"), *((a, b, ".") for a, b in after)] if text[a:b] != new]
        done = end
    return edits


def _name_before(text: str, end: int, least: int) -> list[tuple[int, int]]:
    """[(start of the name,) * 2, then the spans of its dots from right to left]; empty if no label ends at ``end``."""
    dots: list[tuple[int, int]] = []
    at = end
    start = -1
    while True:
        lo = at
        while lo > least and text[lo - 1] in _LABEL_CHARS:
            lo -= 1
        if lo == at or text[lo] in "_+-":
            break
        start = lo
        if not (dot := _DOT_BEFORE.search(text, max(least, lo - _DOT_WIDTH), lo)):
            break
        dots.append(dot.span())
        at = dot.start()
    if start < 0:
        return []
    return [(start, start), *(d for d in dots if d[0] >= start)]


def _host_after(text: str, at: int) -> tuple[list[tuple[int, int]], int, int] | None:
    """(spans of the dots, end of the host, start of its last label), or nothing if no host begins at ``at``."""
    dots: list[tuple[int, int]] = []
    best = None
    while at < len(text) and text[at] in _LABEL_CHARS and text[at] not in "_+-":
        if dots and (top := _TOP.match(text, at)):
            best = (len(dots), top.end(), at)
        while at < len(text) and text[at] in _LABEL_CHARS:
            at += 1
        if not (dot := _DOT_RE.match(text, at)):
            break
        dots.append(dot.span())
        at = dot.end()
    return best and (dots[: best[0]], best[1], best[2])


def _luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0 and len(set(digits)) > 1


def _secret(value: str) -> bool:
    """Whether a value after a secret's name is one: it holds a digit, an inner capital or an inner sign, as no common word does."""
    core = value.strip(".,;:!?()[]{}<>$%&#*")
    return len(core) >= 6 and (any(c.isdigit() for c in core) or any(c.isupper() for c in core[1:]) and not core.isupper() or any(not c.isalnum() and c not in "-'’" for c in core))


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def identifiers(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value), by source characters; overlaps are settled by the order of PATTERNS."""
    if not text:
        return []
    m = deobfuscate(text)
    t = m.text
    low = t.lower()
    secret = any(w in low for w in _SECRET_WORDS)
    if not secret and not _TRIGGER.search(t):
        return []
    has_at, has_digit = "@" in t, _DIGITS.search(t)
    found: list[tuple[int, int, str, str]] = []
    for i, (kind, p) in enumerate(PATTERNS):
        if (kind == "SECRET" and not secret) or (kind == "EMAIL" and not has_at) or (kind not in ("EMAIL", "SECRET") and not has_digit):
            continue
        for x in p.finditer(t):
            lo, hi = x.span(1) if p.groups and kind in ("SECRET", "PHONE") else x.span()
            if kind == "IBAN" and not _iban(x.group()) or kind == "CARD" and not _luhn(x.group()) or kind == "SECRET" and p.groups and not _secret(x.group(1)):
                continue
            if kind == "IP" and (_VERSION.search(t, max(0, lo - 12), lo) or ":" in x.group() and len(re.sub(r"[^0-9A-Fa-f]", "", x.group())) < 3):
                continue  # "version 1.2.3.4", "a::b"
            if kind == "PHONE" and len(set(_DIGITS.findall(t, lo, hi))) == 1 or p is _SPACED and t[lo:hi] == text[slice(*m.source(lo, hi))]:
                continue  # one digit over and over; single digits are a number only if they were spelled or disguised
            k = bisect.bisect_left(found, (lo,))
            if (k and found[k - 1][1] > lo) or (k < len(found) and found[k][0] < hi):
                continue
            found.insert(k, (lo, hi, kind, t[lo:hi]))
    return [(kind, *m.source(lo, hi), value) for lo, hi, kind, value in found]


def mask(text: str) -> str:
    """The text with each identifier replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, lo, hi, _ in identifiers(text):
        out += [text[at:lo], f"<{kind}>"]
        at = hi
    return text if not out else "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value): one row for each identifier, by characters of the source text.

    ``value`` is the identifier as it reads after deobfuscation. Null and empty texts have none. A
    null doc_id is reported as null; equal rows are reported as often as they occur. Other columns
    are ignored.
    """

    def run(batches):
        for b in batches:
            rows = [(i, *x) for i, t in enumerate(b.column(1).to_pylist()) for x in identifiers(t)]
            if rows:
                at, kind, lo, hi, value = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(kind), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(value)], ["doc_id", "kind", "start", "end", "value"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return src.mapInArrow(run, "doc_id long, kind string, start int, end int, value string")


def masked(column: str = "text") -> Column:
    """The column with identifiers masked; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        give_back()
        return pa.array((t if t is None else mask(t) for t in (x.as_py() for x in texts)), pa.string(), size=len(texts))

    return F.arrow_udf(run, "string")(F.col(column))


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with identifiers in text masked; every row and column stays, and n_chars, if there, follows.

    A null text stays null and an empty one empty; repeated rows and rows of a null doc_id are masked
    like any other; an empty table stays empty.
    """
    out = docs.withColumn("text", masked())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_pii`` of all documents; its cases are stated there."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
