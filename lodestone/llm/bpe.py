"""Byte-level BPE by a sentencepiece model that is written directly from the vocabulary.

A vocabulary file of ranks becomes a sentencepiece BPE model without any training: each byte string
is spelled with one printable character a byte, its score is the negative rank, so that the merge of
lowest rank wins, and the normaliser is the identity. Texts are cut into pre-tokens by the usual
pattern, each distinct pre-token is encoded once a batch, and ids are decoded by the inverse mapping
from id to bytes.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import utf8

#: Where the vocabulary lies, unless another path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that was published with that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Distinct pre-tokens that a worker remembers before it starts afresh; the result doesn't depend on it.
REMEMBERED = 1_000_000


def byte_characters() -> list[str]:
    """For each byte a printable character that is no white space."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Byte strings in the order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    out = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in out] != list(range(len(out))):
        raise ValueError(f"{path}: the ranks have gaps")
    if missing := 256 - sum(len(x) == 1 for x in out):
        raise ValueError(f"{path}: {missing} single bytes are missing")
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(vocabulary: list[bytes]) -> bytes:
    """The serialised model: a piece for each entry, then one for what is unknown, which never occurs."""
    chars = byte_characters()
    out = []
    for rank, entry in enumerate(vocabulary):
        piece = _field(1, "".join(chars[b] for b in entry).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _field(3, 1)
        out.append(_field(1, piece))
    out.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", -len(vocabulary)) + _field(3, 2)))
    absent = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary)) + b"".join(_field(n, absent) for n in (41, 42, 43))
    identity = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(out) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encoder and decoder of batches of texts."""

    def __init__(self, model: bytes, vocabulary: list[bytes]):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.chars = byte_characters()
        self.bytes_ = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.offs = np.r_[0, np.cumsum([len(x) for x in vocabulary])]
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        spelled = ["".join(map(self.chars.__getitem__, t.encode())) for t in new]
        ids = self.model.encode(spelled, num_threads=1)
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.ids = np.r_[self.ids, np.fromiter((i for x in ids for i in x), np.int32)]
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets by text; a null text has none."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        split = [self.split(t) if t else [] for t in texts]
        if new := list(dict.fromkeys(t for ts in split for t in ts if t not in self.numbers)):
            self._learn(new)
        at = np.fromiter((n for ts in split for n in map(self.numbers.__getitem__, ts)), np.int64)
        size = self.ends[at + 1] - self.ends[at]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids = self.ids[np.repeat(self.ends[at], size) + place]
        per_text = np.cumsum(np.r_[0, size])[np.cumsum([0, *map(len, split)])]
        return ids, per_text

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets by text; ids must be of the vocabulary."""
        size = self.offs[ids + 1] - self.offs[ids]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.bytes_[np.repeat(self.offs[ids], size) + place], np.cumsum(np.r_[0, size])[offs]


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """This worker's codec for a broadcast (model, vocabulary)."""
    if shared.value[2] not in _codecs:
        _codecs.clear()
        _codecs[shared.value[2]] = Codec(*shared.value[:2])
    return _codecs[shared.value[2]]


def _share(spark: SparkSession, path: str):
    vocabulary = read_vocabulary(path)
    model = model_proto(vocabulary)
    return spark.sparkContext.broadcast((model, vocabulary, hash((path, model))))


def _slices(texts: pa.Array, most: int = 1 << 20):
    """(first, last + 1) of runs of whole texts of about ``most`` bytes."""
    offs, at = utf8(texts)[1], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield at, end
        at = end


def encoded(spark: SparkSession, column: str = "text", path: str = VOCABULARY) -> Column:
    """ARRAY<INT> of ids of a text column; null for null, no ids for an empty text."""
    shared = _share(spark, path)

    def run(texts: pa.Array) -> pa.Array:
        codec, parts, cuts = _codec(shared), [], [np.zeros(1, np.int64)]
        for lo, hi in _slices(texts):
            ids, offs = codec.encode(texts.slice(lo, hi - lo).to_pylist())
            parts.append(ids)
            cuts.append(offs[1:] + cuts[-1][-1])
        none = pa.array(texts.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(cuts), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])), mask=none if texts.null_count else None)

    return F.arrow_udf(run, "array<int>")(F.col(column).cast("string"))


def decoded(spark: SparkSession, column: str = "ids", path: str = VOCABULARY) -> Column:
    """The text of a column of ids; null for null. Bytes that are no UTF-8 become U+FFFD; an id out of the vocabulary is an error."""
    shared = _share(spark, path)

    def run(lists: pa.Array) -> pa.Array:
        codec = _codec(shared)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(codec.offs) - 1):
            raise ValueError("an id is not in the vocabulary")
        size = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
        data, offs = codec.decode(ids, np.cumsum(np.r_[0, size]))
        raw = data.tobytes()
        none = lists.is_null().to_pylist()
        return pa.array([None if none[i] else raw[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in range(len(lists))], pa.string())

    return F.arrow_udf(run, "string")(F.col(column))


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row: the ids, and whether decoding them gives the text again.

    An empty text has no ids; a null text has null for all three. Rows with a null or repeated doc_id
    are encoded like any other. Other columns are ignored.
    """
    shared = _share(docs.sparkSession, path)

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            for lo, hi in _slices(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo)
                ids, offs = codec.encode(texts.to_pylist())
                back, cut = codec.decode(ids.astype(np.int64), offs)
                data, want = utf8(texts)
                if len(back) == len(data) and (cut == want).all():
                    wrong = np.searchsorted(want, np.flatnonzero(back != data), side="right") - 1
                    same = np.ones(hi - lo, bool)
                    same[wrong] = False
                else:
                    same = np.array([back[cut[i] : cut[i + 1]].tobytes() == data[want[i] : want[i + 1]].tobytes() for i in range(hi - lo)], bool)
                none = texts.is_null().to_numpy(zero_copy_only=False)
                mask = pa.array(none) if none.any() else None
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids), mask=mask)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), lists, pa.array(np.diff(offs).astype(np.int32), mask=none), pa.array(same, mask=none)],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_documents`` of all documents, with the defaults; its cases are stated there."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
