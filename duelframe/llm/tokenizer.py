"""Corpus encoding with a byte-level BPE vocabulary, run by a sentencepiece model serialised from that vocabulary.

Each vocabulary entry becomes a model piece at its own id, written in the byte alphabet (one printable character for each
byte) and scored by its negative rank, so that sentencepiece's best-score-first merging is the vocabulary's
lowest-rank-first merging. Texts are cut into pre-tokens by the vocabulary's pattern; a pre-token's UTF-8 bytes are mapped
into the byte alphabet, encoded, and decoded again by the inverse mapping.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files lie; a parameter of every function that reads one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers; the memory is dropped when full, which changes nothing but speed.
REMEMBERED = 300_000


def byte_alphabet() -> str:
    """The character of each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(free)) for b in range(256))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, float32 or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(vocabulary: str = VOCABULARY) -> bytes:
    """A serialised sentencepiece BPE model with the vocabulary's own ids.

    Message fields used: ModelProto.pieces 1, trainer_spec 2, normalizer_spec 3; SentencePiece.piece 1, score 2, type 3
    (normal 1, unknown 2); TrainerSpec.model_type 3 (BPE 2), unk/bos/eos/pad ids 40 to 43; NormalizerSpec.name 1,
    add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5.
    """
    vocab = json.loads(open(vocabulary, encoding="utf-8").read())["model"]["vocab"]
    pieces = sorted(vocab.items(), key=lambda x: x[1])
    if [i for _, i in pieces] != list(range(len(pieces))):
        raise ValueError("the vocabulary's ids have gaps")
    missing = set(byte_alphabet()) - vocab.keys()
    if missing:
        raise ValueError("the vocabulary lacks single bytes")
    out = [_field(1, _field(1, p.encode()) + _field(2, -float(i)) + _field(3, 1)) for p, i in pieces]
    unknown = len(pieces)  # never produced: every byte is a piece
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    out.append(_field(2, _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, -1) + _field(42, -1) + _field(43, -1)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Encoder:
    """Encodes and decodes whole texts; remembers the ids of pre-tokens as packed int32."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self._cut = regex.compile(PATTERN).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._to = {i: c for i, c in enumerate(byte_alphabet())}
        self._from = {ord(c): i for i, c in enumerate(byte_alphabet())}
        self._known: dict[str, bytes] = {}

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian int32; none for empty and null texts."""
        if len(self._known) > REMEMBERED:
            self._known = {}
        cut = [self._cut(t) if t else [] for t in texts]
        new = list(set().union(*cut) - self._known.keys())
        mapped = [t.encode().decode("latin-1").translate(self._to) for t in new]
        for token, ids in zip(new, self._model.encode(mapped, num_threads=1) if mapped else []):
            self._known[token] = struct.pack(f"<{len(ids)}i", *ids)
        get = self._known.__getitem__
        return [b"".join(map(get, tokens)) for tokens in cut]

    def decode(self, ids: list[int]) -> str:
        text = "".join(self._model.id_to_piece([int(i) for i in ids]))
        return text.translate(self._from).encode("latin-1").decode("utf-8", errors="replace")


#: Most repeated keys that are broadcast (8 bytes each); with more, both sides are shuffled.
BROADCAST_KEYS = 1_000_000
#: Texts encoded together; bounds the memory for a batch's pre-tokens.
TOGETHER = 256


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, distinct: bool = True) -> DataFrame:
    """``key`` and ``ids`` (list of int, no special tokens) of each row, whole texts in one pass without a text shuffle.

    Empty and null texts give an empty list; strings of special tokens are ordinary text. With ``distinct`` repeated rows
    of a key count once: only keys that do occur more than once, found by a scan of the key column, pass a shuffle.
    Columns other than the two named are ignored; a null key is a key like any other. An empty table gives no rows.
    """
    model = model_bytes(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(model)  # one vocabulary file, about 1 MB at any corpus size
    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                packed = encoder.packed(part.column(1).to_pylist())
                ends = [0]
                for p in packed:
                    ends.append(ends[-1] + len(p) // 4)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    rows = df.select(key, text)
    if not distinct:
        return rows.mapInArrow(encode, schema)
    repeated = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("__k"))
    if repeated.count() <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)  # so that no text is shuffled for it
    seen = F.col(key).eqNullSafe(F.col("__k"))
    once = rows.join(repeated, seen, "left_anti")
    more = rows.join(repeated, seen, "left_semi").dropDuplicates([key])
    return once.unionByName(more).mapInArrow(encode, schema)
