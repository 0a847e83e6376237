"""Byte-level BPE through a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventmill.llm.common import with_fields
from eventmill.session import bound_batches

#: Pre-tokens kept with their ids in each worker; longer ones than LONG_TOKEN are not kept. More are encoded anew.
KEPT_TOKENS, LONG_TOKEN = 400_000, 64
#: Tokens handled at a time, so that a very long text needs no more than its ids.
TOKENS_AT_ONCE = 200_000


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens[i] for i in range(len(tokens))]


def byte_characters() -> list[str]:
    """A visible character for every byte: itself where it is visible in Latin-1, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    place = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [place[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | float | int) -> bytes:
    """A protocol buffer field: numbers as varint, floats as four bytes, the rest with its length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model of type BPE whose ids are the ranks.

    Pieces are the tokens in byte characters, scored by negative rank, so that the merge of the lowest rank comes first.
    The normaliser changes nothing. The unknown piece, which every model must have, follows the last rank.
    """
    characters = byte_characters()
    # Field numbers of the public model format: 1 pieces (1 piece, 2 score, 3 type), 2 trainer, 3 normaliser.
    pieces = [
        _field(1, _field(1, "".join(characters[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    # Trainer: 3 model type (2 is BPE), 4 vocabulary size, 40 to 43 ids of unknown, begin, end, padding (-1 is none).
    none = 2**64 - 1
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, none) for n in (41, 42, 43))
    # Normaliser: 1 name, 3 add a dummy prefix, 4 remove extra white space, 5 escape white space.
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes pre-tokens with the model, remembers frequent ones, and decodes by the inverse mapping."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.characters = dict(enumerate(byte_characters()))
        self.kept: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> None:
        mapped = [t.encode().decode("latin-1").translate(self.characters) for t in tokens]
        for token, ids in zip(tokens, self.pieces.encode(mapped, num_threads=1), strict=True):
            self.kept[token] = struct.pack(f"<{len(ids)}i", *ids)

    def _ids(self, tokens: list[str], ends: list[int]) -> list[bytes]:
        """Ids of the tokens up to each end. Each distinct token is looked up once in the large table."""
        distinct = set(tokens)
        if unknown := distinct.difference(self.kept):
            self._learn(list(unknown))
        near = dict(zip(distinct, map(self.kept.__getitem__, distinct), strict=True))
        if len(self.kept) > KEPT_TOKENS:
            self.kept.clear()
        for token in unknown:
            if len(token) > LONG_TOKEN:
                self.kept.pop(token, None)
        return [b"".join(map(near.__getitem__, tokens[start:end])) for start, end in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, four bytes each. Texts are taken together up to a number of tokens."""
        tokens: list[str] = []
        ends: list[int] = []
        for text in texts:
            if len(text) > TOKENS_AT_ONCE:
                yield from self._ids(tokens, ends)
                tokens, ends = [], []
                matches, parts = (m.group() for m in self.pattern.finditer(text)), []
                while some := list(islice(matches, TOKENS_AT_ONCE)):
                    parts += self._ids(some, [len(some)])
                yield b"".join(parts)
                continue
            tokens += self.pattern.findall(text)
            ends.append(len(tokens))
            if len(tokens) > TOKENS_AT_ONCE // 4:
                yield from self._ids(tokens, ends)
                tokens, ends = [], []
        yield from self._ids(tokens, ends)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_all([text])), "<i4").tolist()


class Decoder:
    """The inverse mapping: the bytes of all tokens in one array, and where each begins."""

    def __init__(self, tokens: Sequence[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of the ids up to each end. A bounded number of tokens is gathered at a time."""
        sizes, parts = self.sizes[ids], []
        for at in range(0, len(ids), TOKENS_AT_ONCE):
            own, size = ids[at : at + TOKENS_AT_ONCE], sizes[at : at + TOKENS_AT_ONCE]
            before = np.cumsum(size) - size
            parts.append(self.flat[np.repeat(self.starts[own] - before, size) + np.arange(size.sum())])
        # bytes behind each number of tokens
        offsets = np.concatenate([[0], np.cumsum(sizes)])[ends].astype("<i8")
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _mapped(df: DataFrame, kinds: dict[str, T.DataType], source: str, function: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Add columns made from another in Arrow batches."""
    bound_batches(df.sparkSession)
    schema = with_fields(df.schema, *[T.StructField(name, kind) for name, kind in kinds.items()])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = function()
        for batch in chain.from_iterable(map(_slices, batches)):
            made = dict(zip(kinds, convert(batch.column(source)), strict=True))
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return df.mapInArrow(run, schema)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, column: str = "text", decoded: str | None = None) -> DataFrame:
    """Add `token_ids` of the whole text, as ranks of the file at `ranks_path` on the driver.

    Each match of `pattern` is encoded by itself, without special tokens. With `decoded`, a column of that name holds the
    bytes that the ids stand for, made in the same pass. NULL counts as the empty text and has no ids. An empty table gives
    an empty table; repeated rows get equal ids; very long texts are taken a bounded number of tokens at a time; extra
    columns stay, those of the names of the new ones are replaced. The model has the size of the vocabulary; it goes to the
    workers as a broadcast of that size.
    """
    tokens = read_ranks(ranks_path)
    model = df.sparkSession.sparkContext.broadcast((sentencepiece_model(tokens), tokens if decoded else []))

    def function():
        codec, decoder = _codec(model.value[0], pattern), Decoder(model.value[1])

        def convert(texts: pa.Array) -> list[pa.Array]:
            parts = list(codec.encode_all(t or "" for t in texts.to_pylist()))
            ends = np.cumsum([0, *[len(p) // 4 for p in parts]], dtype="i4")
            ids = np.frombuffer(b"".join(parts), "<i4")
            made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
            return [*made, decoder.decode_all(ids, ends)] if decoded else made

        return convert

    kinds = {"token_ids": T.ArrayType(T.IntegerType())} | ({decoded: T.BinaryType()} if decoded else {})
    return _mapped(df, kinds, column, function)


def decode_ids(df: DataFrame, ranks_path: str, column: str = "token_ids") -> DataFrame:
    """Add `decoded`: the bytes of the tokens. NULL gives no bytes.

    An empty table gives an empty table; extra columns stay, one named `decoded` is replaced.
    """
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def function():
        decoder = Decoder(tokens.value)

        def convert(ids: pa.Array) -> list[pa.Array]:
            offsets = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            return [decoder.decode_all(flat, offsets - offsets[0])]

        return convert

    return _mapped(df, {"decoded": T.BinaryType()}, column, function)
