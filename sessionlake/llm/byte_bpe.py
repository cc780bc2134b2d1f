"""Byte-level BPE through a sentencepiece model that is written straight from a file of ranks.

The vocabulary's tokens are byte strings; each byte becomes one printable letter, so that every token is a piece of text.
The model is serialised here piece by piece: the score of a piece is its negative rank, so that the best-scored merge of
neighbours is the one of least rank, and text is not normalised. Piece numbers are ranks; the unknown piece that the
format asks for comes last and never occurs, as every byte is a piece. A text is cut into pre-tokens by the pattern, each
is encoded for itself, and ids are decoded by the inverse mapping of letters to bytes.

A rank file may hold tokens that no order of merges reaches; a pre-token that is such a token is that token, as for the
rank file's own library. Pre-tokens that repeat are remembered in a cache of bounded size. Ids leave a text in chunks
that go on to the digests, so beside the text nothing grows with it, but for ids where they are asked for and for one
pre-token at a time: a pre-token of a million letters takes some hundred MB in its task.

Null and empty texts have no tokens. Bytes that are no UTF-8 become U+FFFD before anything else. Repeated rows are encoded
one by one, ties do not arise, null keys stay null, and an empty table gives an empty table with the same columns. Only
the key and ``text`` are read, so extra columns of any name do not matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator
from operator import methodcaller

import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import binary_text, lean, tidy

#: Numbers of the model file's format: kinds of piece, the kind of model.
NORMAL, UNKNOWN, BPE = 1, 2, 2
#: Texts of more letters are cut lazily; so many pre-tokens leave at once; so many are remembered.
LONG, CHUNK, REMEMBERED = 1 << 16, 4096, 500_000


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of the model file: a varint, a float or bytes."""
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    return _number(number << 3) + _number(value)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model of a vocabulary whose ranks run from 0 without a gap."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")
    if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {lacking}")
    if len(tokens) >= 1 << 24:
        raise ValueError("scores are single floats: at most 2^24 tokens")
    letters = byte_letters()
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    pieces = [piece("".join(map(letters.__getitem__, t)), -float(k), NORMAL) for k, t in enumerate(tokens)]
    trainer = _field(3, BPE) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    as_it_is = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*pieces, piece("⁇ unknown", 0.0, UNKNOWN), _field(2, trainer), _field(3, as_it_is)])


def _ranges(points: list[int]) -> str:
    """A regex class's inside for sorted code points."""
    out, k = [], 0
    while k < len(points):
        j = k
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[k]:08x}-\\U{points[j]:08x}")
        k = j + 1
    return "".join(out)


@functools.lru_cache(1)
def newer_characters() -> dict[str, str]:
    """For letters and numbers, the characters (as a class's inside) that are such here but not yet in the rank file's
    library, whose Unicode tables are older; it is asked itself."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for kind in (r"\p{L}", r"\p{N}"):
        here = "".join(regex.findall(kind, every))
        asked = tiktoken.Encoding("asked", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        there = set(asked.decode_bytes(asked.encode_ordinary(here)).decode())
        out[kind] = _ranges([ord(c) for c in here if c not in there])
    return out


def exact_pattern(pattern: str) -> str:
    """The pattern with ``\\p{L}`` and ``\\p{N}`` as the rank file's library has them."""
    for kind, newer in newer_characters().items():
        if newer:
            older = f"[{kind}--[{newer}]]"
            # inside a negated class the newer characters are members again, outside the older set stands for the kind
            pattern = pattern.replace(kind, older)
    return "(?V1)" + pattern


#: Characters of scripts whose letters and numbers all Unicode tables agree on, as a class's inside.
SETTLED = "\x00-\u024F\u0370-\u0373\u0400-\u052F\u2000-\u206F\u20AC\u3041-\u3096\u4E00-\u9FEF\uAC00-\uD7A3"


@functools.lru_cache(4)
def settled_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of settled characters, its classes spelled out as ranges for the faster standard library."""
    every = "".join(filter(re.compile(f"[{SETTLED}]").match, map(chr, range(0xD7A4))))
    spelled = {kind: _ranges(sorted(map(ord, regex.findall(kind, every)))) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern):
        if part == r"\S" and not inside:
            out.append(f"[^{spelled[chr(92) + 's']}]")
        elif part in spelled:
            out.append(spelled[part] if inside else f"[{spelled[part]}]")
        elif part[0] == "\\" and part[1].isalpha():
            return None  # a class that is not spelled out here
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return re.compile("".join(out))


class Remembered(dict):
    """Pre-tokens and their ids; those of up to 64 letters are remembered, up to a bound in number."""

    def __init__(self, library, whole: dict[str, tuple[int, ...]]):
        super().__init__()
        self.library, self.whole = library, whole
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, word: str) -> tuple[int, ...]:
        piece = word.encode().decode("latin-1").translate(self.letters)
        ids = self.whole.get(piece) or tuple(self.library.encode(piece))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes with a serialised model; one for each Python worker."""

    def __init__(self, model: bytes, pattern: str, exact: str):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte = {c: b for b, c in enumerate(byte_letters())}
        pieces = [library.id_to_piece(k) for k in range(library.get_piece_size() - 1)]
        self.data = [bytes(map(byte.__getitem__, p)) for p in pieces]
        #: tokens that no merges reach
        self.whole = {p: (k,) for k, (p, ids) in enumerate(zip(pieces, library.encode(pieces, num_threads=1))) if ids != [k]}
        self.known = Remembered(library, self.whole)
        self.settled, self.quick, self.exact = re.compile(f"[{SETTLED}]*"), settled_pattern(pattern), exact
        self.digits = list(map(str, range(len(pieces))))

    @functools.cached_property
    def exact_split(self) -> regex.Pattern:
        return regex.compile(self.exact)

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        split = self.quick if self.quick and (text.isascii() or self.settled.fullmatch(text)) else self.exact_split
        if len(text) <= LONG:
            yield split.findall(text)
            return
        found = map(methodcaller("group"), split.finditer(text))
        while some := list(itertools.islice(found, CHUNK)):
            yield some

    def ids(self, words: list[str]) -> list[int]:
        """The ids of pre-tokens one after the other."""
        return list(itertools.chain.from_iterable(map(self.known.__getitem__, words)))

    def chunks(self, text: str) -> Iterator[list[int]]:
        for words in self.pre_tokens(text):
            if words:
                yield self.ids(words)

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in chunk]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; those that the vocabulary lacks are an error."""
        return b"".join(map(self.data.__getitem__, ids))

    def digest(self, text: str, ids: list[int] | None = None) -> tuple[int, str, str]:
        """Count of ids, SHA-256 of them joined by blanks, SHA-256 of the bytes they decode to; ids are added to the list."""
        n, told, back = 0, hashlib.sha256(), hashlib.sha256()
        for chunk in self.chunks(text):
            told.update(((" " if n else "") + " ".join(map(self.digits.__getitem__, chunk))).encode())
            back.update(self.decode(chunk))
            n += len(chunk)
            if ids is not None:
                ids += chunk
        return n, told.hexdigest(), back.hexdigest()


@functools.lru_cache(1)
def codec_of(model: bytes, pattern: str, exact: str) -> Codec:
    return Codec(model, pattern, exact)


def _sent(rows: DataFrame, path: str, pattern: str):
    """What workers build their codec of, broadcast: its size is the vocabulary's, which the file fixes."""
    return rows.sparkSession.sparkContext.broadcast((model_of(read_ranks(path)), pattern, exact_pattern(pattern)))


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The key, ``n_tokens, ids_sha256, decoded_sha256`` and, where asked for, ``ids`` (array of int)."""
    fields = [docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    sent = _sent(docs, path, pattern)

    def encode(batches):
        codec = codec_of(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, ids = [], []
                for text in batch.column(1):
                    ids.append([])
                    rows.append(codec.digest(text.as_py().decode("utf-8", "replace") if text.is_valid else "", ids[-1] if with_ids else None))
                n, told, back = zip(*rows)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, [f.name for f in fields])

    return lean(docs).select(key, binary_text()).mapInArrow(tidy(encode), T.StructType(fields))


def decode_ids(rows: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the decoded bytes of a column of ids; null ids give null. A column of that name is replaced."""
    rows = rows.drop(into)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.BinaryType())])
    at = rows.columns.index(ids)
    sent = _sent(rows, path, pattern)

    def decode(batches):
        codec = codec_of(*sent.value)
        for batch in batches:
            data = [None if x is None else codec.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], schema.names)

    return rows.mapInArrow(tidy(decode), schema)
