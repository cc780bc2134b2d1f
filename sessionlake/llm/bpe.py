"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The lookahead is computed from the merge list: what stands further right than it can no longer change a token boundary.
A word longer than a buffer is encoded piece by piece: the tokens that end before the last ``lookahead`` symbols are
emitted and forgotten, so memory stays constant however long a word is. Shorter words are encoded in one buffer and
remembered in a cache bounded in bytes. A text is read in segments cut at blanks, its ids leave in chunks, and each chunk
goes on to the digest of the ids and to the decoder, so nothing of a text's length is held beside the text (and its ids,
where they are asked for). The decoder is a state machine from ids to text that keeps what it cannot tell yet between
chunks: whether a token came before, or an unfinished UTF-8 sequence, as the tokenizer's own decoder asks for.

Of the text side the split pattern and the special tokens, which are cut out first, are read from the tokenizer's file; the
file's path is a parameter. Normalisation (NFC, white space to blanks, lower case letter by letter) and the kind of split
(matches, as byte letters) are fixed: a file that asks for others is refused with what it asks for. Null texts are empty texts: no
tokens. Repeated rows are encoded one by one; an empty table gives an empty table. Only the key and ``text`` are read, so
extra columns of any name do not matter.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import binary_text, lean, tidy


NEVER = 1 << 30
#: Letters of a text read at once, and ids that leave at once.
SEGMENT, CHUNK = 1 << 16, 4096


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones stand for themselves, the others for U+0100 onwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Merges:
    """The vocabulary and ranked merges of a tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.token = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.decoder: str | None = (told["decoder"] or {}).get("type")
        patterns = [p["pattern"]["Regex"] for p in told["pre_tokenizer"].get("pretokenizers", []) if "pattern" in p]
        self.split = regex.compile(patterns[0]) if patterns else None
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Symbols to the right that can influence whether a boundary stays.

        A merge (a, b) can be disturbed only by an earlier-ranked merge (x, y) whose x ends where b ends; that one in
        turn by a still earlier one at the end of y. Ranks fall along such a chain, so a pass in rank order finds the
        longest reach of each merge, and the longest reach over all tokens bounds the lookahead.
        """
        right = {a + b: b for a, b in self.rank}
        reach: dict[str, int] = {}

        def spine(t: str) -> Iterator[str]:
            while t:
                yield t
                t = right.get(t, "")

        width = lambda t: len(t.removesuffix(self.end)) if self.end else len(t)
        longest = 1
        for a, b in self.rank:
            beyond = max((reach.get(x, 0) for x in spine(b)), default=0)
            reach[a] = max(reach.get(a, 0), width(b) + beyond)
            longest = max(longest, width(a + b))
        return longest + max((max(reach.get(x, 0) for x in spine(t)) for t in (*reach, *right)), default=0)

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges applied, the lowest rank first and from the left among equals."""
        n = len(symbols)
        if n < 32:
            part, rank = list(symbols), self.rank.get
            ranks = [rank(pair, NEVER) for pair in zip(part, part[1:])]
            while ranks and (least := min(ranks)) != NEVER:
                i = ranks.index(least)
                part[i] += part[i + 1]
                del part[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank((part[i - 1], part[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = rank((part[i], part[i + 1]), NEVER)
            return part
        part: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        queue = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(queue, (r, i, part[i], part[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(queue, (r, h, part[h], part[i]))
        return [p for p in part if p is not None]


class Transducer:
    """Encodes words fed as letters; keeps at most a buffer of a few lookaheads."""

    def __init__(self, merges: Merges, cached_bytes: int = 24 << 20):
        self.m, self.letters = merges, byte_letters()
        self.buffer = 4 * merges.lookahead + 64
        self.room = self.cached_bytes = cached_bytes
        self.cache: dict[str, tuple[int, ...]] = {}

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, each emitted once nothing further right can change it."""
        held: list[str] = []
        for s in symbols:
            held.append(s)
            if len(held) > self.buffer:
                # the last letter is not the word's end yet, so it carries no end mark here
                kept, used = [], 0
                for t in self.m.merged(held):
                    if used + len(t) > len(held) - self.m.lookahead:
                        break
                    kept.append(t)
                    used += len(t)
                yield from kept
                held = held[used:]
        if held:
            held[-1] += self.m.end
            yield from self.m.merged(held)

    def word(self, word: str) -> Iterable[int]:
        """The ids of one word."""
        got = self.cache.get(word)
        if got is None:
            plain = word.isascii() and word.isprintable()
            if len(word) * 4 > self.buffer and (plain and len(word) or len(word.encode())) >= self.buffer:
                letters = iter(word) if plain else (self.letters[b] for c in word for b in c.encode())
                return (self.m.ids[t] for t in self.stream(letters))
            symbols = list(word) if plain else [self.letters[b] for b in word.encode()]
            symbols[-1] += self.m.end
            got = tuple([self.m.ids[t] for t in self.m.merged(symbols)])
            if len(word) <= 64:
                self.room -= 200 + 8 * len(got) + len(word)
                if self.room < 0:
                    self.forget()
                self.cache[word] = got
        return got

    def forget(self) -> None:
        self.cache.clear()
        self.room = self.cached_bytes


#: Fixed: steps of normalisation and splitting that encoding follows.
NORMALIZED, SPLIT = ("NFC", "Replace", "Lowercase"), ("Split", "ByteLevel")


def _steps(told: dict | None, inner: str) -> tuple[str, ...]:
    """Types of a normalizer's or pre-tokenizer's steps, in order."""
    return tuple(s["type"] for s in (told or {}).get(inner, [told] if told else []))


def check_rules(path: str) -> None:
    """ValueError unless the file's rules for texts are those that the encoder follows."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    asked = _steps(told["normalizer"], "normalizers"), _steps(told["pre_tokenizer"], "pretokenizers")
    if asked != (NORMALIZED, SPLIT):
        raise ValueError(f"{path}: texts are normalized by {asked[0]} and split by {asked[1]}; only {NORMALIZED} and {SPLIT} are encoded")
    replace, split = told["normalizer"]["normalizers"][1], told["pre_tokenizer"]["pretokenizers"][0]
    if replace["pattern"] != {"Regex": r"\s+"} or replace["content"] != " " or not split["invert"] or split["behavior"] != "Removed":
        raise ValueError(f"{path}: white space is replaced by {replace}, words are split by {split}")


class Encoder:
    def __init__(self, path: str):
        self.path, self.m = path, Merges(path)
        self.t = Transducer(self.m)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.m.special)) + ")") if self.m.special else None
        self.plain = regex.compile("[\x00-\u024F\u0370-\u0373\u0400-\u052F\u2000-\u206F\u20AC\u3041-\u3096\u4E00-\u9FEF\uAC00-\uD7A3]*")
        self.digits = {i: str(i) for i in self.m.token}

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def byte(self) -> dict[str, bytes]:
        return {c: bytes([b]) for b, c in enumerate(byte_letters())}

    def pieces(self, part: str) -> list[str]:
        """Normalized words. Where versions of Unicode may differ, the library's own normalizer and split are asked."""
        if part.isascii():
            return self.m.split.findall(part.lower())
        if self.plain.fullmatch(part) and "\u0130" not in part:
            return self.m.split.findall(unicodedata.normalize("NFC", part).lower())
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [b"".join([self.byte[c] for c in word]).decode() for word, _ in split]

    @staticmethod
    def segments(text: str) -> Iterator[str]:
        """The text cut before blanks: none of normalization, special tokens and words reaches across one."""
        first = 0
        while len(text) - first > SEGMENT:
            cut = text.rfind(" ", first + 1, first + SEGMENT)
            if cut < 0:
                cut = text.find(" ", first + SEGMENT)
                if cut < 0:
                    break
            yield text[first:cut]
            first = cut
        yield text[first:] if first else text

    def chunks(self, text: str) -> Iterator[list[int]]:
        """The ids of the text, some CHUNK at a time."""
        held: list[int] = []
        for segment in self.segments(text):
            for part in self.cut.split(segment) if self.cut and "<|" in segment else (segment,):
                if part in self.m.special:
                    held.append(self.m.special[part])
                elif part:
                    for word in self.pieces(part):
                        ids = self.t.word(word)
                        if type(ids) is tuple:
                            held += ids
                        else:  # a very long word streams
                            for i in ids:
                                held.append(i)
                                if len(held) >= CHUNK:
                                    yield held
                                    held = []
                        if len(held) >= CHUNK:
                            yield held
                            held = []
        if held:
            yield held

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in chunk]

    def digest(self, text: str, decoder: "Decoder", ids: list[int] | None = None) -> tuple[int, str, str]:
        """Count of ids, SHA-256 of them joined by blanks, SHA-256 of their decoded text; ids are added to the list."""
        n, told, back, of = 0, hashlib.sha256(), hashlib.sha256(), self.digits.__getitem__
        decoder.reset()
        for chunk in self.chunks(text):
            told.update(((" " if n else "") + " ".join(map(of, chunk))).encode())
            back.update(decoder.feed(chunk).encode())
            n += len(chunk)
            if ids is not None:
                ids += chunk
        back.update(decoder.close().encode())
        return n, told.hexdigest(), back.hexdigest()


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


class Decoder:
    """From ids to text, chunk by chunk, by the decoder that the tokenizer's file names.

    Without one, the tokens as they are written are joined by blanks; the state is whether one came before. The
    byte-level one turns the letters of tokens into bytes and these into text; the state is an unfinished UTF-8 sequence,
    and bytes that are none become U+FFFD. Special tokens stand for themselves. Ids that the tokenizer lacks are skipped.
    """

    def __init__(self, merges: Merges):
        if merges.decoder not in (None, "ByteLevel"):
            raise ValueError(f"no decoder for {merges.decoder}")
        self.token, self.of_bytes = merges.token, merges.decoder == "ByteLevel"
        if self.of_bytes:
            byte = {c: b for b, c in enumerate(byte_letters())}
            self.data = {i: t.encode() if t in merges.special or any(c not in byte for c in t) else bytes(map(byte.__getitem__, t)) for i, t in merges.token.items()}
        self.reset()

    def reset(self) -> None:
        self.begun = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """What the ids add to the text as far as no later id can change it."""
        if self.of_bytes:
            return self.utf8.decode(b"".join([self.data[i] for i in ids if i in self.data]))
        out = " ".join([self.token[i] for i in ids if i in self.token])
        if not out:
            return ""
        out, self.begun = " " + out if self.begun else out, True
        return out

    def close(self) -> str:
        return self.utf8.decode(b"", final=True)

    def decode(self, ids: Iterable[int]) -> str:
        self.reset()
        return self.feed(ids) + self.close()


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Returns the key, ``n_tokens, ids_sha256, decoded_sha256`` and, where asked for, ``ids`` (array of int)."""
    check_rules(path)
    kind = docs.schema[key]
    fields = [kind, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encode(batches):
        encoder = encoder_of(path)
        decoder = Decoder(encoder.m)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    rows, ids = [], []
                    for text in batch.column(1):
                        ids.append([])
                        rows.append(encoder.digest(text.as_py().decode() if text.is_valid else "", decoder, ids[-1] if with_ids else None))
                    n, told, back = zip(*rows)
                    columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, [f.name for f in fields])
        finally:
            encoder.t.forget()

    return lean(docs).select(key, binary_text()).mapInArrow(tidy(encode), T.StructType(fields))


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the decoded text of a column of ids; null ids give a null text. A column of that name is replaced."""
    rows = rows.drop(into)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])
    at = rows.columns.index(ids)

    def decode(batches):
        decoder = Decoder(encoder_of(path).m)
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(tidy(decode), schema)
