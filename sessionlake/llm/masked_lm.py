"""LM scoring by masked pseudo-likelihood.

A bidirectional window network, written in numpy, predicts every token from the ``WINDOW`` tokens on both sides; the sum
of the conditional log-probabilities scores a document. The softmax is factored into a class and a member of the class,
so a token costs two small softmaxes.

Everything is gathered from all documents and grows with them. Word counts (partial counts in tasks, summed by a shuffle)
give the vocabulary: as many ids as ``GROWTH`` times the square root of the number of distinct words, a square number
between ``LEAST_CLASSES`` and ``MOST_CLASSES`` squared. Words beyond it share one id in ``SPARE_SHARE``; such a word is
scored as its id, times the share that its own count has in the counts of that id. These counts are held by hash in a
table of a byte each (a sixteenth of a power of two), with half as many slots as there are words, up to ``MOST_SLOTS``;
words of one slot share their count. Training runs on every partition at once: in each round every task trains a copy of
the model on all its documents, predicting a share of their tokens that differs from round to round; the copies are
averaged, weighted by tokens, in two steps, so no task gathers those of all partitions.

Words are runs without white space, A-Z lower-cased. Null and empty texts have no tokens, sum 0, mean null; very long
ones are read whole. Repeated rows count as often as they occur; an empty table gives an empty table and an untrained
model. Only the key and ``text`` are read, so extra columns of any name do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, binary_text, lean, scratch, tidy, written

GROWTH, LEAST_CLASSES, MOST_CLASSES, SPARE_SHARE = 2.4, 32, 512, 16
LEAST_SLOTS, MOST_SLOTS, BLOCK_SLOTS = 1 << 16, 1 << 24, 1 << 16
WIDTH, HIDDEN, WINDOW = 16, 32, 2
SHARE_MASKED = 0.15
CHUNK, STEP, AT_ONCE = 4096, 4096, 1 << 14
AROUND = np.array([d for d in range(-WINDOW, WINDOW + 1) if d])


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def classes_for(distinct: int) -> int:
    return min(MOST_CLASSES, max(LEAST_CLASSES, math.ceil(math.sqrt(GROWTH * math.sqrt(distinct)))))


def spare_ids(classes: int) -> int:
    return classes * classes // SPARE_SHARE - 1


def spare_and_slot(word: bytes, spare: int, slots: int) -> tuple[int, int]:
    """The shared id (from 1) of a word beyond the vocabulary and the slot of its count."""
    ids, at = spares_and_slots([word], spare, slots)
    return int(ids[0]), int(at[0])


def spares_and_slots(words: list[bytes], spare: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return (1 + h % np.uint64(spare)).astype(np.int32), ((h >> np.uint64(30)) & np.uint64(slots - 1)).astype(np.int32)


@dataclass
class Model:
    """``classes`` squared ids: 0 is the edge of a text, then the spare ones, then the vocabulary's."""

    classes: int
    vocabulary: list[bytes]
    counts: np.ndarray
    spare_logs: np.ndarray
    flat: np.ndarray | None = None


class Words:
    """Ids of words, and the bytes of the counts of those beyond the vocabulary.

    Most distinct words of a large corpus lie beyond it, and most of these are rare, so nothing is remembered of them:
    words are looked up and hashed by calls for many at once, and no Python code runs for a single word.
    """

    def __init__(self, model: Model):
        self.spare, self.counts = spare_ids(model.classes), model.counts
        self.known = {w: k + 1 + self.spare for k, w in enumerate(model.vocabulary)}

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.fromiter(map(self.known.get, words, repeat(0)), dtype=np.int32, count=len(words))
        codes = np.zeros(len(words), dtype=np.uint8)
        beyond = ids == 0  # the edge's id, which no word has
        ids[beyond], slots = spares_and_slots(list(compress(words, beyond.tobytes())), self.spare, len(self.counts))
        codes[beyond] = self.counts[slots]
        return ids, codes

    def row(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one row with WINDOW edges around each; positions of tokens; tokens of each text; bytes of
        counts of the tokens."""
        parts, counts, held = [], [], []
        for t in texts:
            found = tokens(t)
            counts.append(len(found))
            held += found
            if len(held) >= AT_ONCE:
                parts.append(self.ids(held))
                held = []
        parts.append(self.ids(held))
        counts = np.array(counts, dtype=np.int64)
        starts = np.cumsum(counts + WINDOW) - counts
        places = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        row = np.zeros(counts.sum() + WINDOW * (len(counts) + 1), dtype=np.int32)
        row[places] = np.concatenate([p[0] for p in parts])
        return row, places, counts, np.concatenate([p[1] for p in parts])


class Network:
    """Parameters in one row: embeddings, hidden layer, classes, members."""

    def __init__(self, classes: int, flat: np.ndarray | None = None):
        self.classes = c = classes
        shapes = {"e": (c * c, WIDTH), "w": (2 * WINDOW * WIDTH, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, c), "cb": (c,), "m": (c, HIDDEN, c), "mb": (c, c)}
        if flat is None:
            rng = np.random.default_rng(7)
            flat = np.concatenate([(np.zeros(s) if len(s) == 1 or n == "mb" else rng.normal(0, 0.1, s)).ravel() for n, s in shapes.items()])
        self.flat = flat.astype(np.float32)
        self.p, at = {}, 0
        for n, s in shapes.items():
            self.p[n] = self.flat[at : at + int(np.prod(s))].reshape(s)
            at += int(np.prod(s))
        self.squares, self.bounded, self.rooms = None, False, {}

    def _room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """Memory that every step uses again: new arrays of this size would be taken from the system page by page each time."""
        held = self.rooms.get(name)
        if held is None or len(held) < rows:
            held = self.rooms[name] = np.empty((rows, columns), dtype=np.float32)
        return held[:rows]

    def most(self) -> float:
        """What no score exceeds in size: hidden units lie between -1 and 1."""
        p = self.p
        return float(max((np.abs(p["c"]).sum(axis=0) + np.abs(p["cb"])).max(), (np.abs(p["m"]).sum(axis=1) + np.abs(p["mb"])).max()))

    def _exp(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials, in place, and their sums; scores that could overflow are cut."""
        if not self.bounded:
            np.clip(x, -60, 60, out=x)
        np.exp(x, out=x)
        return x, x @ np.ones(x.shape[1], dtype=x.dtype)

    def _hidden(self, row: np.ndarray, places: np.ndarray):
        around = row[places[:, None] + AROUND]
        x = self._room("x", len(places), 2 * WINDOW * WIDTH)
        self.p["e"].take(around, axis=0, out=x.reshape(-1, 2 * WINDOW, WIDTH), mode="clip")  # no id lies outside
        h = np.matmul(x, self.p["w"], out=self._room("h", len(x), HIDDEN))
        h += self.p["b"]
        return around, x, np.tanh(h, out=h)

    def _both(self, h: np.ndarray, kind: np.ndarray, member: np.ndarray, probabilities: bool):
        """Log-probability of each target; where asked for, also of all classes and of all members of its class.

        The rows stand in order of their class.
        """
        n = np.arange(len(h))
        c = np.matmul(h, self.p["c"], out=self._room("c", len(h), self.classes))
        c += self.p["cb"]
        m = self._room("m", len(h), self.classes)
        cuts = np.searchsorted(kind, np.arange(self.classes + 1))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            a, b = cuts[k], cuts[k + 1]
            np.matmul(h[a:b], self.p["m"][k], out=m[a:b])
            m[a:b] += self.p["mb"][k]
        (c, cs), (m, ms) = self._exp(c), self._exp(m)
        logs = np.log(c[n, kind].astype(np.float64) / cs) + np.log(m[n, member].astype(np.float64) / ms)
        if probabilities:
            c /= cs[:, None]
            m /= ms[:, None]
        return logs, c, m, cuts

    def log_probabilities(self, row: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), dtype=np.float64)
        self.bounded = self.bounded or self.most() <= 60
        # all places in order of their class: few classes, with many rows each, fall to a chunk
        order = np.argsort((row[places] // self.classes).astype(np.int16), kind="stable")
        for a in range(0, len(places), CHUNK):
            at = order[a : a + CHUNK]
            some = places[at]
            target = row[some]
            _, _, h = self._hidden(row, some)
            out[at] = self._both(h, target // self.classes, target % self.classes, False)[0]
        return out

    def learn(self, row: np.ndarray, places: np.ndarray, rate: float) -> None:
        """One Adagrad step on the masked places; only the embeddings and classes that occur change."""
        self.bounded = False
        p, n = self.p, np.arange(len(places))
        places = places[np.argsort((row[places] // self.classes).astype(np.int16), kind="stable")]  # by radix
        kind, member = row[places] // self.classes, row[places] % self.classes
        around, x, h = self._hidden(row, places)
        _, pc, pm, cuts = self._both(h, kind, member, True)
        if self.squares is None:
            self.squares = Network(self.classes, np.full_like(self.flat, 1e-6)).p
        share = 1.0 / max(len(places), 1)
        pc[n, kind] -= 1
        pm[n, member] -= 1
        pc *= share
        pm *= share

        def move(name, at, grad):
            self.squares[name][at] += grad * grad
            p[name][at] -= rate * grad / np.sqrt(self.squares[name][at])

        dh = np.matmul(pc, p["c"].T, out=self._room("dh", len(h), HIDDEN))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            a, b = cuts[k], cuts[k + 1]
            dh[a:b] += pm[a:b] @ p["m"][k].T
            move("m", k, h[a:b].T @ pm[a:b])
            move("mb", k, pm[a:b].sum(axis=0))
        every = slice(None)
        move("c", every, h.T @ pc)
        move("cb", every, pc.sum(axis=0))
        slope = np.multiply(h, h, out=self._room("slope", len(h), HIDDEN))
        dz = np.multiply(dh, np.subtract(1, slope, out=slope), out=dh)
        dx = np.matmul(dz, p["w"].T, out=self._room("dx", len(h), 2 * WINDOW * WIDTH)).reshape(-1, WIDTH)
        move("w", every, x.T @ dz)
        move("b", every, dz.sum(axis=0))
        ids = around.ravel()
        order = np.argsort(ids.astype(np.uint16) if self.classes <= 256 else ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        move("e", ids[first], np.add.reduceat(dx.take(order, axis=0, out=self._room("by id", len(dx), WIDTH), mode="clip"), first, axis=0))


def count_words(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """``word`` (bytes) and ``n`` over all documents."""

    def count(batches):
        seen: Counter = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > held:
                    yield told()
                    seen.clear()
        yield told()

    return lean(docs).select(binary_text()).mapInArrow(tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rare_counts(rare: DataFrame, classes: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each slot (sixteenths of a power of two), and the logarithm of the count of each shared id."""
    spare = spare_ids(classes)

    def run(batches):
        for batch in batches:
            ids, at = spares_and_slots(batch.column(0).to_pylist(), spare, slots)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at), batch.column(1)], ["spare", "slot", "n"])

    def pack(key, rows):
        out = np.zeros(BLOCK_SLOTS, dtype=np.uint8)
        out[rows.column("slot").to_numpy() % BLOCK_SLOTS] = rows.column("code").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "codes": pa.array([out.tobytes()], pa.binary())})

    hashed = written(rare.mapInArrow(run, "spare int, slot int, n long"))
    code = F.least(F.lit(255), F.round(F.log2(F.sum("n")) * 16)).cast("int")
    by_slot = hashed.groupBy("slot").agg(code.alias("code")).withColumn("block", F.floor(F.col("slot") / BLOCK_SLOTS).cast("int"))
    codes = np.zeros(slots, dtype=np.uint8)
    for r in by_slot.groupBy("block").applyInArrow(pack, "block int, codes binary").toLocalIterator():
        codes[r["block"] * BLOCK_SLOTS :][:BLOCK_SLOTS] = np.frombuffer(r["codes"], np.uint8)[: len(codes)]
    logs = np.zeros(spare + 1)
    for r in hashed.groupBy("spare").agg(F.sum("n").alias("n")).collect():
        logs[r["spare"]] = math.log(r["n"])
    return codes, logs


def _averaged(copies: DataFrame) -> list:
    """The weighted mean of the copies of each block: first within groups of tasks, then of these."""

    def sums(key, rows):
        weight = rows.column("weight").to_numpy()
        parts = np.array(rows.column("part").to_pylist(), dtype=np.float64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "weight": [weight.sum()], "part": pa.array([((weight / weight.sum()) @ parts).tolist()], pa.list_(pa.float64()))})

    shape = "block int, weight double, part array<double>"
    some = copies.groupBy("block", "task").applyInArrow(sums, shape)
    return some.groupBy("block").applyInArrow(sums, shape).select("block", "part").collect()


def _counted_model(docs: DataFrame) -> Model:
    """All of the model that is counted and not trained."""
    counted = written(count_words(docs))
    distinct = counted.count()
    classes = classes_for(distinct)
    room = classes * classes - 1 - spare_ids(classes)
    frequent = written(counted.orderBy(F.desc("n"), "word").limit(room))
    vocabulary = [bytes(r["word"]) for r in frequent.orderBy(F.desc("n"), "word").collect()]
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (distinct // 2).bit_length()))
    return Model(classes, vocabulary, *_rare_counts(counted.join(F.broadcast(frequent.select("word")), "word", "left_anti"), classes, slots))


def train(docs: DataFrame, rounds: int = 2, rate: float = 0.1, block: int = 4096, tasks: int = 64) -> Model:
    """The vocabulary, the counts beyond it and the parameters."""
    context = docs.sparkSession.sparkContext
    with scratch(docs.sparkSession):
        model = _counted_model(docs)
    model.flat = Network(model.classes).flat
    for k in range(rounds):
        sent = context.broadcast(model)

        def fit(batches, k=k):
            model = sent.value
            words, net, rng, seen, hashed = Words(model), Network(model.classes, model.flat.copy()), np.random.default_rng(11), 0, 0
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    row, places, counts, _ = words.row(whole.column(0).slice(at, 1000).to_pylist())
                    drawn = rng.random(len(places))
                    places = places[(drawn >= k * SHARE_MASKED) & (drawn < (k + 1) * SHARE_MASKED)]
                    rng.shuffle(places)
                    seen += len(places)
                    hashed = (hashed * 31 + int(counts.sum())) % (1 << 30)
                    for a in range(0, len(places), STEP):
                        net.learn(row, places[a : a + STEP], rate)
            if seen:
                parts = [net.flat[a : a + block].tolist() for a in range(0, len(net.flat), block)]
                columns = [pa.array(range(len(parts)), pa.int32()), pa.array([hashed % tasks] * len(parts), pa.int32()), pa.array([float(seen)] * len(parts), pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.list_(pa.float32()))], ["block", "task", "weight", "part"])

        copies = lean(docs).select(binary_text()).mapInArrow(tidy(fit), "block int, task int, weight double, part array<float>")
        averaged = _averaged(copies)
        if averaged:
            model.flat = np.concatenate([r["part"] for r in sorted(averaged, key=lambda r: r["block"])]).astype(np.float32)
    return model


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """The key, ``n_tokens``, ``log_likelihood`` (the sum) and ``mean_log_likelihood``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_likelihood", T.DoubleType())])

    def score(batches):
        model = sent.value
        words, net = Words(model), Network(model.classes, model.flat)
        shares = np.concatenate([model.spare_logs, np.zeros(model.classes * model.classes - len(model.spare_logs))])
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                row, places, counts, codes = words.row(some.column(1).to_pylist())
                # a word beyond the vocabulary: its own count over that of its shared id; words never counted count once
                own = np.minimum(codes * (math.log(2) / 16) - shares[row[places]], 0.0)
                logs = np.concatenate([[0.0], np.cumsum(net.log_probabilities(row, places) + own)])
                ends = np.cumsum(counts)
                sums = logs[ends] - logs[ends - counts]
                means = [s / n if n else None for s, n in zip(sums.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], schema.names)

    return lean(docs).select(key, binary_text()).mapInArrow(tidy(score), schema)
