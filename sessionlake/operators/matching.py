"""Vector operators: nearest centroid, assignment, flips, similar pairs, rings and running centroids.

Vectors are ``array<float>``; arithmetic is in double. A library of centroids is one row per ``name``. Vectors are scored
against it in blocks of at most BLOCK_BYTES, each a matrix product for a batch of vectors, PASS_BLOCKS of them a pass over
the vectors; the best so far goes from pass to pass beside the vector, by way of a checkpoint, so nothing shuffles, a task
has one Python worker with one pass's blocks, and what was broadcast for a pass is freed after it. The library comes to the
driver a block at a time; each pass reads the vectors once, so time grows with the library's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from sessionlake.sources.shared import shared_folder

BLOCK_BYTES, PASS_BLOCKS = 32 << 20, 4
#: Vectors of a group that a task holds at most, vectors that pass them at least, and scores taken at once.
HELD, PASSING, SCORES = 32768, 4096, 1 << 22
#: Pairs found that go out at once.
PAIRS = 100_000
#: What rounding may take from a cosine.
NEAR = 1e-9
#: Pivots of the search for similar pairs, and what rounding may take from an angle.
PIVOTS, SLACK = 32, 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with 1e-9 added to each norm, so that zero vectors give 0."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def mean_vectors(vectors: DataFrame, by: str, vec: str) -> DataFrame:
    """The unweighted mean of each group's vectors: partial sums per position, so no group is gathered."""
    each = vectors.select(by, F.posexplode(vec).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def _blocks(library: DataFrame, name: str) -> Iterator[tuple[list, np.ndarray]]:
    """Names in order and their unit vectors, a block at a time."""
    names, vectors, size = [], [], 0
    for r in library.select(F.col(name).alias("n"), "centroid").where("n is not null and centroid is not null").orderBy("n").toLocalIterator():
        names.append(r["n"])
        vectors.append(r["centroid"])
        size += 8 * len(r["centroid"])
        if size >= BLOCK_BYTES:
            yield names, _unit(vectors)
            names, vectors, size = [], [], 0
    if names:
        yield names, _unit(vectors)


def _unit(rows: list | np.ndarray) -> np.ndarray:
    v = np.asarray(rows, dtype=np.float64)
    return v / (np.sqrt((v * v).sum(axis=1)) + 1e-9)[:, None]


def best_scores(vectors: DataFrame, library: DataFrame, name: str, vec: str, own: str | None = None) -> DataFrame:
    """Adds ``best`` and ``best_score``, of equal scores the first name; with ``own``, the best of the others and
    ``own_score``. Null vectors and an empty library give nulls."""
    kind = library.schema[name].dataType
    empty = {"best": F.lit(None).cast(kind), "best_score": F.lit(None).cast("double")} | ({"own_score": F.lit(None).cast("double")} if own else {})
    rows = vectors.withColumns(empty)
    arrow, context = to_arrow_type(kind), vectors.sparkSession.sparkContext
    columns, schema = rows.columns, rows.schema
    at, mine = columns.index(vec), columns.index(own) if own else None
    to = {c: columns.index(c) for c in empty}

    def one_pass(rows: DataFrame, sent: list) -> DataFrame:
        def run(batches):
            blocks = [(names, matrix, {n: k for k, n in enumerate(names)}) for names, matrix in (b.value for b in sent)]
            for whole in batches:
                for first in range(0, whole.num_rows, 1024):
                    batch = whole.slice(first, 1024)
                    out = {c: batch.column(k).to_pylist() for c, k in to.items()}
                    there = [k for k, v in enumerate(batch.column(at).is_valid().to_pylist()) if v]
                    held = _unit([batch.column(at)[k].as_py() for k in there]) if there else None
                    for names, matrix, place in blocks if there else ():
                        scores = held @ matrix.T
                        if mine is not None:
                            for row, k in enumerate(there):
                                j = place.get(batch.column(mine)[k].as_py())
                                if j is not None:
                                    out["own_score"][k] = float(scores[row, j])
                                    scores[row, j] = -np.inf
                        for row, (k, j) in enumerate(zip(there, scores.argmax(axis=1).tolist())):
                            s = float(scores[row, j])
                            if s > -np.inf and (out["best_score"][k] is None or s > out["best_score"][k]):
                                out["best"][k], out["best_score"][k] = names[j], s
                    made = {c: pa.array(v, arrow if c == "best" else pa.float64()) for c, v in out.items()}
                    yield pa.RecordBatch.from_arrays([made.get(c, batch.column(k)) for k, c in enumerate(columns)], columns)

        return rows.mapInArrow(run, schema)

    sent: list = []
    for block in _blocks(library, name):
        if len(sent) == PASS_BLOCKS:
            shared_folder(vectors.sparkSession)
            rows = one_pass(rows, sent).checkpoint()
            for b in sent:
                b.destroy()
            sent = []
        sent.append(context.broadcast(block))
    return one_pass(rows, sent) if sent else rows


def _matrix(vecs: pa.Array) -> np.ndarray:
    """Lists of numbers of one length as rows of doubles."""
    if len(pc.unique(pc.list_value_length(vecs))) > 1:
        raise ValueError("vectors of different lengths")
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed in order of the positions, so that equal rows give equal sums."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(_dots(a, a)) + 1e-9


def past_held(rows: DataFrame, part: list[str], order: list[str], hold: Callable, meet: Callable, schema) -> DataFrame:
    """Streams the rows of each part that pass (``_passes``) by those that are held, which come first, in ``order``.

    A part is one task's: ``hold`` makes something of all the batches held, and ``meet`` of that and a batch of what passes
    the batches that come out. So a task keeps what is held of one part and one batch, however many rows pass. What passes
    a part where nothing is held gives nothing.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small rows do not end in one task
    dealt = rows.repartition(tasks, *part).sortWithinPartitions(*part, "_passes", *order)

    def run(batches):
        at, parts, made = None, [], None
        for batch in batches:
            first = 0
            for (key, passes), run in groupby(zip(zip(*(batch.column(c).to_pylist() for c in part)), batch.column("_passes").to_pylist())):
                n = sum(1 for _ in run)
                some, first = batch.slice(first, n), first + n
                if key != at:
                    at, parts, made = key, [], None
                if not passes:
                    parts.append(some)
                elif parts or made is not None:
                    if made is None:
                        made, parts = hold(parts), []
                    yield from meet(made, some)

    return dealt.mapInArrow(run, schema)


def nearest_of_group(rows: DataFrame, library: DataFrame, group: str, keys: list[str], names: list[str], vec: str = "vec") -> DataFrame:
    """``keys, group, score, names``: the vector of its group that is nearest to a row's, of equal ones the first by ``names``.

    Rows of groups without vectors, and null vectors, are left out. A group's rows are cut into parts as large as its
    vectors (at least PASSING) that pass by these, so what is sent is no more than some times the rows and the vectors,
    however they grow, and pairs are nowhere rows. Groups of more than HELD vectors are cut, too; then a row has a nearest
    one from each cut, and the caller takes the best. Scores are cosines as ``cosine`` sums them: of those that a matrix
    product finds within rounding of the best.
    """
    kind = rows.schema[group].dataType
    rows, library = rows.where(F.col(vec).isNotNull() & F.col(group).isNotNull()), library.where(F.col(vec).isNotNull()).withColumn(group, F.col(group).cast(kind))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).join(library.groupBy(group).agg(F.count(F.lit(1)).alias("_m")), group)
    sizes = sizes.select(group, F.ceil(F.col("_m") / HELD).alias("_cuts"), F.ceil(F.col("_n") / F.greatest(F.lit(PASSING), F.least(F.lit(HELD), "_m"))).alias("_parts"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = lambda of, c: F.pmod(F.xxhash64(*of), F.col(c))
    vector = F.col(vec).cast("array<double>") if rows.schema[vec].dataType != library.schema[vec].dataType else F.col(vec)
    passing = rows.join(sizes, group).select(group, each("_cuts").alias("_cut"), dealt(keys, "_parts").alias("_part"), F.lit(True).alias("_passes"), vector.alias("_v"), F.struct(*keys).alias("_key"))
    held = library.join(sizes, group).select(group, dealt(names, "_cuts").alias("_cut"), each("_parts").alias("_part"), F.lit(False).alias("_passes"), vector.alias("_v"), F.struct(*names).alias("_name"))

    called = names

    def hold(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        vecs, names = _matrix(table["_v"].combine_chunks()), table["_name"].combine_chunks()
        _, first = np.unique(np.ascontiguousarray(vecs).view(f"V{8 * vecs.shape[1]}").ravel(), return_index=True)  # of copies the first name
        first.sort()
        vecs, names = vecs[first], names.take(pa.array(first))
        norms = _norms(vecs)
        return vecs, norms, (vecs / norms[:, None]).T.copy(), names

    def meet(held, batch):
        vecs, norms, units, names = held
        step = max(1, SCORES // len(vecs))
        for a in range(0, batch.num_rows, step):
            some = batch.slice(a, step)
            mine = _matrix(some.column("_v"))
            own = _norms(mine)
            scores = (mine / own[:, None]) @ units
            if not (np.isfinite(own).all() and np.isfinite(norms).all()):
                scores[~np.isfinite(scores)] = -np.inf
            row, at = np.nonzero(scores >= (scores.max(axis=1) - NEAR)[:, None])
            exact = _dots(mine[row], vecs[at]) / (own[row] * norms[at])
            order = np.lexsort((at, -exact, row))
            best = order[np.unique(row[order], return_index=True)[1]]
            made = [*some.column("_key").flatten(), some.column(group), pa.array(exact[best]), *names.take(pa.array(at[best])).flatten()]
            yield pa.RecordBatch.from_arrays(made, [*keys, group, "score", *called])

    shape = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in [*keys, group]] + [T.StructField("score", T.DoubleType())] + [T.StructField(c, library.schema[c].dataType) for c in names])
    return past_held(held.unionByName(passing, allowMissingColumns=True), [group, "_cut", "_part"], ["_name"], hold, meet, shape)


def nearest_centroid(vectors: DataFrame, library: DataFrame, name: str, vec: str) -> DataFrame:
    """Adds ``best`` and ``best_score``; an empty library gives null and -1."""
    return best_scores(vectors, library, name, vec).withColumn("best_score", F.coalesce("best_score", F.lit(-1.0)))


def flips(vectors: DataFrame, library: DataFrame, own: str, name: str, vec: str, margin: float) -> DataFrame:
    """Vectors that another centroid fits better than their own by more than the margin: adds ``other`` and ``flip``."""
    rows = best_scores(vectors, library, name, vec, own).withColumnRenamed("best", "other")
    return rows.withColumn("flip", F.coalesce(F.col("best_score") - F.col("own_score") > margin, F.lit(False))).drop("best_score", "own_score")


def _scores_of_few(vectors: DataFrame, library: DataFrame, name: str, vec: str) -> DataFrame:
    """Adds ``scores``: ``array<struct<name, score>>`` against a library of a few names."""
    whole = library.agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col("centroid").alias("c")))).alias("_lib"))
    rows = vectors.join(F.broadcast(whole))  # one row
    return rows.withColumn("scores", F.transform("_lib", lambda e: F.struct(e["name"].alias("name"), cosine(F.col(vec), e["c"]).alias("score")))).drop("_lib")


def assign_two(clusters: DataFrame, library: DataFrame, group: str, slot: str, first, second, name: str, vec: str) -> DataFrame:
    """Of two clusters (slots 0 and 1) and two roles, the pairing with the larger sum of scores; the straight one on ties."""
    rows = _scores_of_few(clusters, library.where(F.col(name).isin(first, second)), name, vec)
    score = lambda k, who: F.max(F.when(F.col(slot) == k, F.coalesce(F.get(F.filter("scores", lambda s: s["name"] == who), F.lit(0))["score"], F.lit(-1.0))))
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (score(0, first) + score(1, second)).alias("straight"), (score(1, first) + score(0, second)).alias("crossed"))
    return sums.where("n = 2").select(group, (F.col("straight") >= F.col("crossed")).alias("is_straight"))


def _directions(rows: list) -> np.ndarray:
    v = np.array(rows, dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _celled(pivots: np.ndarray) -> Callable[[Column], Column]:
    """``cell, angles`` of a vector: its two nearest pivots as one number, and its angles to all; cell -1 without a direction."""
    k = len(pivots)

    @F.pandas_udf("cell int, angles array<double>")
    def celled(vecs: pd.Series) -> pd.DataFrame:
        angles = np.arccos(np.clip(_directions(vecs.tolist()) @ pivots.T, -1.0, 1.0))
        near = np.argsort(angles, axis=1)[:, :2]
        cell = np.where(np.isnan(angles).any(axis=1), -1, near[:, 0] * k + near[:, 1])
        return pd.DataFrame({"cell": cell.astype("int32"), "angles": list(angles)})

    return celled


def meeting_cells(lo: np.ndarray, hi: np.ndarray, within: float) -> np.ndarray:
    """Which cells may hold two vectors whose angle is at most ``within``, from their least and largest angles to each pivot.

    Angles obey the triangle inequality, so angles to one pivot differ by no more than the angle of the two vectors.
    """
    near = np.ones((len(lo), len(lo)), dtype=bool)
    for k in range(lo.shape[1]):
        apart = lo[:, k][:, None] - hi[:, k][None, :] > within
        near &= ~(apart | apart.T)
    return near


def _cells(vectors: DataFrame, key: str, vec: str, above: float, block: int) -> tuple[DataFrame, pa.Table]:
    """The vectors with ``_cell``, and the cells that meet: ``c1, c2, parts1, parts2``, each pair once, also with itself.

    Up to PIVOTS vectors serve as pivots, so there are fewer than PIVOTS squared cells, whose boxes fit the driver however
    many vectors there are. Thresholds below 0, tables of few blocks and cells that save nothing make one cell.
    """
    n = vectors.count()
    few = min(PIVOTS, n // (4 * block)) if above >= 0 else 0
    pivots = _directions([r[0] for r in vectors.orderBy(F.xxhash64(key)).limit(few).select(vec).collect()]) if few > 1 else np.empty((0, 0))
    pivots = pivots[~np.isnan(pivots).any(axis=1)]
    table = lambda *columns: pa.table(dict(zip(("c1", "c2", "parts1", "parts2"), (pa.array(c, pa.int32()) for c in columns))))
    whole = [max(1, -(-n // block))]
    one_cell = vectors.withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(1)).cast("int")), table([0], [0], whole, whole)  # no constant, so the joins keep their keys
    if len(pivots) < 2:
        return one_cell
    celled = vectors.withColumn("_c", _celled(pivots)(vec))
    bound = lambda f: F.array(*[f(F.get("_c.angles", F.lit(k))) for k in range(len(pivots))])
    boxes = celled.where("_c.cell >= 0").groupBy("_c.cell").agg(F.count(F.lit(1)).alias("n"), bound(F.min).alias("lo"), bound(F.max).alias("hi")).orderBy("cell").collect()
    lo, hi = (np.array([r[c] for r in boxes], dtype=np.float64).reshape(len(boxes), len(pivots)) for c in ("lo", "hi"))
    one, two = np.nonzero(np.triu(meeting_cells(lo, hi, float(np.arccos(min(1.0, above))) + SLACK)))
    cell, rows = (np.array([r[c] for r in boxes], dtype=np.int64) for c in ("cell", "n"))
    parts = -(-rows // block)
    if (rows[one] * parts[two]).sum() >= n * whole[0] / 2:  # as many rows sent as by blocks of all vectors
        return one_cell
    return celled.where("_c.cell >= 0").withColumn("_cell", F.col("_c.cell")).drop("_c"), table(cell[one], cell[two], parts[one], parts[two])


def similar_pairs(vectors: DataFrame, key: str, vec: str, above: float, block: int | None = None) -> DataFrame:
    """Pairs ``a < b`` with a cosine above the threshold: vectors pass by blocks of others, each batch one product.

    Vectors are put into cells by their two nearest pivots; cells too far apart for the threshold never meet, and a cell is
    cut into blocks by hash, so one that holds many vectors is many tasks. Each vector is sent once to every block it meets
    (of two blocks of a cell one passes by the other, by turns); only the list of cells is broadcast. A task holds one block
    and the scores of a batch, however many vectors pass. Blocks have a 64th of the vectors, between 512 and 8192. Pruning
    never loses a pair. Keys are of any type that orders. Null vectors, and with a threshold of 0 or more those of length 0
    or with NaN, are in no pair.
    """
    vectors = vectors.where(F.col(vec).isNotNull())
    placed, cells = _cells(vectors, key, vec, above, block or min(8192, max(512, vectors.count() // 64)))
    meeting = vectors.sparkSession.createDataFrame(cells)
    parts = meeting.where("c1 = c2").select(F.col("c1").alias("_cell"), F.col("parts1").alias("_parts"))
    rows = placed.join(F.broadcast(parts), "_cell").select("_cell", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part"), F.col(key).alias("_k"), F.col(vec).alias("_v"))
    held = rows.select(F.col("_cell").alias("_c1"), F.col("_part").alias("_p1"), F.lit(False).alias("_passes"), F.lit(False).alias("_same"), "_k", "_v")
    # block p of a cell of n passes by itself and the half of the others before it; of two that face each other the lower one
    n, p = F.col("parts2"), F.col("_part")
    before = F.floor((n - 1) / 2).cast("int") + F.when((n % 2 == 0) & (p < n / 2), 1).otherwise(0)
    steps = F.sequence(F.lit(0), F.when(F.col("c1") == F.col("c2"), before).otherwise(F.col("parts1") - 1))
    met = rows.join(F.broadcast(meeting), F.col("_cell") == F.col("c2")).select("c1", "c2", "parts2", "_part", "_k", "_v", F.explode(steps).alias("_step"))
    own = F.col("c1") == F.col("c2")
    passing = met.select(
        F.col("c1").alias("_c1"), F.when(own, F.pmod(p - F.col("_step"), n)).otherwise(F.col("_step")).cast("int").alias("_p1"), F.lit(True).alias("_passes"),
        (own & (F.col("_step") == 0)).alias("_same"), "_k", "_v")

    def hold(batches):
        table = pa.Table.from_batches(batches)
        return table["_k"].combine_chunks(), _unit(_matrix(table["_v"].combine_chunks())).T.copy()

    def meet(held, batch):
        names, units = held
        step = max(1, SCORES // len(names))
        for first in range(0, batch.num_rows, step):
            some = batch.slice(first, step)
            cos = _unit(_matrix(some.column("_v"))) @ units
            at, to = np.nonzero(cos > above)
            same = some.column("_same").to_numpy(zero_copy_only=False)  # in its own block a pair is met from both sides
            for k in range(0, len(at), PAIRS):
                i, j = at[k : k + PAIRS], to[k : k + PAIRS]
                x, y = some.column("_k").take(pa.array(i)), names.take(pa.array(j))
                lower = _lower(x, y)
                kept = pc.or_(lower, pc.and_(_lower(y, x), pa.array(~same[i])))
                made = [pc.if_else(lower, x, y), pc.if_else(lower, y, x), pa.array(cos[i, j])]
                yield pa.RecordBatch.from_arrays(made, ["a", "b", "cosine"]).filter(kept)

    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("cosine", T.DoubleType())])
    return past_held(held.unionByName(passing), ["_c1", "_p1"], ["_same"], hold, meet, schema)


def _lower(x: pa.Array, y: pa.Array) -> pa.Array:
    """Whether ``x`` is smaller than ``y``, row by row; also of types that Arrow does not compare."""
    try:
        return pc.less(x, y)
    except pa.ArrowNotImplementedError:
        return pa.array([a < b for a, b in zip(x.to_pylist(), y.to_pylist())], pa.bool_())


def recent(vectors: DataFrame, by: str, order: str, size: int = 10) -> DataFrame:
    """The newest vectors of each group, newest at place 0."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return vectors.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < size)


def running_centroids(vectors: DataFrame, by: str, order: str, vec: str) -> DataFrame:
    """``by, n, centroid, drift``: the mean blended in order and normalised after every step, and its last drift.

    The steps do not commute, so rows of a group are streamed in order through one task with a state of one vector.
    """
    dealt = vectors.select(by, order, vec).repartition(by).sortWithinPartitions(by, order)

    def run(frames):
        at = state = None
        told = lambda: pd.DataFrame({"by": [at], "n": [state[0]], "centroid": [state[1].tolist()], "drift": [state[2]]})
        for frame in frames:
            for who, v in zip(frame[by], frame[vec]):
                if state is not None and who != at:
                    yield told()
                    state = None
                v = np.asarray(v, dtype=np.float64)
                if state is None:
                    at, state = who, (1, v / (np.linalg.norm(v) + 1e-9), 0.0)
                else:
                    n, prior, _ = state
                    mixed = (prior * n + v) / (n + 1)
                    mixed = mixed / (np.linalg.norm(mixed) + 1e-9)
                    near = prior @ mixed / ((np.linalg.norm(prior) + 1e-9) * (np.linalg.norm(mixed) + 1e-9))
                    state = (n + 1, mixed, float(1 - near))
        if state is not None:
            yield told()

    return dealt.mapInPandas(run, f"by {vectors.schema[by].dataType.simpleString()}, n long, centroid array<double>, drift double").withColumnRenamed("by", by)
