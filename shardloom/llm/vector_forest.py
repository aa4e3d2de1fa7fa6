"""Nearest neighbours by a forest of hash prefixes.

Each tree hashes a vector to a long string: the signed axes of the tree's own random
rotation, in the order of the vector's size along them. A tree is kept as sorted arrays
of these strings. The first characters of a string, none to a few by the number of rows,
name the node it lies in; a node of many rows is cut into slices, nodes of few share a
place, so every array is of bounded size.

A prefix is as near to a query as the sum of the query's components along its characters,
each weighted by the component that a vector is expected to have there. A query descends
every tree to the nodes nearest to it and there along each prefix for as long as the
prefix can still reach the level wanted, so prefixes match over variable lengths. All
trees then ascend together, level by level, until the strings met so far, counted in every
tree, are enough: ``CANDIDATES * rows ** GROWTH``. Candidates are ranked by their exact
inner product. A query whose nodes hold too few strings ascends to the root, which holds
every row.

Strings are of directions; a row's length multiplies its score. Rows with equal vectors
are one class with its smallest ids, so a vector that many rows have is indexed once.

Defined results: vectors that are null, empty or zero, that hold null or non-finite
components, or whose length isn't the most common one (the smaller of several) take
no part; a query with fewer candidates than asked for gets all; ties go to the
smaller id; rows that share id and vector count once; columns beyond vec_id and
embedding are not looked at, whatever they are called; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .store import materialize

TREES = 8
#: Characters of a string.
CHARACTERS = 16
#: Of the characters that can follow a prefix, a query descends along one in so many.
NARROWING = 4
#: Strings, counted in every tree, at which the trees stop ascending.
CANDIDATES, GROWTH = 8, 0.4
#: Rows of a node, on average, beyond which strings are told apart by one more character.
NODE_ROWS = 1024
#: Rows in one sorted array.
ARRAY_ROWS = 32_768
LEVELS = 64
#: Characters that are matched before the first look at whether a prefix can still reach its level.
HEAD = 6
SEED = 5
#: Nodes up to which a table of them is broadcast (under 64 MB).
BROADCAST_NODES = 1_000_000

_STRING = "tree int, node long, cls long, id long, string binary, norm double, vector binary"
_DESCENT = "tree int, node long, cls long, floor double"
_FOUND = "query long, cls long, id long, score double"


def _rotation(size: int, tree: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([SEED, tree]).standard_normal((size, size)))[0]


def _weights(size: int) -> np.ndarray:
    """The expected components of a random direction along its largest axes."""
    normal = NormalDist()
    ranks = np.arange(1, min(CHARACTERS, size) + 1)
    return np.array([normal.inv_cdf(1 - (k - 0.375) / (size + 0.25) / 2) for k in ranks]) / np.sqrt(size)


def depth_of(rows: int, size: int, node_rows: int = NODE_ROWS) -> int:
    """Characters that name a node."""
    depth, held = 0, rows
    while held > node_rows and depth < min(CHARACTERS, size) and (2 * size) ** (depth + 1) < 1 << 62:
        depth, held = depth + 1, held / (2 * size)
    return depth


def _matrix(column: pa.Array, size: int, kind: str) -> np.ndarray:
    """Vectors in double precision; ``kind``: the NumPy type they are kept in."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(-1, size)


def _signed(y: np.ndarray) -> np.ndarray:
    """Components along both directions of every axis; the column is the character."""
    return np.concatenate([-y, y], axis=1)


def _name(characters: np.ndarray, size: int) -> np.ndarray:
    """The node of each row of characters."""
    out = np.zeros(len(characters), np.int64)
    for j in range(characters.shape[1]):
        out = out * (2 * size) + characters[:, j]
    return out


def _strings(size: int, kind: str, depth: int):
    """A row per tree for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = [_rotation(size, t) for t in range(TREES)]
        count = min(CHARACTERS, size)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), size, kind)
            for tree in range(TREES):
                y = x @ rotations[tree]
                axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :count]
                characters = axes + size * (np.take_along_axis(y, axes, 1) > 0)
                strings = np.ascontiguousarray(characters.astype(">u2"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), tree), pa.int32()),
                        pa.array(_name(characters[:, :depth], size)),
                        batch.column("cls"),
                        batch.column("id"),
                        pa.array([s.tobytes() for s in strings], pa.binary()),
                        batch.column("norm"),
                        batch.column("vector"),
                    ],
                    names=["tree", "node", "cls", "id", "string", "norm", "vector"],
                )

    return run


def _descents(size: int, kind: str, depth: int):
    """The nodes to which a query descends in each tree, and the score that the last of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations, weights = [_rotation(size, t) for t in range(TREES)], _weights(size)
        width = -(-2 * size // NARROWING)
        for batch in batches:
            if not batch.num_rows:
                continue
            classes = batch.column("cls").to_numpy()
            x = _matrix(batch.column("vector"), size, kind)
            for tree in range(TREES):
                signed = _signed(x @ rotations[tree])
                nodes, owners, floors = [], [], []
                for i in range(len(x)):
                    best, score = np.zeros((1, 0), np.int64), np.zeros(1)
                    for j in range(depth):
                        score = (score[:, None] + weights[j] * signed[i][None, :]).ravel()
                        best = np.concatenate([np.repeat(best, 2 * size, 0), np.tile(np.arange(2 * size), len(best))[:, None]], axis=1)
                        if j:  # an axis occurs once in a string
                            new = (best[:, :-1] % size != best[:, -1:] % size).all(1)
                            best, score = best[new], score[new]
                        take = min(len(score), width ** (j + 1))
                        top = np.argpartition(-score, take - 1)[:take]
                        best, score = best[top], score[top]
                    nodes.append(_name(best, size))
                    owners.append(np.full(len(best), classes[i]))
                    floors.append(np.full(len(best), score.min() - 1e-9 * abs(score.min())))
                owners = np.concatenate(owners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(owners), tree), pa.int32()), pa.array(np.concatenate(nodes)), pa.array(owners), pa.array(np.concatenate(floors))],
                    names=["tree", "node", "cls", "floor"],
                )

    return run


class _Array:
    """A sorted array of strings, and descents along their prefixes."""

    def __init__(self, rows: pa.Table, size: int, depth: int, longest: float):
        count = min(CHARACTERS, size)
        data = np.frombuffer(b"".join(rows.column("string").to_pylist()), ">u2").reshape(-1, count).astype(np.int64)
        self.order = np.lexsort(data.T[::-1])
        self.characters = np.ascontiguousarray(data[self.order].T)
        self.weights, self.depth, self.size = _weights(size), depth, size
        self.norm = rows.column("norm").to_numpy()[self.order] / (longest * float((self.weights**2).sum()))
        new = np.zeros(len(self.order), bool)
        new[:1] = True
        for j in range(depth):
            new[1:] |= self.characters[j, 1:] != self.characters[j, :-1]
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], len(self.order))

    def meet(self, x: np.ndarray, rotation: np.ndarray, floors: np.ndarray, levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, level) of the strings that queries ``x`` meet at their ``levels`` or above.

        ``floors``: the score of the last node that each looks into.
        """
        signed = _signed(x @ rotation)
        per_length = 1 / np.sqrt((x * x).sum(1))
        # what the characters to come can add at most
        most = np.sort(signed, axis=1)[:, ::-1][:, : len(self.weights)] * self.weights
        rest = np.cumsum(most[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([rest, np.zeros((len(x), 1))], axis=1)
        least = np.where(levels >= LEVELS - 1, -np.inf, 1 - (levels + 1) / LEVELS)
        score = np.zeros((len(x), len(self.begin)))
        for j in range(self.depth):
            score += self.weights[j] * signed[:, self.characters[j, self.begin]]
        down = score >= floors[:, None] if self.depth else np.ones(score.shape, bool)
        for node, (a, b) in enumerate(zip(self.begin, self.end, strict=True)):
            at = np.flatnonzero(down[:, node])
            for q in np.array_split(at, len(at) * (b - a) // 1_000_000 + 1):
                if len(q):
                    yield from self._along(q, a, b, signed, per_length, rest, least, levels)

    def _along(self, q, a, b, signed, per_length, rest, least, levels):
        """Along the strings of one node, each for as long as its prefix can reach the query's level."""
        every = np.isinf(least[q]).all()
        upto = len(self.weights) if every else min(max(self.depth, HEAD), len(self.weights))
        codes = np.zeros((2 * self.size, b - a))
        codes[self.characters[:upto, a:b], np.arange(b - a)] = self.weights[:upto, None]
        score = signed[q] @ codes
        scale = per_length[q][:, None] * self.norm[None, a:b]
        able = (score + rest[q, upto][:, None]) * scale >= least[q][:, None]
        i, row = np.nonzero(able)
        score, scale, i, row = score[able], scale[able], q[i], row + a
        for j in range(upto, len(self.weights)):
            score = score + self.weights[j] * signed[i, self.characters[j, row]]
            able = (score + rest[i, j + 1]) * scale >= least[i]
            score, scale, i, row = score[able], scale[able], i[able], row[able]
        met = np.clip(np.floor(LEVELS * (1 - scale * score)), 0, LEVELS - 1).astype(np.int64)
        near = met <= levels[i]
        yield i[near], row[near], met[near]


def _met(size: int, kind: str, depth: int, longest: float):
    """Per query, how many strings of an array it meets at each level."""

    def run(key, rows, queries):
        met, owners = np.zeros((0, LEVELS), np.int64), pa.array([], pa.int64())
        if rows.num_rows and queries.num_rows:
            array, owners = _Array(rows, size, depth, longest), queries.column("cls")
            x = _matrix(queries.column("vector"), size, kind)
            met = np.zeros((len(x), LEVELS), np.int64)
            whole = np.full(len(x), LEVELS - 1)
            for i, _, level in array.meet(x, _rotation(size, key[0].as_py()), queries.column("floor").to_numpy(), whole):
                met += np.bincount(i * LEVELS + level, minlength=met.size).reshape(met.shape)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * LEVELS, pa.int32()), pa.array(met.ravel()))
        return pa.table({"cls": owners, "met": lists})

    return run


def _best(owners: np.ndarray, rows: np.ndarray, scores: np.ndarray, classes: np.ndarray, ids: np.ndarray, count: int) -> pa.Table:
    """The ``count`` best of each owner's rows; ``classes``, ``ids``: of all rows."""
    order = np.lexsort((ids[rows], -scores, owners))
    owners, rows, scores = owners[order], rows[order], scores[order]
    keep = np.arange(len(owners)) - np.searchsorted(owners, owners, side="left") < count
    columns = {"query": owners[keep], "cls": classes[rows[keep]], "id": ids[rows[keep]]}
    return pa.table({n: pa.array(c, pa.int64()) for n, c in columns.items()} | {"score": pa.array(scores[keep], pa.float64())})


def _ranked(size: int, kind: str, depth: int, longest: float, count: int):
    """The best of an array's strings that a query meets, by exact inner product."""

    def run(key, rows, queries):
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        cls, ids = (rows.column(c).to_numpy() for c in ("cls", "id"))
        if rows.num_rows and queries.num_rows:
            array = _Array(rows, size, depth, longest)
            vectors = _matrix(rows.column("vector"), size, kind)
            x, owners = _matrix(queries.column("vector"), size, kind), queries.column("cls").to_numpy()
            floors, levels = queries.column("floor").to_numpy(), queries.column("level").to_numpy()
            for i, row, _ in array.meet(x, _rotation(size, key[0].as_py()), floors, levels):
                row = array.order[row]
                parts.append((owners[i], row, (x[i] * vectors[row]).sum(axis=1)))
        return _best(*(np.concatenate(c) for c in zip(*parts, strict=True)), cls, ids, count)

    return run


def _scored(size: int, kind: str, count: int):
    """The best of all of a block's rows, by exact inner product."""

    def run(key, rows, queries):
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        cls, ids = (rows.column(c).to_numpy() for c in ("cls", "id"))
        if rows.num_rows and queries.num_rows:
            vectors = _matrix(rows.column("vector"), size, kind)
            for owner, x in zip(queries.column("cls").to_numpy(), _matrix(queries.column("vector"), size, kind), strict=True):
                score = (vectors * x).sum(axis=1)
                best = np.lexsort((ids, -score))[:count]
                parts.append((np.full(len(best), owner), best, score[best]))
        return _best(*(np.concatenate(c) for c in zip(*parts, strict=True)), cls, ids, count)

    return run


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            data = [flat[a:b].astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            norms = [float(np.sqrt((flat[a:b] ** 2).sum())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), batch.column("ids"), pa.array(data, pa.binary()), pa.array(norms, pa.float64())],
                names=["cls", "ids", "vector", "norm"],
            )

    return run


def classes(vectors: DataFrame, keep: int, kind: str) -> DataFrame:
    """(cls, ids, vector, norm): rows with equal vectors as one, with their ``keep`` smallest ids.

    ``vectors``: vec_id, embedding, cls. A hot vector's ids are cut down before the shuffle.
    """
    by = Win.partitionBy("cls").orderBy("vec_id")
    few = vectors.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= keep)
    one = few.groupBy("cls").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.max(F.when(F.col("rank") == 1, F.col("embedding"))).alias("embedding"))
    return one.mapInArrow(_packed(kind), "cls long, ids array<long>, vector binary, norm double")


def usable(table: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding, cls) that take part."""
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.filter("vec_id is not null and embedding is not null").filter(finite)
    good = good.filter(F.exists("embedding", lambda v: v != 0))
    common = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    size = common[0] if common else 0
    return good.filter(F.size("embedding") == size).withColumn("cls", F.xxhash64("embedding"))


def _placed(rows: DataFrame, big: DataFrame, arrays: int, slices: Column) -> DataFrame:
    """``rows`` (tree, node...) with the place of their array; ``slices``: those meant of a node with several."""
    large = F.broadcast(big) if big.count() <= BROADCAST_NODES else big
    own = F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(-1))).otherwise(slices)).alias("slice")
    met = rows.join(large, ["tree", "node"], "left").select(*rows.columns, own)
    alone = F.xxhash64("node", "slice")
    return met.withColumn("place", F.when(F.col("slice") < 0, F.pmod(F.xxhash64("node"), F.lit(arrays))).otherwise(alone)).drop("slice")


def ascend(met: DataFrame, wanted: int) -> DataFrame:
    """(cls, level, counted): the level at which all trees together have met ``wanted`` strings; null if none has.

    ``met``: cls, and in met the strings of one array by level.
    """
    totals = met.groupBy("cls").agg(*(F.sum(F.get("met", F.lit(i))).alias(f"m{i}") for i in range(LEVELS)))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("level"))

    def step(s, n):
        climbing = s["level"].isNull()
        total = F.when(climbing, s["n"] + n).otherwise(s["n"])
        reached = F.when(climbing & (total >= wanted), s["i"]).otherwise(s["level"])
        return F.struct((s["i"] + 1).alias("i"), total.alias("n"), reached.alias("level"))

    done = totals.select("cls", F.aggregate(F.array(*(f"m{i}" for i in range(LEVELS))), start, step).alias("s"))
    return done.select("cls", F.col("s.level").alias("level"), F.col("s.n").alias("counted"))


def search(table: DataFrame, is_query: Column, k: int = 20, node_rows: int = NODE_ROWS, counted: list[DataFrame] | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows of ``table`` (vec_id, embedding) where ``is_query`` holds.

    ``counted``, if given, gets the table (cls, level, counted) of the strings that each query's level holds.
    """
    spark = table.sparkSession
    vectors = usable(table)
    # vectors of floats are kept as such; all arithmetic is in double precision
    kind = "<f4" if dict(table.dtypes)["embedding"] == "array<float>" else "<f8"
    index = materialize(classes(vectors, k + 1, kind), "classes")
    facts = index.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.octet_length("vector"))).first()
    count, longest, size = facts[0], facts[1] or 1.0, (facts[2] or 0) // np.dtype(kind).itemsize or 1
    asked = materialize(vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query")).distinct(), "asked")
    heads = asked.select(F.col("query").alias("cls")).distinct().join(index.select("cls", "vector"), "cls")
    heads = materialize(heads, "heads")

    # the forest: sorted arrays of bounded size
    depth, arrays = depth_of(count, size, node_rows), max(1, -(-count // ARRAY_ROWS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-TREES * arrays // 16))
    strings = materialize(index.select("cls", F.get("ids", F.lit(0)).alias("id"), "vector", "norm").mapInArrow(_strings(size, kind, depth), _STRING), "strings")
    nodes = strings.groupBy("tree", "node").agg(F.ceil(F.count(F.lit(1)) / ARRAY_ROWS).cast("int").alias("slices"))
    big = materialize(nodes.filter("slices > 1"), "big")
    place = ["tree", "place"]
    one = F.array(F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int"))
    forest = _placed(strings, big, arrays, one).select(*place, "string", "cls", "id", "norm", "vector")
    forest = materialize(forest.repartition(parts, *place).sortWithinPartitions(*place, "string"), "forest")

    # descend every tree, and ascend all together
    descents = heads.mapInArrow(_descents(size, kind, depth), _DESCENT)
    routes = _placed(descents, big, arrays, F.sequence(F.lit(0), F.col("slices") - 1))
    routes = materialize(routes.groupBy("cls", *place).agg(F.min("floor").alias("floor")), "routes")
    comers = routes.join(heads, "cls")
    lists = forest.select(*place, "string", "norm").repartition(parts, *place).groupBy(*place)
    met = lists.cogroup(comers.select(*place, "cls", "floor", "vector").repartition(parts, *place).groupBy(*place))
    met = met.applyInArrow(_met(size, kind, depth, longest), "cls long, met array<long>")
    wanted = max(int(np.ceil(CANDIDATES * count**GROWTH)), TREES * (k + 1))
    levels = materialize(ascend(met, wanted), "levels")
    if counted is not None:
        counted.append(levels)
    comers = comers.join(levels.filter("level is not null").select("cls", "level"), "cls")
    near = forest.repartition(parts, *place).groupBy(*place)
    near = near.cogroup(comers.select(*place, "cls", "floor", "level", "vector").repartition(parts, *place).groupBy(*place))
    found = near.applyInArrow(_ranked(size, kind, depth, longest, k + 1), _FOUND)

    # queries without enough strings ascend to the root: in blocks, they see every row
    alone = materialize(heads.join(levels.filter("level is not null"), "cls", "left_anti"), "alone")
    if not alone.isEmpty():
        blocks = index.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(arrays)).cast("int")).select("block", "cls", F.get("ids", F.lit(0)).alias("id"), "vector")
        everywhere = alone.select("cls", "vector", F.explode(F.sequence(F.lit(0), F.lit(arrays - 1))).alias("block"))
        both = blocks.repartition(parts, "block").groupBy("block").cogroup(everywhere.repartition(parts, "block").groupBy("block"))
        found = found.union(both.applyInArrow(_scored(size, kind, k + 1), _FOUND))
    # a class with the k+1 best scores lasts, whichever of its ids do; only then it gets its ids back
    found = found.groupBy("query", "cls", "id").agg(F.max("score").alias("score"))
    best = Win.partitionBy("query").orderBy(F.col("score").desc(), "id")
    found = materialize(found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1), "found")
    found = found.join(index.select("cls", "ids"), "cls")
    pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id")))
    lists = found.groupBy("query").agg(F.flatten(F.collect_list(pairs)).alias("all"))
    lists = materialize(lists, "lists")
    out = asked.join(lists, "query")
    others = F.array_sort(F.filter("all", lambda p: p["vec_id"] != F.col("query_id")))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "near"))
    return out.select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("near.vec_id").alias("vec_id"),
        (-F.col("near.less")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
