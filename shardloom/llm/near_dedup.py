"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of hash groups, A and B, are computed per document; table
keys are all pairs (A_i, B_j), so 2 * 12 groups of two minhashes stand in for
144 tables of four. Candidates are confirmed on the full shingle sets.

Steps, each ended by a written table:
1. One pass over the texts makes a sketch per document. Equal shingle sets fall
   into one class (a node); from here on only classes are compared.
2. An A or B group that only one class has is dropped before pairs are formed;
   keys are formed from the rest. Tables that hold the same classes count once.
3. Two classes in a table are a candidate pair. A larger table is cut into
   chunks; a maximum spanning tree over the sketches' agreement names the
   candidates of a chunk, so their number is linear in the table's size.
4. Candidates are confirmed, and links joined to components.
5. Every group of A that still holds several components is looked through for
   further pairs. Its rows are packed, up to 4096 to a row: rows outside its largest
   component meet each other and the largest component's, pack by pack, so a group of
   n rows makes (n / 4096)^2 packed rows and no task holds more than two packs. Sizes
   and sketches name the rows that may have a link; their full sets are packed by
   bytes, meet in the same way, and yield only confirmed links, of which each joins two
   components of its block: no more than rows in the block.

A pair at a Jaccard similarity of 0.75 shares a key with probability 0.9999, and
agrees on 24 of 48 sketch hashes with probability 0.9999.

Defined results: a document without words is linked with nothing and kept; one of
fewer words than the shingle length has its whole word sequence as one shingle;
a component's id leaves null ids out (one of null ids alone has a null id);
rows that share an id and a text fall into one class; a text of any length is handled
whole, alone in memory where it is longer than a slice; columns besides the id and the
text are not looked at, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import bound_batches, materialize

GROUPS = 12
ROWS = 2
HASHES = 2 * GROUPS * ROWS
#: Sketch hashes that must agree for a pair to be confirmed on its full sets.
AGREE = HASHES // 2
#: Text handled at once.
SLICE_BYTES = 2 << 20
#: Classes of a table whose spanning tree is built in one place.
CHUNK = 1024
#: Rows of a group, and bytes of their full sets, that are packed into one row.
PACK, PACK_BYTES = 4096, 2 << 20
#: Ids up to which a list of wanted documents is broadcast (64 MB); beyond it is joined by shuffle.
WANTED_BROADCAST = 4_000_000

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2**64, HASHES, np.uint64)
_MUL = _rng.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)

_SKETCH = "doc_id long, text_hash long, place long, n_shingles long, node long, groups array<long>, sketch binary"


def _shingles(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and where each text's begin."""
    vocabulary, codes, offsets = W.split(pc.ascii_lower(text))
    hashes = W.word_hashes(vocabulary)[codes]
    found, owner, _ = W.windows(hashes, offsets, width)
    lengths = np.diff(offsets)
    parts, owners = [found], [owner]
    for n in range(1, width):  # a short text is one shingle
        short = np.flatnonzero(lengths == n)
        if len(short):
            run = W.rolling(hashes[(offsets[short][:, None] + np.arange(n)).ravel()], n)[::n]
            parts.append(W.mix(run ^ np.uint64(n)))
            owners.append(short.astype(np.int32))
    found, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(found, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    found, owner = found[order], owner[order]
    if len(found):
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
        found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(lengths) + 1))


def _nodes(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The id of each non-empty set: a hash of its size and all its members."""
    one = np.add.reduceat(W.mix(found ^ np.uint64(0x5851F42D4C957F2D)), begin[:-1])
    two = np.add.reduceat(W.mix(found + np.uint64(0x14057B7EF767814F)), begin[:-1])
    return W.mix(one + W.mix(two + np.diff(begin).astype(np.uint64))).view(np.int64)


def _sketches(width: int):
    xor, mul = _XOR, _MUL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in W.slices(texts, SLICE_BYTES):
                found, begin = _shingles(texts.slice(a, b - a), width)
                sizes = np.diff(begin)
                full = np.flatnonzero(sizes)
                nodes = np.zeros(b - a, np.int64)
                groups = [None] * (b - a)
                sketches = [None] * (b - a)
                if len(full):
                    at = np.append(begin[full], len(found))
                    nodes[full] = _nodes(found, at)
                    least = np.empty((len(full), HASHES), np.uint64)
                    for k in range(HASHES):
                        least[:, k] = np.minimum.reduceat((found ^ xor[k]) * mul[k], at[:-1])
                    least = W.mix(least)
                    keys = W.mix(least[:, ::2] + W.mix(least[:, 1::2] + np.arange(HASHES // 2, dtype=np.uint64)))
                    low = least.astype(np.uint8)
                    for i, doc in enumerate(full):
                        groups[doc] = keys[i].view(np.int64)
                        sketches[doc] = low[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("text_hash").slice(a, b - a),
                        batch.column("place").slice(a, b - a),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.int64(), mask=sizes == 0),
                        pa.array(groups, pa.list_(pa.int64())),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "place", "n_shingles", "node", "groups", "sketch"],
                )
        pa.default_memory_pool().release_unused()

    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in W.slices(texts, SLICE_BYTES):
                found, begin = _shingles(texts.slice(a, b - a), width)
                full = np.flatnonzero(np.diff(begin))
                if len(full):
                    at = np.append(begin[full], len(found))
                    data = [found[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_nodes(found, at)), pa.array(data, pa.binary())], names=["node", "members"]
                    )
        pa.default_memory_pool().release_unused()

    return run


def _confirm(percent: int):
    """Links among candidate pairs that carry both full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_a, sets_b = batch.column("set_a"), batch.column("set_b")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(sets_a[i].as_buffer(), np.uint64)
                y = np.frombuffer(sets_b[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (_matrix(batch.column(c)) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str], key: str = "part") -> Iterator[dict[str, np.ndarray]]:
    """Rows that share ``key`` from rows sorted by it; one chunk is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and keys[a] != last:
                yield _columns(held, names)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield _columns(held, names)


def _columns(held: list[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([_values(name, x.column(name)) for x in held]) for name in names}


def _values(name: str, column: pa.Array) -> np.ndarray:
    if name == "sketch":
        return _matrix(column)
    if name == "groups":
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, GROUPS)
    if name == "members":
        return np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in column])
    return column.to_numpy(zero_copy_only=False)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    x = np.concatenate(a) if a else np.zeros(0, np.int64)
    y = np.concatenate(b) if b else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a maximum spanning tree of every chunk that agree on enough hashes."""
    left, right, held = [], [], 0
    for rows in _chunks(batches, ["node", "sketch"]):
        nodes, sketch = rows["node"], rows["sketch"]
        nodes, first = np.unique(nodes, return_index=True)
        sketch = sketch[first]
        best, parent = np.full(len(nodes), -1, np.int16), np.zeros(len(nodes), np.int64)
        open_ = np.ones(len(nodes), bool)
        at = 0
        ends, starts = [], []
        for _ in range(len(nodes) - 1):
            open_[at] = False
            agree = (sketch == sketch[at]).sum(1, dtype=np.int16)
            closer = open_ & (agree > best)
            best[closer] = agree[closer]
            parent[closer] = at
            at = int(np.argmax(np.where(open_, best, -2)))
            if best[at] >= AGREE:
                ends.append(at)
                starts.append(parent[at])
        if ends:
            left.append(nodes[starts])
            right.append(nodes[ends])
            held += len(ends)
        if held > 100_000:
            yield _pairs(left, right)
            left, right, held = [], [], 0
    yield _pairs(left, right)


#: What is packed of each row, and its kind.
_PACKED = {"node": "<i8", "root": "<i8", "size": "<i8", "sketch": "u1", "groups": "<i8", "members": "<u8"}
_PLACE = "key long, pos int, minor boolean, chunk long, minors long, majors long"


def _packs(names: tuple[str, ...]):
    """One row for the rows of a part: they share their place, and go by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = [c.split(" ")[0] for c in _PLACE.split(", ")]
        for rows in _chunks(batches, [*place, *names]):
            order = np.argsort(rows["size"], kind="stable")
            out = {n: pa.array(rows[n][:1]) for n in place}
            for n in names:
                if n == "members":
                    ends = np.cumsum(rows["size"])
                    data = b"".join(rows[n][ends[k] - rows["size"][k] : ends[k]].tobytes() for k in order)
                else:
                    data = np.ascontiguousarray(rows[n][order].astype(_PACKED[n])).tobytes()
                out[n] = pa.array([data], pa.binary())
            yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])
        pa.default_memory_pool().release_unused()

    return run


def _packed(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Blocks (block, own, a, b) of packed rows: pack a, of minor components, meets pack b of its group."""
    part = F.xxhash64("key", "minor", "chunk").alias("part")
    place = [c.split(" ")[0] for c in _PLACE.split(", ")]
    schema = f"{_PLACE}, {', '.join(f'{n} binary' for n in names)}"
    packs = _by_chunk(rows.select(part, *place, *names)).mapInArrow(_packs(names), schema)
    zero = F.lit(0).cast("long")

    def met(a, b):
        return F.struct(a.alias("a"), b.alias("b"))

    others = F.filter(F.sequence(zero, F.col("minors") - 1), lambda j: j != F.col("chunk"))
    others = F.transform(others, lambda j: met(F.least(j, "chunk"), F.greatest(j, "chunk")))
    majors = F.transform(F.sequence(zero, F.col("majors") - 1), lambda j: met(F.col("chunk"), F.col("minors") + j))
    minors = F.transform(F.sequence(zero, F.col("minors") - 1), lambda i: met(i, F.col("minors") + F.col("chunk")))
    blocks = packs.select(
        "key", "pos", "minors", F.when(F.col("minor"), F.col("chunk")).otherwise(F.col("minors") + F.col("chunk")).alias("own"), *names,
        F.inline(F.when(F.col("minor"), F.concat(others, majors)).otherwise(minors)),
    )
    return _by_chunk(blocks.withColumn("part", F.xxhash64("key", "a", "b")))


def _open(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, int, dict, dict, bool]]:
    """(key, pos, left, right, whether left also meets itself) of each block; a side can be without rows."""
    scalars = ["key", "pos", "minors", "own", "a", "b"]
    for block in _raw_chunks(batches, [*scalars, *names]):
        sides = []
        for own in (block["a"][0], block["b"][0]):
            at = block["own"].index(own) if own in block["own"] else None
            side = {}
            for n in names:
                flat = np.frombuffer(block[n][at] if at is not None else b"", _PACKED[n])
                side[n] = flat.reshape(-1, HASHES if n == "sketch" else GROUPS) if n in ("sketch", "groups") else flat
            sides.append(side)
        yield block["key"][0], block["pos"][0], *sides, block["b"][0] == block["minors"][0]


def _raw_chunks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, list]]:
    """Rows that share ``part`` as lists; one chunk is held at a time."""
    held: dict[str, list] = {}
    last = None
    for batch in batches:
        parts = batch.column("part").to_pylist()
        columns = {n: batch.column(n) for n in names}
        for i, part in enumerate(parts):
            if held and part != last:
                yield held
                held = {}
            last = part
            for n in names:
                value = columns[n][i]
                held.setdefault(n, []).append(value.as_buffer() if pa.types.is_binary(value.type) else value.as_py())
    if held:
        yield held


def _sized(size: int, sizes: np.ndarray, percent: int) -> tuple[int, int]:
    """Where sets of a size that leaves a link possible begin and end in ascending ``sizes``."""
    return int(np.searchsorted(sizes, -(-size * percent // 100))), int(np.searchsorted(sizes, size * 100 // percent, "right"))


def _near(left: dict, i: int, right: dict, first: int, percent: int) -> np.ndarray:
    """Rows of ``right``, from ``first`` on, of other components, of like sizes, whose sketches agree with row i's of ``left``."""
    a, b = _sized(int(left["size"][i]), right["size"], percent)
    a = max(a, first)
    if a >= b:
        return np.zeros(0, np.int64)
    agree = (right["sketch"][a:b] == left["sketch"][i]).sum(1) >= AGREE
    return a + np.flatnonzero(agree & (right["root"][a:b] != left["root"][i]))


_SKETCHED = ("node", "root", "size", "sketch")
_WHOLE = (*_SKETCHED, "groups", "members")


def _flagged(percent: int):
    """Per block, the rows that have a near row of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, left, right, own in _open(batches, _SKETCHED):
            here, there = np.zeros(len(left["node"]), bool), np.zeros(len(right["node"]), bool)
            for i in range(len(here)):
                if not (here[i] and there.all()):
                    near = _near(left, i, right, 0, percent)
                    there[near] = True
                    here[i] |= len(near) > 0
                if own and not (here[i] and here[i + 1 :].all()):
                    near = _near(left, i, left, i + 1, percent)
                    here[near] = True
                    here[i] |= len(near) > 0
            nodes = np.concatenate([left["node"][here], right["node"][there]])
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([nodes], pa.list_(pa.int64()))], names=["key", "nodes"])
        pa.default_memory_pool().release_unused()

    return run


def _across(percent: int):
    """Links of a block between different components, by the full sets; each joins two that are apart so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pos, left, right, own in _open(batches, _WHOLE):
            n = len(left["node"])
            both = {k: np.concatenate([left[k], right[k]]) for k in ("node", "root", "size", "members", "sketch", "groups")}
            _, both["root"] = np.unique(both["root"], return_inverse=True)
            vocabulary, flat = np.unique(both["members"], return_inverse=True)
            ends = np.cumsum(both["size"])
            begins, mark = ends - both["size"], np.zeros(len(vocabulary), bool)
            sides = {k: (both[k][:n], both[k][n:]) for k in ("root", "size", "sketch")}  # roots change in place
            left, right = ({k: sides[k][side] for k in sides} for side in (0, 1))
            out: list[tuple[int, int]] = []
            for i in range(n):
                near = n + _near(left, i, right, 0, percent)
                if own:
                    near = np.concatenate([_near(left, i, left, i + 1, percent), near])
                # pairs that an earlier group holds are its business
                near = near[~(both["groups"][near, :pos] == both["groups"][i, :pos]).any(1)]
                if not len(near):
                    continue
                mark[flat[begins[i] : ends[i]]] = True
                for j in near:
                    if both["root"][i] == both["root"][j]:
                        continue
                    common = int(np.count_nonzero(mark[flat[begins[j] : ends[j]]]))
                    if 100 * common >= percent * (int(both["size"][i] + both["size"][j]) - common):
                        out.append((both["node"][i], both["node"][j]))
                        both["root"][both["root"] == both["root"][j]] = both["root"][i]
                mark[flat[begins[i] : ends[i]]] = False
            del both, vocabulary, flat, sides, left, right
            if out:
                yield _pairs([np.array([a for a, _ in out])], [np.array([b for _, b in out])])
        pa.default_memory_pool().release_unused()

    return run


def _sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, members): the full shingle sets of ``nodes``, ascending."""
    wanted = materialize(nodes.distinct().join(reps.select("node", "place"), "node").select("place"), "wanted")
    texts = docs.select("place", "text")
    small = wanted.count() <= WANTED_BROADCAST
    texts = texts.join(F.broadcast(wanted) if small else wanted, "place", "left_semi").select("text")
    found = texts.mapInArrow(_set_rows(width), "node long, members binary")
    return materialize(found, "sets").dropDuplicates(["node"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs that the full sets confirm."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b"
    )
    return materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"), "links")


def near_dedup(
    docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: n_shingles, component_id (smallest id of its component), kept (it has that id) and text_hash."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # by which a text is found again: the id, or a hash of the text where there is none
    docs = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("place", F.coalesce("doc_id", "text_hash"))
    sketches = materialize(docs.mapInArrow(_sketches(width), _SKETCH), "sketches")
    full = sketches.filter("node is not null")
    reps = full.groupBy("node").agg(
        F.min("place").alias("place"), F.first("groups").alias("groups"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")
    )
    reps = materialize(reps, "reps")

    # 2. groups that at least two classes share, and the keys made of them
    each = reps.select("node", F.posexplode("groups").alias("pos", "value"))
    shared = each.groupBy("value").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = materialize(shared.filter("least < most").select("value"), "shared")
    held = each.join(shared, "value", "left_semi").groupBy("node")
    held = held.agg(
        F.collect_list(F.when(F.col("pos") < GROUPS, F.col("value"))).alias("left"),
        F.collect_list(F.when(F.col("pos") >= GROUPS, F.col("value"))).alias("right"),
    )
    keys = held.select("node", F.explode("left").alias("x"), "right").select(
        "node", F.explode(F.transform("right", lambda y: F.xxhash64("x", y))).alias("key")
    )
    keys = materialize(keys, "keys")
    tables = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum")
    )
    tables = tables.filter("a < b").groupBy("n", "a", "b", "sum").agg(F.min("key").alias("key"))
    tables = materialize(tables, "tables")

    # 3. candidates: the two classes of a table, or a spanning tree of each chunk of a larger one
    twos = tables.filter("n = 2").select("a", "b").distinct()
    left = reps.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = reps.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    twos = twos.join(left, "a").join(right, "b").mapInArrow(_agreeing, "a long, b long")
    larger = materialize(tables.filter("n > 2").select("key", F.ceil(F.col("n") / CHUNK).cast("long").alias("chunks")), "larger")
    members = keys.join(larger, "key").join(reps.select("node", "sketch"), "node")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node", "key"), F.col("chunks")))
    members = materialize(members, "members")
    trees = _by_chunk(members.select("node", "sketch", F.xxhash64("key", "chunk").alias("part")))
    trees = trees.mapInArrow(_trees, "a long, b long")
    tried = materialize(twos.union(trees).distinct(), "candidates")

    # 4. links and components so far
    nodes = tried.select(F.explode(F.array("a", "b")).alias("node"))
    links = _links(tried, _sets(docs, reps, nodes, width), percent)
    roots = components(links)

    # 5. A groups that hold several components
    labelled = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.slice("groups", 1, GROUPS).alias("groups")
    labelled = materialize(labelled.select("node", "root", F.col("n_shingles").alias("size"), "sketch", first), "labelled")
    rows = labelled.select("node", "root", F.posexplode("groups").alias("pos", "key"))
    counts = rows.groupBy("key", "pos", "root").agg(F.count(F.lit(1)).alias("rows")).groupBy("key", "pos").agg(
        F.max(F.struct("rows", "root")).getField("root").alias("major"),
        F.count(F.lit(1)).alias("roots"),
        F.ceil(F.max("rows") / PACK).cast("long").alias("majors"),
        F.ceil((F.sum("rows") - F.max("rows")) / PACK).cast("long").alias("minors"),
    )
    mixed = materialize(counts.filter("roots > 1").drop("roots"), "mixed")
    rest = _placed(rows.join(mixed, ["key", "pos"])).join(labelled.select("node", "size", "sketch"), "node")
    found = _packed(rest, _SKETCHED).mapInArrow(_flagged(percent), "key long, nodes array<long>")
    flagged = materialize(found.select("key", F.explode("nodes").alias("node")).distinct(), "flagged")
    sets = _sets(docs, reps, flagged.select("node"), width)
    rows = flagged.join(mixed.drop("majors", "minors"), "key").join(labelled, "node").join(sets, "node")
    minor = F.col("root") != F.col("major")
    volumes = flagged.join(mixed.select("key", "major"), "key").join(labelled.select("node", "root", "size"), "node")
    volumes = volumes.groupBy("key").agg(
        F.ceil(F.coalesce(F.sum(F.when(~minor, F.col("size") * 8)), F.lit(0)) / PACK_BYTES).cast("long").alias("majors"),
        F.ceil(F.coalesce(F.sum(F.when(minor, F.col("size") * 8)), F.lit(0)) / PACK_BYTES).cast("long").alias("minors"),
    )
    whole = _placed(rows.join(materialize(volumes, "volumes"), "key"))
    late = materialize(_packed(whole, _WHOLE).mapInArrow(_across(percent), "a long, b long").distinct(), "late")
    if not late.isEmpty():
        roots = components(links.union(late))

    grouped = sketches.select("doc_id", "text_hash", "n_shingles", "node").join(roots, "node", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "node"))
    least = grouped.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    least = materialize(least, "least")
    out = grouped.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_hash",
    )


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, root, major, minors, majors...) with the pack that each belongs to."""
    rows = rows.withColumn("minor", F.col("root") != F.col("major")).withColumn("majors", F.greatest("majors", F.lit(1).cast("long")))
    packs = F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("node", "key"), packs)).drop("major")


def _by_chunk(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "part").sortWithinPartitions("part")


def query(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return near_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS shingle
  FROM (SELECT *, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reached) AS component_id, min(reached) = d.doc_id AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""
