"""Removal of token windows that repeat across documents.

Every fixed-length window gets a Rabin-Karp hash. Rows are dealt evenly to blocks,
whatever their ids; each block sends one entry per distinct hash (the hash and the
smallest document id that has it there) to the bucket that owns the hash. A hot window
is thus one entry per block slice however many documents hold it. The bucket
answers only those blocks that hold the window in a later document than the
first one of all, and the block merges the repeated windows of each of its
documents into maximal removal intervals. Blocks and buckets grow in number with the
text, and both exchanges have a partition for each; a block's entries for a bucket
travel as one row, so there are at most as many rows as windows. Two texts count as
equal where their 64-bit window hashes are.

Defined results: null and empty text have no words; a null id counts as larger
than every other; rows that share an id are one document for the question
which is first, and each gets its own row; a text of any length is handled whole,
alone in memory where it is longer than a slice; columns besides the id and the text
are not looked at, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import bound_batches

#: Bytes of text in a block, which one task holds at a time.
BLOCK_BYTES = 8 << 20
_LAST = np.iinfo(np.int64).max

_REQUEST = "bucket int, block int, hashes binary, firsts binary"
_REPLY = "block int, hashes binary, firsts binary"
_RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string"


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, _LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _by_hash(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, where a new hash begins, and the smallest id of each. ``ids`` are ascending."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else order
    return order, new, ids[order[new]] if len(order) else ids[:0]


def _requests(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_block = batch.column("block").to_numpy(zero_copy_only=False)
            ids = _ids(batch.column("doc_id"))
            for block in np.unique(by_block):
                rows = np.flatnonzero(by_block == block)
                rows = rows[np.argsort(ids[rows], kind="stable")]
                text = batch.column("text").take(pa.array(rows))
                for a, b in W.slices(text):
                    vocabulary, codes, offsets = W.split(text.slice(a, b - a))
                    found, owner, _ = W.windows(W.word_hashes(vocabulary)[codes], offsets, width)
                    if not len(found):
                        continue
                    order, new, first = _by_hash(found, ids[rows[a:b]][owner])
                    distinct = found[order[new]]
                    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                    full = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full, pa.int32()),
                            pa.array(np.full(len(full), block), pa.int32()),
                            pa.array([W.pack_sorted(distinct[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()),
                            pa.array([W.pack(first[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()),
                        ],
                        names=["bucket", "block", "hashes", "firsts"],
                    )

    return run


def _replies(key, entries):
    """Answer for one bucket: who holds a window later than its first document."""
    hashes = [W.unpack_sorted(x) for x in entries.column("hashes").to_pylist()]
    blocks = np.repeat(entries.column("block").to_numpy(), [len(x) for x in hashes])
    firsts = np.concatenate([W.unpack(x) for x in entries.column("firsts").to_pylist()]).astype(np.int64)
    found = np.concatenate(hashes)
    del hashes
    order = np.argsort(found, kind="stable")
    found, firsts, blocks = found[order], firsts[order], blocks[order]
    new = np.concatenate([[True], found[1:] != found[:-1]])
    least = np.minimum.reduceat(firsts, np.flatnonzero(new))[np.cumsum(new) - 1]
    late = np.flatnonzero(firsts > least)
    late = late[np.argsort(blocks[late], kind="stable")]
    cuts = np.flatnonzero(np.diff(blocks[late], prepend=-1))
    parts = np.split(late, cuts[1:]) if len(late) else []
    return pa.table(
        {
            "block": pa.array([blocks[p[0]] for p in parts], pa.int32()),
            "hashes": pa.array([W.pack_sorted(found[p]) for p in parts], pa.binary()),
            "firsts": pa.array([W.pack(least[p]) for p in parts], pa.binary()),
        }
    )


def _finish(width: int):
    def run(key, docs, replies):
        docs = docs.combine_chunks()
        ids = _ids(docs.column("doc_id").combine_chunks() if docs.num_rows else pa.array([], pa.int64()))
        rows = np.argsort(ids, kind="stable")
        docs, ids = docs.take(pa.array(rows)), ids[rows]
        text = pa.concat_arrays(docs.column("text").chunks) if docs.num_rows else pa.array([], pa.string())
        vocabulary, codes, offsets = W.split(text)
        found, owner, start = W.windows(W.word_hashes(vocabulary)[codes], offsets, width)
        order, new, first = _by_hash(found, ids[owner])
        if replies.num_rows and len(order):
            known = np.concatenate([W.unpack_sorted(x) for x in replies.column("hashes").to_pylist()])
            least = np.concatenate([W.unpack(x) for x in replies.column("firsts").to_pylist()]).astype(np.int64)
            own = found[order[new]]
            at = np.searchsorted(own, known)
            np.minimum.at(first, at, least)  # every reply answers a window of this block
        late = np.zeros(len(order), bool)
        if len(order):
            group = np.zeros(len(order), np.int64)
            group[new[1:]] = 1
            late[order] = ids[owner[order]] > first[np.cumsum(group)]
        begin = start[late]
        cover = np.zeros(len(codes) + 1, np.int64)
        cover += np.bincount(begin, minlength=len(codes) + 1)[: len(codes) + 1]
        cover -= np.bincount(begin + width, minlength=len(codes) + 1)[: len(codes) + 1]
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[offsets]
        kept_at = offsets - removed
        kept_words = vocabulary.take(pa.array(codes[~gone]))
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_at, pa.int32()), kept_words), " ")
        # runs of removed words, cut at the borders of documents
        edge = np.zeros(len(codes) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], gone[:-1]])
        opens = np.flatnonzero(gone & (~before | edge[:-1]))
        after = np.concatenate([gone[1:], [False]])
        closes = np.flatnonzero(gone & (~after | edge[1:]))
        base = offsets[np.searchsorted(offsets, opens, side="right") - 1]
        spans = pa.StructArray.from_arrays(
            [pa.array(opens - base, pa.int32()), pa.array(closes + 1 - base, pa.int32())], names=["first", "last"]
        )
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array(np.diff(removed), pa.int64()),
                "removed": pa.ListArray.from_arrays(pa.array(np.searchsorted(opens, offsets), pa.int32()), spans),
                "kept": kept,
            }
        )

    return run


def substring_dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, removed words, removal intervals [first, last) in words, and the kept text.

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller id.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES)))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    blocks = docs.withColumn("block", block).repartition(n, "block")
    requests = blocks.mapInArrow(_requests(width, n), _REQUEST).repartition(n, "bucket")
    replies = requests.groupBy("bucket").applyInArrow(_replies, _REPLY).repartition(n, "block")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_finish(width), _RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return substring_dedup(table(spark, sf_dir, "documents"), 13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS words
  FROM (SELECT *, unnest(range(greatest(len(w) - 12, 0))) AS i FROM d)),
f AS (SELECT words, min(doc_id) AS first FROM x GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM x JOIN f USING (words) WHERE first < doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d)
  ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS c FROM gone GROUP BY 1) USING (doc_id) LEFT JOIN kept USING (doc_id)"""
