"""Benchmark decontamination with a broadcast set of test n-grams.

Word windows of every benchmark item form a table of n-grams; their hashes alone are
broadcast while their counted rows stay under a bound, and joined by shuffle beyond it.
Every window of every document is looked up. The documents with hits, few, are read once
more, and each hit is held to the words of the n-gram itself; only then the items that
have the n-gram are added. All of it is DataFrame functions.

Defined results: null and empty text have no words; items without words and null
item ids are never hit; repeated rows each get a row; texts of any length are looked
through whole, in one row's memory, with work in proportion to their words; columns
besides the id and the text are carried along unread, whatever they are called; an
empty table gives an empty result, and an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: N-grams, 16 bytes each, up to which the benchmark's hashes are broadcast.
BROADCAST_WINDOWS = 2_000_000
#: Bytes up to which tables of documents with hits are broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-case words of a text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _starts(size: Column, length: int) -> Column:
    return F.when(size >= length, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))


def ngrams(benchmark: DataFrame, length: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(length, hash, gram, item): an item of fewer words is one n-gram of all of them."""
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("w"))
    items = items.withColumn("size", F.size("w")).filter("size > 0")
    found = F.when(F.col("size") >= length, F.transform(_starts(F.col("size"), length), lambda i: F.slice("w", i + 1, length))).otherwise(F.array("w"))
    each = items.select("item", F.explode(found).alias("g"))
    hashed = F.xxhash64(F.transform("g", lambda w: F.xxhash64(w)))
    return each.select(F.size("g").alias("length"), hashed.alias("hash"), F.array_join("g", " ").alias("gram"), "item").distinct()


def _small(table: DataFrame, size: Column) -> DataFrame:
    """``table``, to be broadcast if the sum of ``size`` over its rows allows."""
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def _hits(rows: DataFrame, benchmark: DataFrame, length: int) -> DataFrame:
    """(id, hash, spans, items) of the texts with verified hits. ``rows``: id, hash, text."""
    grams = materialize(ngrams(benchmark, length), "ngrams")
    keys = grams.select("length", F.col("hash").alias("key")).distinct()
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most `length` numbers
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_WINDOWS else keys

    # every window of every document
    hashes = rows.select("id", "hash", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))

    def windows(n: int) -> Column:
        return F.transform(
            _starts(F.size("h"), n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("length"), F.xxhash64(F.slice("h", i + 1, n)).alias("key"))
        )

    every = F.concat(*map(windows, lengths)) if lengths else F.expr("cast(array() as array<struct<pos:int,length:int,key:bigint>>)")
    met = hashes.select("id", "hash", F.inline(every)).join(keys, ["length", "key"])
    met = met.groupBy("id", "hash").agg(F.collect_set(F.struct("pos", "length")).alias("met"))
    met = materialize(met, "met")

    # hits are held to the words
    wanted = _small(met, F.size("met") * 16 + 32).select(F.col("id").alias("i"), F.col("hash").alias("x"), "met")
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("hash").eqNullSafe(F.col("x"))
    texts = rows.join(wanted, same).select("id", "hash", "met", words_of(F.col("text")).alias("w")).dropDuplicates(["id", "hash"])
    read = F.transform("met", lambda m: F.struct(m["pos"].alias("pos"), m["length"].alias("length"), F.array_join(F.slice("w", m["pos"] + 1, m["length"]), " ").alias("gram")))
    each = materialize(texts.select("id", "hash", F.inline(read)), "read")
    # a passage can be in a large share of all documents, so these are broadcast if their size allows
    owners = _small(grams.select("length", "gram", "item"), F.length("gram") + F.length("item") + 48)
    known = _small(grams.select("length", "gram").distinct(), F.length("gram") + 32)
    hits = each.join(known, ["length", "gram"], "left_semi")
    items = hits.select("id", "hash", "length", "gram").distinct().join(owners, ["length", "gram"]).groupBy("id", "hash")
    items = items.agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)))))
    spans = hits.groupBy("id", "hash").agg(covered.alias("at")).select("id", "hash", _runs("at").alias("spans"))
    spans = spans.select(F.col("id").alias("i"), F.col("hash").alias("x"), "spans")
    return items.join(spans, same).select("id", "hash", "spans", "items")


def _runs(name: str) -> Column:
    """Runs [first, last) of the ascending numbers of an array column."""
    at = F.col(name)
    first = F.filter(at, lambda p, k: (k == 0) | (F.get(at, k - 1) != p - 1))
    last = F.filter(at, lambda p, k: (k == F.size(at) - 1) | (F.get(at, k + 1) != p + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("last")))


def _marked(docs: DataFrame, benchmark: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, spans, items): all rows of ``docs``, with nulls where nothing is hit."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    hits = materialize(_hits(rows.select("id", "hash", "text"), benchmark, length), "hits")
    hits = _small(hits, F.size("spans") * 8 + F.length(F.array_join("items", "   ")) + 32)
    hits = hits.select(F.col("id").alias("i"), F.col("hash").alias("x"), "spans", "items")
    return rows.join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("x")), "left").select("row", "id", "text", "spans", "items")


def find_hits(
    docs: DataFrame, benchmark: DataFrame, length: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, spans (hit word runs [first, last)), items (ids as strings, sorted)."""
    met = _marked(docs.select(id_col, text_col), benchmark, length, id_col, text_col)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return met.select(
        F.col("id").alias("doc_id"),
        n_words(F.col("text")).alias("n_words"),
        F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,last:int>>)")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` (ascending); what stood between words stays."""
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), 1)

    def cut(gaps: Column, both: Column) -> Column:
        def part(k: Column) -> Column:
            before = F.coalesce(F.get(spans, k - 1)["last"], F.lit(0))
            first = F.coalesce(F.get(spans, k)["first"], F.size(both))
            last = F.coalesce(F.get(spans, k)["last"], F.size(both))
            return F.concat(F.slice(both, before + 1, first - before), F.slice(gaps, first + 1, last - first))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), part)), "")

    # gaps, and gaps with the word behind each, are made once
    made = F.transform(F.array(F.split(text, _WORD, -1)), lambda gaps: F.struct(gaps.alias("g"), F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))).alias("b")))
    return F.get(F.transform(made, lambda m: cut(m["g"], m["b"])), F.lit(0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 8, most_items: int = 1) -> DataFrame:
    """``docs`` without documents that hold windows of more than ``most_items`` items, and others without their hit words.

    ``docs``: doc_id, text and any other columns; n_chars, if there, follows the text.
    """
    met = _marked(docs, benchmark, length, "doc_id", "text")
    met = met.filter(F.coalesce(F.size("items"), F.lit(0)) <= most_items)
    left = F.when(F.col("spans").isNotNull(), without_spans(F.col("text"), F.col("spans")))
    met = met.select("row", left.alias("left"))
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["text"] = F.coalesce("left", columns["text"])
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.length("left").cast("long"), columns["n_chars"])
    return met.select(*(v.alias(c) for c, v in columns.items()))


def query(spark, sf_dir: str) -> DataFrame:
    from .store import table

    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 8)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(list_slice(w, i + 1, i + least(8, len(w))), ' ') AS gram
  FROM (SELECT *, unnest(range(greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT doc_id, i, n, item_id FROM x JOIN g USING (n, gram)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
