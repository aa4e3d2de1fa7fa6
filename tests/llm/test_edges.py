"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardloom.llm import decontamination, mixing, near_dedup, pseudonyms, quality, role_repair, substring_dedup, token_counts, vector_forest, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
BASE = "the quick brown fox jumps over the lazy dog and then runs far away from all of the other animals in the wood"
DOCS = [
    (1, BASE, "en", "a", len(BASE)),
    (2, BASE.upper(), "en", "a", len(BASE)),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "   \t\n", "en", "b", 5),
    (6, "one two", "de", None, 7),
    (7, "one two", "de", "c", 7),
    (8, LONG, "en", "a", len(LONG)),
    (8, LONG, "en", "a", len(LONG)),
    (None, BASE + " now", "en", "a", None),
    (9, "mail me: bob@example.com +1 (456) 555-2186", "en", "b", 42),
]
BENCHMARK = [(1, BASE), (2, "lazy dog and then runs far away from all"), (3, "one two"), (4, None), (5, ""), (None, "lazy dog")]
#: Names that the operators use for columns of their own.
CLASH = ["id", "hash", "text_", "met", "left", "w", "h", "pos", "length", "key_", "x", "i", "at", "domain", "item", "place", "part", "blocks", "cls", "stats", "rules", "chars", "gaps", "kinds_", "__found", "__made", "__words", "__text", "__id", "__hash", "__spans", "__items", "__left", "__symbols", "__kinds_", "n_words", "kept", "score", "text_hash", "block", "node", "spans", "items", "copies", "budget", "range", "order", "n_tokens", "row", "level_lang", "found", "words", "key", "doc", "predicted", "root", "size"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, None, 0), (None, 1, 1), (77, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def operators(benchmark, labels):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return {
        "pseudonyms": lambda d: pseudonyms.pseudonymize(d, "k", kinds_col="__kinds").select("doc_id", "text", "__kinds"),
        "near_dedup": near_dedup.near_dedup,
        "hits": lambda d: decontamination.find_hits(d, benchmark),
        "decontaminate": lambda d: decontamination.decontaminate(d, benchmark).select("doc_id", "text"),
        "tokens": lambda d: token_counts.prefix_counts(d, path),
        "substring": substring_dedup.substring_dedup,
        "quality": lambda d: quality.score_documents(d, labels),
        "keep_good": lambda d: quality.keep_good(d, labels).select("doc_id", "text"),
        "mixing": lambda d: mixing.mix_documents(d),
        "mixing_rows": lambda d: mixing.mix_documents(d, carry=True).select("id", "copies", "row.text"),
        **{f"stage_{n}": (lambda d, f=f: f(d.sparkSession, d, None)) for n, f in corpus_pipeline.STAGES if n in ("near_dedup", "pii")},
        "stage_mixing": lambda d: corpus_pipeline.mix(d.sparkSession, d, None).select("doc_id", "text"),
    }


NAMES = sorted(operators(None, None))


def key_rows(df):
    return sorted(map(tuple, df.select(*(c for c in df.columns if c not in CLASH or c in ("n_words", "spans", "items", "kept", "copies", "score", "predicted", "n_tokens"))).collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_any_rows(spark, docs, benchmark, labels, name):
    """All rows are handled, and columns with clashing names change nothing."""
    operator = operators(benchmark, labels)[name]
    plain = operator(docs)
    names = [c for c in plain.columns if c not in CLASH or name not in ("stage_near_dedup", "stage_pii")]
    other = operator(clashing(docs)).select(*names)
    assert sorted(map(repr, plain.select(*names).collect())) == sorted(map(repr, other.collect()))
    kept = {"keep_good", "decontaminate", "stage_near_dedup", "stage_mixing"}
    if name not in kept:
        assert plain.count() == len(DOCS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, benchmark, labels, name):
    assert operators(benchmark, labels)[name](docs.limit(0)).collect() == []


def test_near_dedup_values(docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()}
    n = len(BASE.split()) - 4
    assert got == {
        (1, n): (1, True), (2, n): (1, False), (None, n + 1): (1, False),
        (3, 0): (3, True), (4, 0): (4, True), (5, 0): (5, True),
        (6, 1): (6, True), (7, 1): (6, False), (8, 59_996): (8, True), (9, 2): (9, True),
    }


def test_substring_values(docs):
    got = {(r.doc_id, r.n_words): (r.n_removed, [tuple(s) for s in r.removed], r.kept) for r in substring_dedup.substring_dedup(docs).collect()}
    n = len(BASE.split())
    assert got[1, n] == (0, [], BASE)
    assert got[2, n] == (0, [], BASE.upper())
    assert got[None, n + 1] == (n, [(0, n)], "now")
    assert got[3, 0] == got[4, 0] == got[5, 0] == (0, [], "")
    assert got[8, 60_000] == (0, [], LONG)


def test_decontamination_values(docs, benchmark):
    got = {r.doc_id: r for r in decontamination.find_hits(docs, benchmark).collect()}
    assert got[1].items == ["1", "2"] and got[1].n_hit == got[1].n_words == 23 and [tuple(s) for s in got[1].spans] == [(0, 23)]
    assert got[2].items == ["1", "2"]
    assert got[6].items == ["3"] and got[6].n_hit == 2
    assert got[3].n_words == got[4].n_words == got[5].n_words == 0 and got[4].items == []
    assert got[8].n_words == 60_000 and got[8].n_hit == 0
    left = {r.doc_id: r.text for r in decontamination.decontaminate(docs, benchmark).collect()}
    assert set(left) == {3, 4, 5, 6, 7, 8, 9}
    assert left[6] == " " and left[5] == "   \t\n" and left[9] == DOCS[-1][1] and left[3] is None


def test_decontamination_without_items(spark, docs, benchmark):
    assert {r.n_hit for r in decontamination.find_hits(docs, benchmark.limit(0)).collect()} == {0}
    assert decontamination.decontaminate(docs, benchmark.limit(0)).count() == len(DOCS)


def test_span_removal_leaves_the_rest(spark):
    text = "Ääa, ONE-two three! four"
    spans = F.expr("array(struct(1 as first, 3 as last))")
    row = spark.createDataFrame([(text,)], "text string").select(decontamination.without_spans(F.col("text"), spans).alias("x")).first()
    assert row.x == "Ääa, - three! four"


def test_mixing_values(docs):
    got = mixing.mix_documents(docs).collect()
    total = sum(r.n_tokens for r in got)
    assert sum(r.n_tokens * r.copies for r in got) <= 0.6 * total
    assert all(0 <= r.copies <= mixing.MAX_EPOCHS for r in got)
    leaves = {(r.level_domain, r.level_lang, r.level_source): r.leaf_budget for r in got}
    assert sum(leaves.values()) == int(0.6 * total)


def test_quality_without_labels_of_both_kinds(docs, labels):
    for some, score in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0"), None)):
        scores = {round(r.score, 6) for r in quality.score_documents(docs, some).collect()}
        assert len(scores) == 1 and (score is None or scores == {score})


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, None, None), (1, 1, None, None), (None, None, "user", "q"), (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "assistant", "c")]
    got = role_repair.repair_roles(clashing(turns(spark, rows))).collect()
    def rendered(conv):
        return "".join(r.rendered for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.turn or 0, r.piece)))

    assert rendered(2) == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert rendered(None) == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert role_repair.repair_roles(turns(spark, rows).limit(0)).collect() == []


VECTORS = [
    (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
    (7, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 0.5]), (1, [1.0, 0.0]), (60, [0.5, -3.0]),
]


def test_vectors(spark):
    table = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    for df in (table, table.withColumns({c: F.lit(1) for c in ("cls", "tree", "first", "n", "ids", "query", "score", "chunk", "level")})):
        got = [tuple(r) for r in vector_forest.search(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
        assert got == [
            (0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 60, 0.5),
            (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 60, 0.5),
            (60, 1, 0, 0.5), (60, 2, 1, 0.5), (60, 3, 20, 0.5),
        ]
    assert vector_forest.search(table.limit(0), F.col("vec_id") % 20 == 0, 3).collect() == []


def test_warc_chunks(spark):
    """Chunks never hold the line between records, and digests go along with them."""
    line = b"\r\n\r\nWARC/1.1\r\n"
    payloads = [b"", b"WARC/1.1\r\nx", line * 50, b"a" * 1000 + line + b"\r\n\r\n", None, bytes(range(256)) * 40, b"\r\n" * 99, b"WA"]
    pages = spark.createDataFrame([(i, f"http://x/{i} \n" + "é" * 40_000 * (i == 1), p, "clash") for i, p in enumerate(payloads)], "page_id long, url string, payload binary, first_id string").withColumns({c: F.lit(1) for c in ("hash", "digest", "pk", "payload_bytes")})
    from shardloom.llm.store import new_path

    chunks = warc.chunk_table(pages, warc.plan_records(pages), size=64)
    path = new_path(spark, "warc")
    warc.write_archive(chunks, path)
    back = warc.read_chunks(spark, path)
    assert back.agg(F.max(F.octet_length("chunk"))).first()[0] <= 64
    got = {r.page_id: r for r in warc.read_records(back).collect()}
    assert len(got) == len(payloads) and all(r.intact for r in got.values())
    for i, p in enumerate(payloads):
        assert got[i].payload_bytes == len(p or b"")
        assert got[i].payload_digest == warc.base32(hashlib.sha1(p or b"").digest())
    joined = {}
    for r in back.orderBy("page_id", "chunk_no").collect():
        joined[r.page_id] = joined.get(r.page_id, b"") + bytes(r.chunk)
    assert joined == {i: (p or b"") if i != 4 else b"" for i, p in enumerate(payloads)}
    assert got[4].record_type == "revisit" and got[4].refers_to == 0
    empty = pages.limit(0)
    path = new_path(spark, "warc")
    warc.write_archive(warc.chunk_table(empty, warc.plan_records(empty)), path)
    assert warc.read_records(warc.read_chunks(spark, path)).collect() == []
