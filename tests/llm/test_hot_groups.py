"""Large groups of rows that are alike but not linked."""

import collections
import random

import pytest

import corpus_pipeline
from shardloom.llm import near_dedup

CORE = " ".join(f"core{i}" for i in range(40))


@pytest.fixture(scope="module")
def texts():
    """1500 documents with a similarity of 0.64 each, of which the first 200 are pairs that are near copies."""
    rng = random.Random(4)
    out = []
    for i in range(1500):
        tail = [f"w{rng.randrange(10**9)}" for _ in range(10)]
        if i < 200 and i % 2:
            tail = [*out[-1].split()[-10:-1], tail[0]]
        out.append(f"{CORE} {' '.join(tail)}")
    return out


def test_group_of_unlinked_members(spark, texts, monkeypatch):
    """Every link is found, and what is written on the way is in proportion to the group."""
    written = collections.Counter()
    plain = near_dedup.materialize

    def counted(df, name):
        out = plain(df, name)
        written[name] += out.count()
        return out

    packed = near_dedup._packed

    def counted_packs(rows, names):
        out = packed(rows, names)
        written["blocks"] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    monkeypatch.setattr(near_dedup, "_packed", counted_packs)
    monkeypatch.setattr(near_dedup, "PACK", 200)
    monkeypatch.setattr(near_dedup, "PACK_BYTES", 100_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    assert got == {i: i - i % 2 if i < 200 else i for i in range(len(texts))}
    assert written["blocks"] > 100 and sum(written[n] for n in ("blocks", "flagged", "late", "candidates")) < 20 * len(texts)


def test_repeated_rows_stay_once(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (3, None), (4, ""), (None, "x y"), (None, "x y"), (5, "q r s"), (5, "t u v")]
    got = corpus_pipeline.dedup(spark, spark.createDataFrame(rows, schema), None).collect()
    assert sorted(map(tuple, got), key=repr) == sorted({*rows} - {(2, "a b c")}, key=repr)


def test_columns_of_the_mix(spark):
    rows = [(i, f"a b c {i}", "en", "s", 7, "mine", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, domain string, copies int")
    got = corpus_pipeline.mix(spark, docs, None)
    assert got.columns == [*docs.columns, "_domain", "n_tokens", "_copies"]
    assert {(r.domain, r.copies, r.n_tokens) for r in got.collect()} == {("mine", 1, 4)}


def test_pairs_about_the_threshold(spark):
    """Pairs at a similarity of 0.72, 0.75 and 0.78: those from 0.75 on are linked, each of them."""
    rng = random.Random(9)
    rows, expected = [], {}
    for i in range(900):
        words = [f"v{rng.randrange(10**9)}" for _ in range(60)]
        t = 7 + i % 3  # of 56 shingles t are others
        copy = words[:-t] + [f"u{rng.randrange(10**9)}" for _ in range(t)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        expected |= {2 * i: 2 * i, 2 * i + 1: 2 * i if 100 * (56 - t) >= 75 * (56 + t) else 2 * i + 1}
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
