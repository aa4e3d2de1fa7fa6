"""Words, rolling hashes and packing, on any text; and what the native operators' plans hold."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.llm import mixing, pseudonyms, quality, registry, substring_dedup, warc
from shardloom.llm import words as W

TEXT = st.text(alphabet=st.sampled_from("ab \t\n\v\f\r\x00\x1f\x85\xa0é　"), max_size=30)


@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_split(texts):
    vocabulary, codes, offsets = W.split(pa.array(texts, pa.string()))
    found = vocabulary.take(pa.array(codes)).to_pylist()
    for i, text in enumerate(texts):
        assert found[offsets[i] : offsets[i + 1]] == re.findall(r"[^\x20\x09-\x0D]+", text or "")
    # a slice of a column has offsets of its own
    vocabulary, codes, offsets = W.split(pa.array(["x y", *texts], pa.string()).slice(1))
    assert offsets[0] == 0 and vocabulary.take(pa.array(codes)).to_pylist() == found


@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=5), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_windows_are_equal_where_their_words_are(texts, width):
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    flat = np.array([w for t in texts for w in t], np.int64)
    hashes = W.mix(flat.astype(np.uint64) + np.uint64(17))
    found, owner, start = W.windows(hashes, offsets, width)
    expected = [(i, offsets[i] + k, tuple(t[k : k + width])) for i, t in enumerate(texts) for k in range(len(t) - width + 1)]
    assert [(o, s) for o, s in zip(owner, start, strict=True)] == [(i, s) for i, s, _ in expected]
    by_words = {}
    for h, (_, _, words) in zip(found, expected, strict=True):
        assert by_words.setdefault(words, h) == h
    assert len(set(by_words.values())) == len(by_words)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(values):
    data = np.array(sorted(values), np.uint64)
    assert (W.unpack(W.pack(data)) == data).all() and (W.unpack_sorted(W.pack_sorted(data)) == data).all()


@given(st.lists(st.text(alphabet="ab", max_size=9), max_size=20), st.integers(1, 20))
def test_slices(texts, limit):
    found = list(W.slices(pa.array(texts, pa.string()), limit))
    assert [i for a, b in found for i in range(a, b)] == list(range(len(texts)))
    assert all(b - a == 1 or sum(map(len, texts[a:b])) <= limit for a, b in found)


@given(st.binary(max_size=60), st.integers(1, 40))
def test_chunks_never_hold_the_line_between_records(data, size):
    line = b"\r\n\r\nWARC/1.1\r\n"
    for payload in (data, data + line + data, line[4:] + data, line * 3):
        cuts = list(warc._cuts(memoryview(payload), size))
        assert b"".join(payload[a:b] for a, b in cuts) == payload
        assert all(b - a <= size and line not in b"\r\n\r\n" + payload[a:b] for a, b in cuts)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_pseudonyms", "op4_decontamination", "op9_mixing"])
def test_native_plans(spark, tables, name):
    assert not re.search("Python|Arrow|Pandas|MapIn|ExistingRDD|CartesianProduct", plan(registry.QUERIES[name](spark, tables)))


def test_pseudonyms_need_no_shuffle(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert "Exchange" not in plan(pseudonyms.pseudonymize(docs, "k"))


def test_texts_are_shuffled_once(spark, tables):
    """The blocks of substring dedup feed both of their readers from one exchange."""
    df = substring_dedup.query(spark, tables)
    df.collect()
    assert plan(df).count("ReusedExchange") >= 1


def test_shares_are_whole_and_go_to_siblings_first(spark):
    """A child that falls short leaves its rest to its siblings, and no token is lost."""
    leaves = [("a", "x", 10), ("a", "y", 100), ("b", "x", 1000), ("b", "z", 7)]
    df = spark.createDataFrame(leaves, "p string, q string, tokens long")
    got = {(r.p, r.q): r.budget for r in mixing.leaf_budgets(df, ["p", "q"], {"p": {"a": 3}, "q": {"x": 9}}, 200, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 83, ("b", "z"): 7}
    got = {(r.p, r.q): r.budget for r in mixing.leaf_budgets(df, ["p", "q"], {}, 101, 1).collect()}
    assert sum(got.values()) == 101 and got["a", "x"] == 10 and got["b", "z"] == 7
    got = {(r.p, r.q): r.budget for r in mixing.leaf_budgets(df, ["p", "q"], {}, 10**6, 2).collect()}
    assert got == {(p, q): 2 * n for p, q, n in leaves}
    with pytest.raises(ValueError):
        mixing.leaf_budgets(df, ["p", "q"], {"p": {"a": 0}}, 10, 1)


def test_rules_hold_alike_in_columns_and_in_arrays(spark, tables):
    """A model's column is the logistic sum of its rules as NumPy finds them."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    rows = quality.with_statistics(docs)
    x = np.array(rows.select(*(f"__{n}" for n in quality.NAMES)).collect(), float)
    rng = np.random.default_rng(0)
    model = quality.fit_rules(x, (x[:, 0] + 0.02 * rng.standard_normal(len(x)) > np.median(x[:, 0])).astype(float))
    assert len(model.rules) > 3
    total = model.bias + sum(w * quality.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    got = np.array([r.s for r in rows.select(model.column().alias("s")).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-total)), atol=1e-12)


def test_statistics_are_computed_once(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    kept = quality.keep_good(docs, labels)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2


def test_cards_and_accounts_keep_apart(spark):
    """No two valid numbers share a pseudonym, zeros and odd check digits included."""
    def luhn(d):
        return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    short = [f"{n:04}" for n in range(10_000) if luhn(f"{n:04}")]
    df = spark.createDataFrame([(c,) for c in short], "m string")
    for undo in (False, True):
        net = pseudonyms.Network("k", undo)
        got = {r.m: r.p for r in df.select("m", pseudonyms._card(net, F.col("m")).alias("p")).collect()}
        assert got["0000"] == "0000" and len(set(got.values())) == len(short) and set(got.values()) == set(short)
    odd = ["DE00370400440532013001", "DE98", "GB82WEST12345698765432"]
    accounts = [f"DE{k:02}3704004405320{n:05}" for k in range(100) for n in range(300)]
    plain = [a for a in accounts + odd if len(a) > 14 and int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1]
    df = spark.createDataFrame([(c,) for c in plain], "m string")
    got = {r.m: r.p for r in df.select("m", pseudonyms._iban(pseudonyms.Network("k"), F.col("m")).alias("p")).collect()}
    assert len(set(got.values())) == len(plain)
    assert {m[2:4] for m in plain} & {"00", "01", "99"} and all(got[m] == m for m in plain if m[2:4] in ("00", "01", "99"))
