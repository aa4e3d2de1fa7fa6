"""Each stage beside a brute-force version on its own input, and run() beside all of them."""

import re

import duckdb
import pytest

import corpus_pipeline
from shardloom.llm import mixing, quality
from shardloom.llm.store import materialize

from .test_contracts import LOWER, brute_components

DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def outputs(spark):
    """The rows before the first stage, and after each."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], DIR), name))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]
    for df in outputs[1:-1]:
        assert df.dtypes == outputs[0].dtypes
    assert set(outputs[0].columns) <= set(outputs[-1].columns)


def test_quality(spark, outputs):
    before, after = by_id(outputs[0]), by_id(outputs[1])
    good = {r.doc_id for r in quality.query(spark, DIR).filter("predicted = 1").collect()}
    assert set(after) == good and all(before[i] == r for i, r in after.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert sum(i in after for i, q in labels.items() if q) / sum(labels.values()) > 0.99


def test_dedup(outputs):
    before, after = by_id(outputs[1]), by_id(outputs[2])
    parts = brute_components({i: r.text or "" for i, r in before.items()})
    assert set(after) == {component for _, component in parts.values()}
    assert all(before[i] == r for i, r in after.items())


def test_decontamination(spark, outputs):
    before, after = by_id(outputs[2]), by_id(outputs[3])
    windows = {}
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = WORD.findall((r.text or "").translate(LOWER))
        for k in range(max(1, len(w) - 7)) if w else ():
            windows.setdefault(tuple(w[k : k + 8]), set()).add(r.item_id)
    sizes = {len(w) for w in windows}
    changed = 0
    for i, r in before.items():
        text = r.text or ""
        found = list(WORD.finditer(text))
        words = [m[0].translate(LOWER) for m in found]
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(words[k : k + n])]
        if len(items) > 1:
            assert i not in after
            continue
        for k in sorted(hit, reverse=True):
            text = text[: found[k].start()] + text[found[k].end() :]
        assert after[i].text == (text if hit else r.text)
        assert after[i].n_chars == (len(text) if hit else r.n_chars)
        changed += bool(hit)
    assert changed


def test_pii(outputs):
    before, after = by_id(outputs[3]), by_id(outputs[4])
    assert set(before) == set(after)
    private = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
    changed = 0
    for i, r in before.items():
        found = private.findall(r.text or "")
        assert not any(f in after[i].text for f in found)
        assert after[i].n_chars == (len(after[i].text) if after[i].text != r.text else r.n_chars)
        changed += r.text != after[i].text
    assert changed


def test_mixing(outputs, tmp_path):
    outputs[4].coalesce(1).write.parquet(f"{tmp_path}/documents")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    result = connection.sql(mixing.ORACLE_SQL)
    names = result.columns
    expected = {r[names.index("doc_id")]: r[names.index("copies")] for r in result.fetchall()}
    after = by_id(outputs[5])
    assert {i: r.copies for i, r in after.items()} == {i: n for i, n in expected.items() if n}
    before = by_id(outputs[4])
    assert all(before[i].text == r.text and before[i].source == r.source for i, r in after.items())


def test_run(spark, outputs):
    run = corpus_pipeline.run(spark, DIR)
    assert run.exceptAll(outputs[5]).isEmpty() and outputs[5].exceptAll(run).isEmpty()
    assert corpus_pipeline.ORACLE_SQL is None
