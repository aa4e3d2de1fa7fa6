"""Every contract query beside SQL or a brute-force version, on small tables."""

import base64
import collections
import hashlib
import re

import numpy as np
import pytest

from shardloom.llm import registry, vector_forest
from shardloom.llm.quality import remainder

from .oracle import oracle_rows, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    assert rows(registry.QUERIES[name](spark, DIR)) == oracle_rows(DIR, registry.ORACLE_SQL[name])


def brute_components(texts: dict[int, str], width: int = 5, percent: int = 75):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i in sorted(texts):
        near = collections.Counter(j for s in sets[i] for j in held[s])
        for j, common in near.items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
        for s in sets[i]:
            held[s].append(i)
    least = {}
    for i in sorted(texts):
        least.setdefault(find(i), i)
    return {i: (len(sets[i]), least[find(i)]) for i in texts}


def test_near_dedup(spark, texts):
    expected = brute_components(texts)
    got = registry.QUERIES["op3_near_dedup"](spark, DIR).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(texts)


def test_substring_dedup(spark, texts):
    first = {}
    words = {i: WORD.findall(texts[i]) for i in sorted(texts)}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    expected = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.QUERIES["op6_substring_dedup"](spark, DIR).collect()}
    assert got == expected


def test_token_counts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = registry.QUERIES["op5_token_counts"](spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_quality_on_held_out_rows(spark):
    scored = registry.QUERIES["op8_quality"](spark, DIR)
    assert scored.count() == scored.select("doc_id").distinct().count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    held = scored.join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert scored.filter(remainder(scored["doc_id"]) == 0).filter("not held_out").isEmpty()
    assert scored.filter("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.3 as int)").isEmpty()


def neighbours(spark, directory, **options):
    """What a search finds, held to the exact scores and order; and the share of the true neighbours."""
    counted = []
    rows = spark.read.parquet(f"{directory}/embeddings.parquet")
    got = vector_forest.search(rows, rows["vec_id"] % 20 == 0, 20, counted=counted, **options).toPandas()
    table = rows.toPandas().sort_values("vec_id")
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    found = []
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21))
        assert np.allclose(mine.score, scores[np.searchsorted(ids, mine.vec_id)], atol=1e-12)
        assert list(mine.vec_id) == [v for _, v in sorted(zip(-mine.score, mine.vec_id, strict=True))]
        found.append(len({*best} & {*mine.vec_id}) / 20)
    levels = counted[0].toPandas()
    assert len(levels) == (ids % 20 == 0).sum()
    return np.mean(found), levels.counted.mean() / len(ids), levels.level.isna().sum()


def test_nearest_neighbours(spark):
    """The forest finds nine neighbours of ten among a tenth of the rows; none of the queries sees all rows."""
    recall, share, root = neighbours(spark, "/root/testdata/sf0.1")
    assert recall >= 0.9 and share < 0.1 and root == 0


def test_nearest_neighbours_of_nodes_named_by_two_characters(spark):
    recall, _, root = neighbours(spark, "/root/testdata/sf0.1", node_rows=8)
    assert recall >= 0.88 and root == 0


def test_nearest_neighbours_in_many_arrays(spark, monkeypatch):
    """Arrays of 100 rows, large nodes cut to slices: the same rows are met."""
    whole = neighbours(spark, DIR)
    monkeypatch.setattr(vector_forest, "ARRAY_ROWS", 100)
    assert neighbours(spark, DIR) == whole


def test_nearest_neighbours_at_the_root(spark, monkeypatch):
    """Queries that meet too few strings see every row."""
    monkeypatch.setattr(vector_forest, "CANDIDATES", 10**6)
    recall, _, root = neighbours(spark, DIR)
    assert recall == 1 and root == 25


def test_warc_of_equal_and_empty_payloads(spark, tmp_path):
    pages = [(5, "http://a", "x"), (2, "http://b", "x"), (9, None, None), (7, "u", ""), (1, "v\r\nw", "é" * 5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in registry.QUERIES["op1_warc"](spark, str(tmp_path)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 7), 7: ("response", None), 1: ("response", None),
    }
    assert got[1].payload_bytes == 10
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(("é" * 5).encode()).digest()).decode()
    assert got[5].payload_digest == got[2].payload_digest and all(r.intact for r in got.values())
