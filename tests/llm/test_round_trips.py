"""Pseudonyms undone, token counts of every prefix, and roles repaired, each beside the plain way."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shardloom.llm import pseudonyms, role_repair, token_counts

TEXTS = [
    "mail bob.Smith+7@mail2.example.com, x@y.org; a@b",
    "+1 (456) 555-2186 456-555-2186 1-456-555-2186 +1 (017) 555-7713 +1 (317) 055-7713 017-555-7713",
    "card 4012888888881881, 4012 8888 8888 1881 and 4012-8888-8888-1881 but 4012888888881882 0000000000000000",
    "ip 66.87.218.26 255.255.255.255 0.0.0.0; not 300.1.2.3, 01.2.3.4, 1.2.3, 1.2.3.4.5",
    "ssn 123-45-6789 899-99-9999; not 000-12-3456, 666-12-3456, 912-34-5678, 123-00-4567, 123-45-0000",
    "on 2024-02-29, 2024/02/29, 29.02.2024, 02/29/2024, 1900-01-01; not 2023-02-29, 31/12/1999, 1899-12-31, 2099-12-31",
    "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432; not DE88 3704 0044 0532 0130 00",
    "password=36fdea71d793cf922e token = \"4B579D3CEE1DCAF48E80DFD04D785E892FC7D365\" key: '12345678901234567890' 36fdea71d793cf922e",
    None,
    "",
]


@pytest.fixture(scope="module")
def replaced(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r.doc_id: r for r in pseudonyms.pseudonymize(df, "k", kinds_col="kinds").collect()}


def test_what_is_replaced(replaced):
    kinds = [replaced[i].kinds for i in range(len(TEXTS))]
    assert kinds == [["email"] * 2, ["phone"] * 5, ["card"] * 3, ["ip"] * 3, ["ssn"] * 2, ["date"] * 5, ["iban"] * 2, ["secret"] * 3, [], []]
    for text, row in zip(TEXTS, (replaced[i] for i in range(len(TEXTS))), strict=True):
        # the format stays, and so does what is not valid
        assert (text is None) == (row.text is None)
        if text and "ip " not in text:
            assert [c.isalnum() for c in text] == [c.isalnum() for c in row.text]
    assert replaced[4].text.partition(";")[2] == TEXTS[4].partition(";")[2]
    assert replaced[5].text.partition(";")[2] == TEXTS[5].partition(";")[2]
    assert replaced[3].text.partition(";")[2] == TEXTS[3].partition(";")[2]


def luhn(digits):
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_are_valid_and_link(replaced):
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", replaced[2].text)]
    assert len(set(cards[:3])) == 1 and luhn(cards[0]) and cards[0] != "4012888888881881" and cards[3:] == ["4012888888881882", "0" * 16]
    phones = [re.sub(r"\D", "", p)[-10:] for p in re.findall(r"(?:\+?1[ -])?\(?\d{3}\)?[ -]\d{3}-\d{4}", replaced[1].text)]
    assert phones[0] == phones[1] == phones[2] and phones[0][0] in "23456789" and phones[0][3] in "23456789"
    days = re.findall(r"[\d/.-]{10}", replaced[5].text)
    assert days[0].split("-") == days[1].split("/") == days[2].split(".")[::-1]
    for account in re.findall(r"[A-Z]{2}\d{2}[A-Z0-9 ]+?(?= [A-Z]|;|$)", replaced[6].text)[:2]:
        plain = account.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_undo(spark, replaced):
    df = spark.createDataFrame([(i, r.text) for i, r in replaced.items()], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymize(df, "k", undo=True).collect()} == dict(enumerate(TEXTS))
    assert {r.text for r in pseudonyms.pseudonymize(df, "other", undo=True).collect()} != set(TEXTS)


def test_undo_whole_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    there = pseudonyms.pseudonymize(docs, "k", kinds_col="kinds")
    assert there.filter("size(kinds) > 0").count() > 0
    back = pseudonyms.pseudonymize(there, "k", undo=True).select("doc_id", "text")
    assert back.exceptAll(docs).isEmpty() and docs.exceptAll(back).isEmpty()
    # documents without personal data stay as they are
    clean = there.filter("size(kinds) = 0").select("doc_id", "text")
    assert clean.exceptAll(docs).isEmpty()


def test_permutation_is_a_bijection(spark):
    net = pseudonyms.Network("k")
    pairs = spark.range(70).select(net.pair("x", F.col("id") % 7, F.floor(F.col("id") / 7), 7, 10).alias("p"))
    assert {tuple(r.p) for r in pairs.collect()} == set(itertools.product(range(7), range(10)))
    strings = spark.range(1000).select(net.digits("x", F.lpad(F.col("id").cast("string"), 3, "0")).alias("d"))
    assert {r.d for r in strings.collect()} == {f"{i:03}" for i in range(1000)}


ODD = [
    "", "a  b", "it's  <|endoftext|> x\n\n\ny", "é \u0085x", "x" * 1500, " " * 1500 + "a", "\n\t " * 400, "日本語 テスト 🎉🎉", "１２３ ² ½ ٣",
    "I'll we're 'r 'd<|endoftext|><|endoftext", "a\n\n b\n\n\n", "a\u3000\u3000b \u2028\u2028 c", "\u058ba\u058b \u058b", "x\x1c\x1dy  \x1c", "we'red you've 've  're_'s",
    "!<|endoftext|>!  <|endoftext|>", "a_ _b __", "ab" * 200,
]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def length(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_tables_of_odd_texts(counter, tokenizer):
    rng = random.Random(1)
    for text in ODD:
        width, steps = token_counts.packed(counter.table(text))
        found = token_counts.counts(steps, width)
        assert len(found) == len(text)
        for end in range(1, len(text) + 1) if len(text) < 100 else [rng.randint(1, len(text)) for _ in range(50)]:
            assert found[end - 1] == length(tokenizer, text[:end]) == token_counts.tokens_at(steps, end, width)


def test_tables_of_documents(spark, tokenizer):
    """The tables the query is made from: every prefix of short texts, some of each long one, and the whole text."""
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_counts.prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        text, found = texts[r.doc_id], token_counts.counts(r.steps, r.width)
        assert len(found) == len(text) and r.n_tokens == (found[-1] if text else 0)
        ends = range(1, len(text) + 1) if len(text) < 150 else [rng.randint(1, len(text)) for _ in range(4)] + [len(text)]
        assert all(found[e - 1] == length(tokenizer, text[:e]) for e in ends)


def test_truncation(spark, counter, tokenizer, tables):
    for text in [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").limit(20).collect()] + ODD[7:]:
        width, steps = token_counts.packed(counter.table(text))
        total = token_counts.tokens_at(steps, len(text), width)
        for budget in (0, 1, 2, 5, 50, total, total + 1):
            end = token_counts.fitting(steps, budget, width)
            assert length(tokenizer, text[:end]) <= budget and (end == len(text) or budget < total)
            later = range(end + 1, len(text) + 1) if len(text) < 100 else range(end + 1, min(end + 20, len(text) + 1))
            assert all(length(tokenizer, text[:e]) > budget for e in later)


def test_characters_are_classed_as_the_library_does(counter):
    text = "".join(map(chr, [*range(0x2000), 0xA7CE, 0x1C89, 0x10D40, 0x3FC3F]))
    assert counter._cut(text) == [text[a:b] for _, (a, b) in counter.cutter.pre_tokenize_str(text)]


def test_wide_tables(counter):
    steps = np.array([1, 300, -299])
    assert token_counts.packed(steps)[0] == 4 and list(token_counts.counts(token_counts.packed(steps)[1], 4)) == [1, 301, 2]


def cheapest(roles):
    """By trying everything."""
    best = [10**9]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + role_repair.closing(state))
            return
        change = role_repair.RELABEL if roles[i] in role_repair.ROLES else role_repair.RELABEL_UNKNOWN
        if state:
            go(i + 1, state, cost + role_repair.MERGE + (0 if role_repair.ROLES[state - 1] == roles[i] else change))
        for to in role_repair._NEXT[state]:
            go(i + 1, to, cost + (0 if role_repair.ROLES[to - 1] == roles[i] else change))
            go(i, to, cost + role_repair.INSERT)

    go(0, 0, 0)
    return best[0]


def test_cost_of_repairs():
    rng = random.Random(0)
    for n in range(1, 7):
        for _ in range(40):
            roles = [rng.choice(["system", "user", "assistant", "tool"]) for _ in range(n)]
            given = [role_repair.state_of(r) for r in roles]
            cost, _ = role_repair.forward(given, 0)
            total = min(c + role_repair.closing(s) for s, c in enumerate(cost))
            assert total == cheapest(roles)
            cut = rng.randint(0, n)
            runs = [[c for s in range(4) for c in role_repair.forward(part, s)[0]] for part in (given[:cut], given[cut:]) if part]
            assert role_repair.chain(runs)[0] == total


def test_repairs_are_legal_wherever_ranges_end(spark, monkeypatch):
    directory = "/root/testdata/sf0.01"
    got = []
    for size in (20_000, 7):
        monkeypatch.setattr(role_repair, "RANGE_TURNS", size)
        rows = role_repair.query(spark, directory).collect()
        got.append(sorted((r.conv_id, r.turn, r.piece, r.action, r.role, r.rendered) for r in rows))
    assert got[0] == got[1]
    texts = {}
    for conv, _, _, _, _, rendered in got[0]:
        texts[conv] = texts.get(conv, "") + rendered
    legal = re.compile(r"(?:<\|im_start\|>system\n.*?<\|im_end\|>\n)?(?:<\|im_start\|>user\n.*?<\|im_end\|>\n<\|im_start\|>assistant\n.*?<\|im_end\|>\n)+", re.DOTALL)
    assert all(legal.fullmatch(t) for t in texts.values())
    given = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{directory}/conversations.parquet").collect()}
    assert len(texts) == len({c for c, _ in given}) and all(text in texts[c] for (c, _), text in given.items())
