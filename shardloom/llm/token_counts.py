"""Exact token counts of every prefix of a text, by dynamic programming.

The tokenizer cuts a text into words, each with the space before it, and merges bytes
within a word. For every prefix of a word there is one last token that stands next to
its predecessor as merging would leave the two, so the count of a prefix is that of a
shorter one plus one: a dynamic programme over a word's bytes gives all its counts, and
is run once for each different word. A text's table holds, for each of its characters,
by how much the count of the prefix that ends there differs from that of the one before;
running sums answer how many tokens any prefix has and which prefix fits a budget, and
the last of them is the count of the text. Nothing is encoded again.

A prefix is a text of its own. It differs from the whole text's words in three places,
where the table has the prefix's count: within white space that a word's own space
follows, within a contraction, and within a special token's string.

Defined results: null counts as the empty text, which has no tokens; repeated rows each
get a row; texts of any length are tabled whole, unbroken ones too; columns beyond the
two that are named are not looked at, whatever they are called; an empty table gives an
empty result. The string of a special token inside a text is that token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import bound_batches

# fixed values: the words of byte-level BPE (contractions; letters, digits or other characters behind one space; white
# space), and those contractions that are longer than two characters
_WORDS = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Words, and prefixes of words, whose counts a task remembers; beyond it it starts anew.
REMEMBERED = 500_000
#: Bytes beyond which the prefixes of a word are not remembered.
LONG_WORD = 40
#: A table's numbers have one byte, or four where one is too small.
_KINDS = {1: np.dtype("i1"), 4: np.dtype("<i4")}


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter:
    """Prefix tables under a byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        self.special = [t["content"] for t in spec["added_tokens"]]

        def plain(token: str) -> bytes:
            return bytes(byte_of[c] for c in token)

        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(pairs)}
        #: The two tokens that make a token, and how late.
        self.made = {a + b: (i, a, b) for (a, b), i in self.ranks.items()}
        if len(self.made) < len(self.ranks):
            raise ValueError("a token is made in two ways")
        self.vocabulary = {plain(t) for t in spec["model"]["vocab"] if t not in self.special}
        self.longest = max(map(len, self.vocabulary))
        self.tokens = ahocorasick.Automaton()
        for token in self.vocabulary:
            self.tokens.add_word(token.decode("latin-1"), len(token))
        self.tokens.make_automaton()
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.splitter = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = re.compile(_WORDS)
        self.gaps = re.compile(r"\s{2,}(?=\S)")
        self.known: set[str] = set()  # characters whose class is known, and those of another class in the library
        self.odd: set[str] = set()
        self.merged: dict[bytes, bool] = {}
        self.prefixes: dict[bytes, tuple[int, bytes]] = {}
        self.tables: dict[str, bytes | np.ndarray] = {}

    # one word

    def _merge(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stays(self, left: bytes, token: bytes) -> bool:
        """Whether merging makes ``token`` of its bytes, and leaves it beside ``left``."""
        whole = self.merged.get(token)
        if whole is None:
            whole = self.merged[token] = self._merge(token) == [token]
        return whole and (not left or self._apart(left, token))

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether no merge across the border of two tokens comes before those that make the two.

        The merges of both are taken back, the latest first; of two that are equal the left one came first.
        """
        ranks, made = self.ranks, self.made
        limit = len(ranks)
        while True:
            if ranks.get((left, right), limit) < limit:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def byte_counts(self, data: bytes) -> list[int]:
        """Token count of every prefix of one word's bytes, by dynamic programming."""
        if len(data) > LONG_WORD:
            return self._long_counts(data)
        counts, last, known = [0], [b""], self.prefixes
        for end in range(1, len(data) + 1):
            found = known.get(data[:end])  # words share their beginnings
            if found is None:
                for start in range(max(0, end - self.longest), end):
                    token = data[start:end]
                    if token in self.vocabulary and self._stays(last[start], token):
                        found = (counts[start] + 1, token)
                        break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
                if len(known) >= REMEMBERED:
                    known.clear()
                known[data[:end]] = found
            counts.append(found[0])
            last.append(found[1])
        return counts

    def _long_counts(self, data: bytes) -> list[int]:
        """The same for a word of any length, with the tokens that end at each byte from one pass over it."""
        counts, last, done = [0] * (len(data) + 1), [b""] * (len(data) + 1), 0
        for end, size in self.tokens.iter(data.decode("latin-1")):
            end += 1
            if end > done:
                token = data[end - size : end]
                if self._stays(last[end - size], token):
                    counts[end], last[end], done = counts[end - size] + 1, token, end
        return counts

    def _steps(self, word: str) -> bytes | np.ndarray:
        """By how much each character of a word changes the count."""
        known = self.tables.get(word)
        if known is not None:
            return known
        data = word.encode()
        counts = self.byte_counts(data)
        if len(data) != len(word):
            ends, at = [0], 0
            for c in word:
                at += len(c.encode())
                ends.append(at)
            counts = [counts[e] for e in ends]
        if word in _CONTRACTIONS:  # without its last letter it is two words
            counts[2] = counts[1] + self.byte_counts(word[1].encode())[-1]
        if len(data) < 128:
            out = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])  # noqa: B905
            if len(self.tables) >= REMEMBERED:
                self.tables.clear()
            self.tables[word] = out
            return out
        steps = np.diff(counts)
        return steps.astype(np.int8).tobytes() if -128 <= steps.min() and steps.max() <= 127 else steps

    def _total(self, word: str) -> int:
        steps = self._steps(word)
        return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64) if isinstance(steps, bytes) else steps.sum())

    # a text

    def _cut(self, text: str) -> list[str]:
        """The words of a text without special tokens, as the library cuts it."""
        characters = set(text)
        for c in characters.difference(self.known):
            probes = ("a" + c, "1" + c, "!" + c)
            if any([x[1] for x in self.cutter.pre_tokenize_str(p)] != [m.span() for m in self.words.finditer(p)] for p in probes):
                self.odd.add(c)
            self.known.add(c)
        if self.odd.isdisjoint(characters):
            return self.words.findall(text)
        # characters that the pattern puts into another class than the library does
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def _plain(self, text: str) -> np.ndarray:
        """The table of a text in which special tokens don't count."""
        get = self.tables.get
        parts = [get(w) or self._steps(w) for w in self._cut(text)]
        try:
            steps = np.frombuffer(bytearray().join(parts), np.int8)
        except TypeError:
            steps = np.concatenate([np.frombuffer(p, np.int8) if isinstance(p, bytes) else p for p in parts])
        # white space before a word's own: a prefix that ends with all of it ends with one word
        for m in self.gaps.finditer(text):
            run = m[0]
            more = self._total(run) - self._total(run[:-1]) - self._total(run[-1])
            if more:
                at = m.end() - 1
                if steps.dtype == np.int8 and max(abs(steps[at].item() + more), abs(steps[at + 1].item() - more)) > 127:
                    steps = steps.astype(np.int64)
                steps[at] += more
                steps[at + 1] -= more
        return steps

    def table(self, text: str | None) -> np.ndarray:
        """By how much each character of a text changes the count of the prefix that ends with it."""
        if not text:
            return np.zeros(0, np.int8)
        if self.splitter is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.splitter.finditer(text):
            # up to its last character a special token is plain text behind what comes before it
            before = self._plain(text[at : m.end() - 1]).astype(np.int64)
            whole = before[: m.start() - at].sum() + 1
            out.append(np.append(before, whole - before.sum()))
            at = m.end()
        out.append(self._plain(text[at:]).astype(np.int64) if at < len(text) else np.zeros(0, np.int64))
        return np.concatenate(out)


def packed(table: np.ndarray) -> tuple[int, bytes]:
    """A table's width in bytes a number, and its bytes."""
    small = not len(table) or -128 <= table.min() and table.max() <= 127
    width = 1 if small else 4
    return width, table.astype(_KINDS[width]).tobytes()


def counts(steps: bytes, width: int = 1) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters, from a packed table."""
    return np.cumsum(np.frombuffer(steps, _KINDS[width]), dtype=np.int64)


def tokens_at(steps: bytes, end: int, width: int = 1) -> int:
    """Tokens of the prefix of ``end`` characters."""
    return int(np.frombuffer(steps, _KINDS[width])[:end].sum(dtype=np.int64))


def fitting(steps: bytes, budget: int, width: int = 1) -> int:
    """Characters of the longest prefix that has ``budget`` tokens at most."""
    fits = np.flatnonzero(counts(steps, width) <= budget)
    return int(fits[-1]) + 1 if len(fits) and budget > 0 else 0


def _tables(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path)
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            for a, b in W.slices(texts):
                tables = [counter.table(x.as_py()) for x in texts.slice(a, b - a)]
                both = [packed(t) for t in tables]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        sizes.slice(a, b - a),
                        pa.array([int(t.sum(dtype=np.int64)) for t in tables], pa.int64()),
                        pa.array([w for w, _ in both], pa.int32()),
                        pa.array([s for _, s in both], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "width", "steps"],
                )

    return run


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, and the prefix table: steps, of ``width`` bytes a character.

    ``path`` is the vocabulary file of the tokenizer, on every executor.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_tables(path), "doc_id long, n_bytes long, n_tokens long, width int, steps binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .store import table

    tables = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tables.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
