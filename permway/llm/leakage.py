"""Problem 7: passages of held-out test items in a corpus.

The items' words form a generalised suffix automaton. It is made on the driver
from blocks of items of a checked size, and every document streams through the
automaton of each block: after each word it knows the longest run of words that
ends there and occurs in an item. A passage lies within one item, so the blocks
together find what one automaton of all items would.
"""

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permway.llm.lookalike import _INVISIBLE_CLASS, transduce
from permway.sources.shared import staged

MIN_WORDS = 12
#: Characters of items in one automaton; building one took 26 bytes for each.
BLOCK_CHARS = 8_000_000
_ASCII = re.compile(r"[A-Za-z0-9]+")
_WORD = regex.compile(rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}{_INVISIBLE_CLASS}]*")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words (runs of letters and digits) of a text are."""
    return [m.span() for m in (_ASCII if text.isascii() else _WORD).finditer(text)]


def word_form(word: str) -> str:
    """A word in its one form of characters and without case."""
    return transduce(word).casefold()


class Automaton:
    """A suffix automaton over the words of many items.

    Most states have one way on and belong to one item, so these are columns of
    numbers; only the others have a dictionary.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.ids: dict[str, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])  # the first way on of each state
        self.ways: dict[int, dict[int, int]] = {}  # its other ways
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.item = array("i", [-1])  # the first item of each state, by its place in `item_ids`
        self.shared: dict[int, set[int]] = {}  # its other items
        self.min_words = min_words
        self.item_ids = [item_id for item_id, _ in items]
        for n, (_, text) in enumerate(items):
            last = 0
            for a, b in word_spans(text):
                word = self.ids.setdefault(word_form(text[a:b]), len(self.ids))
                last = self._extend(last, word)
                self._own(last, n)
        for v in sorted(range(len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0 and self.length[up] >= min_words:
                for n in self._items(v):
                    self._own(up, n)

    def _own(self, v: int, n: int) -> None:
        if self.item[v] < 0:
            self.item[v] = n
        elif self.item[v] != n:
            self.shared.setdefault(v, set()).add(n)

    def _items(self, v: int) -> list[int]:
        return [self.item[v], *self.shared.get(v, ())] if self.item[v] >= 0 else []

    def step(self, v: int, word: int) -> int:
        """The state after `word`, -1 if there is none."""
        if self.word[v] == word:
            return self.to[v]
        return self.ways[v].get(word, -1) if v in self.ways else -1

    def _lead(self, v: int, word: int, to: int) -> None:
        if self.word[v] in (-1, word):
            self.word[v], self.to[v] = word, to
        else:
            self.ways.setdefault(v, {})[word] = to

    def _new(self, length: int, link: int) -> int:
        for column, value in ((self.word, -1), (self.to, -1), (self.item, -1), (self.link, link), (self.length, length)):
            column.append(value)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of `q` for the runs that are one word longer than those of `p`."""
        copy = self._new(self.length[p] + 1, self.link[q])
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        if q in self.ways:
            self.ways[copy] = dict(self.ways[q])
        self.link[q] = copy
        while p >= 0 and self.step(p, word) == q:
            self._lead(p, word, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (q := self.step(last, word)) >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and self.step(p, word) < 0:
            self._lead(p, word, new)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, word)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def scan(self, words: list[int]) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """The longest shared run by item, and the spans of words (from, to) that lie in shared runs."""
        first, to, ways, links, lengths, least = self.word, self.to, self.ways, self.link, self.length, self.min_words
        none: dict[int, int] = {}
        v = run = 0
        best: dict[int, int] = {}
        spans: list[tuple[int, int]] = []
        for at, word in enumerate(words):
            if word < 0:
                v = run = 0
                continue
            while (w := to[v] if first[v] == word else ways.get(v, none).get(word, -1)) < 0 and v > 0:
                v = links[v]
                run = lengths[v]
            if w < 0:
                run = 0
                continue
            v, run = w, run + 1
            if run >= least:
                if spans and at + 1 - run <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], at + 1 - run), at + 1)
                else:
                    spans.append((at + 1 - run, at + 1))
                u, size = v, run
                while u > 0 and size >= least:
                    for n in self._items(u):
                        item = self.item_ids[n]
                        if best.get(item, 0) < size:
                            best[item] = size
                    u = links[u]
                    size = lengths[u]
        return best, spans


class Words:
    """Numbers the words of documents as the automaton does; -1 for words of no item."""

    def __init__(self, ids: dict[str, int], bound: int = 200_000):
        self.ids, self.bound = ids, bound
        self.known: dict[str, int] = {}

    def __call__(self, text: str, spans: list[tuple[int, int]]) -> list[int]:
        known, out = self.known, []
        for a, b in spans:
            word = text[a:b]
            n = known.get(word)
            if n is None:
                n = self.ids.get(word_form(word), -1)
                if len(known) >= self.bound:
                    known.clear()
                known[word] = n
            out.append(n)
        return out


def automata(eval_items: DataFrame, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> Iterator[Automaton]:
    """The automata of all items, in blocks of at most `block_chars` characters; a longer item is a block of its own. No item, no automaton."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in eval_items.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id").toLocalIterator():
        if block and size + len(r.text) > block_chars:
            yield Automaton(block, min_words)
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield Automaton(block, min_words)


def _scanned(documents: DataFrame, auto: Automaton, schema: str, emit) -> DataFrame:
    """`emit` adds rows of `schema` for each document, from its row, the places of its words and what the automaton finds."""
    sent = documents.sparkSession.sparkContext.broadcast(auto)
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = sent.value
        number = Words(auto.ids)
        for pdf in batches:
            rows: list[tuple] = []
            for row in pdf.itertuples(index=False):
                spans = word_spans(row.text)
                best, runs = auto.scan(number(row.text, spans))
                emit(rows, row, spans, best, runs)
            yield pd.DataFrame(rows, columns=names)

    return documents.mapInPandas(run, schema)


def leaks(documents: DataFrame, eval_items: DataFrame, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`doc_id, item_id, words`: documents and items that share `min_words` words in a row, with the longest run.

    Null and empty texts share nothing; every row of a repeated `doc_id` is
    read on its own. Documents stay where they are: one pass for each block of
    items, no shuffle.
    """
    schema = "doc_id bigint, item_id bigint, words int"

    def emit(rows, row, spans, best, runs):
        rows.extend((row.doc_id, i, n) for i, n in sorted(best.items()))

    docs = documents.where("text IS NOT NULL").select("doc_id", "text")
    found = [_scanned(docs, auto, schema, emit) for auto in automata(eval_items, min_words, block_chars)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def _cut(text: str, spans: list[tuple[int, int]], runs: list[tuple[int, int]], max_coverage: float) -> tuple[str, int, float]:
    """The text without the runs, which may overlap; the number of their words, and their share of all words."""
    joint: list[list[int]] = []
    for a, b in sorted(runs):
        if joint and a <= joint[-1][1]:
            joint[-1][1] = max(joint[-1][1], b)
        else:
            joint.append([a, b])
    hit = sum(b - a for a, b in joint)
    share = hit / len(spans) if spans else 0.0
    if share > max_coverage:
        return "", hit, share
    at, parts = 0, []
    for a, b in joint:
        parts.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*parts, text[at:]]), hit, share


def scrub(documents: DataFrame, eval_items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`doc_id, text, removed_words, coverage`: the documents without the passages of items.

    Every run of at least `min_words` shared words is cut out with what stands
    between its words. Where such runs cover more than `max_coverage` of the
    words, the whole text is (it comes out empty). With several blocks of items
    the runs of all are gathered first, block by block in a stored table.
    Documents with a null text are left out.
    """
    runs_type = "array<struct<a: int, b: int>>"
    marked = documents.where("text IS NOT NULL").select("doc_id", "text", F.array().cast(runs_type).alias("runs"))

    def gather(rows, row, spans, best, runs):
        rows.append((row.doc_id, row.text, [*((r["a"], r["b"]) for r in row.runs), *runs]))

    def finish(rows, row, spans, best, runs):
        rows.append((row.doc_id, *_cut(row.text, spans, [*((r["a"], r["b"]) for r in row.runs), *runs], max_coverage)))

    before = Automaton([], min_words)
    for n, auto in enumerate(automata(eval_items, min_words, block_chars)):
        if n:
            marked = staged(_scanned(marked, before, f"doc_id bigint, text string, runs {runs_type}", gather), "runs")
        before = auto
    return _scanned(marked, before, "doc_id bigint, text string, removed_words int, coverage double", finish)


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """p7_found: each document with each item that it leaks, once."""
    return leaks(documents, eval_items).select("doc_id", "item_id")
