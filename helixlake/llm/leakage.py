"""Problem 8: passages of held-out test items inside documents.

The items' word sequences form one generalised suffix automaton.  Each document's words are streamed through it; the automaton's
state is at any moment the longest passage of any item that ends at the current word, so that one pass finds every shared passage,
whatever its length, in time proportional to the document.  The automaton has at most two states per item word, together about
``WORD_BYTES`` of memory, and travels in the task closure: ``leaks`` builds one for each ``MAX_ITEM_WORDS`` words of items and reads the
corpus once for each, so that test material of any size is searched with bounded memory.  The corpus is only streamed, never shuffled.

Words are runs of letters and digits in lower case, after mail transfer encodings and mark-up have been undone.  The subject isn't
searched.  Null or empty texts hold no words and leak nothing; items of fewer words than ``min_words`` can't leak; equal items are
all reported; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm import mail

#: A passage leaks from so many consecutive words on.
MIN_WORDS = 12
#: Share of a document's words inside leaked passages from which on the whole document is to be dropped.
MAX_COVERAGE = 0.5
#: Memory of an automaton per item word as measured, and words of one automaton (about 600 MB; an item is never cut).
WORD_BYTES = 1_500
MAX_ITEM_WORDS = 400_000
#: Characters of all items that the driver takes.
MAX_ITEM_CHARACTERS = 1 << 30
WORD = re.compile(r"[^\W_]+")


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the items of every state's passages."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int = MIN_WORDS) -> None:
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.items = [-1], [0], [set()]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                self.items[last].add(item)
        # A state's passages end wherever those of the states that link to it end.
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.items[self.link[v]] |= self.items[v]
        # The state that holds the passage of exactly min_words words among the suffixes of v's passages.
        self.head = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[v]
            self.head[v] = 0 if self.length[v] < min_words else v if self.length[up] < min_words else self.head[up]
        self.min_words = min_words

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """``(end, length, head)`` wherever at least ``min_words`` words up to ``end`` (excluded) stand in an item."""
        ids, nexts, links, lengths, least = self.ids, self.next, self.link, self.length, self.min_words
        v = n = 0
        for i, w in enumerate(words, 1):
            c = ids.get(w)
            if c is None:
                v = n = 0
                continue
            while c not in nexts[v]:
                v = links[v]
                if v < 0:
                    break
                n = lengths[v]
            if v < 0:
                v = n = 0
                continue
            v = nexts[v][c]
            n += 1
            if n >= least:
                # v may hold longer passages than the n words matched; those of n words end at the same places.
                yield i, n, self.head[v]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _automata(items: DataFrame, min_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of about ``MAX_ITEM_WORDS`` words each; one of no words if there are no items."""
    rows = items.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = rows.selectExpr("coalesce(sum(length(text)), 0) AS n").first()["n"]
    if size > MAX_ITEM_CHARACTERS:
        raise ValueError(f"{size} characters of test items; the driver takes {MAX_ITEM_CHARACTERS}")
    group: list[tuple[int, list[str]]] = []
    n = 0
    for r in rows.collect():
        words = words_of(r["text"])
        if group and n + len(words) > MAX_ITEM_WORDS:
            yield SuffixAutomaton(group, min_words)
            group, n = [], 0
        group.append((r["item_id"], words))
        n += len(words)
    yield SuffixAutomaton(group, min_words)


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, item_id, words, longest)``: each document with each item it leaks, its words inside the item's passages and the
    longest passage."""
    found = [_leaks(documents, a) for a in _automata(items, min_words)]
    # An item stands in one automaton, unless its id is given to several texts.
    out = reduce(DataFrame.unionByName, found)
    return out if len(found) == 1 else out.groupBy("doc_id", "item_id").agg(F.sum("words").alias("words"), F.max("longest").alias("longest"))


def _leaks(documents: DataFrame, automaton: SuffixAutomaton) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[int, list[int]] = {}
                for part in mail.decode(text)[1]:
                    upto: dict[int, int] = {}
                    for end, n, head in automaton.matches(words_of(part)):
                        for item in automaton.items[head]:
                            s = seen.setdefault(item, [0, 0])
                            s[0] += end - max(end - n, upto.get(item, 0))
                            s[1] = max(s[1], n)
                            upto[item] = end
                out += [(doc, item, *s) for item, s in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["doc_id", "item_id", "words", "longest"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, item_id long, words long, longest long")


def clean(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``(doc_id, n_words, n_leaked, coverage, dropped, text)`` of every document.

    ``text`` is the decoded body without the leaked passages; null if the document's coverage is over ``max_coverage`` (then
    ``dropped``) or its text is null.
    """
    first, *more = _automata(items, min_words)
    if more:
        raise ValueError(f"spans are removed for at most {MAX_ITEM_WORDS} words of test items; clean the result of one part of the items with the next")
    automaton = first
    names = ["doc_id", "n_words", "n_leaked", "coverage", "dropped", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = leaked = 0
                kept: list[str] = []
                for part in mail.decode(text)[1]:
                    low, at = part.lower(), 0
                    if len(low) != len(part):  # a few letters have a longer lower case: the text is cut in that form
                        part = low
                    spots = [m.span() for m in WORD.finditer(low)]
                    total += len(spots)
                    spans: list[list[int]] = []
                    for end, n, _ in automaton.matches([low[a:b] for a, b in spots]):
                        if spans and end - n <= spans[-1][1]:
                            spans[-1] = [min(end - n, spans[-1][0]), end]
                        else:
                            spans.append([end - n, end])
                    for a, b in spans:
                        leaked += b - a
                        kept.append(part[at : spots[a][0]])
                        at = spots[b - 1][1]
                    kept.append(part[at:])
                share = leaked / total if total else 0.0
                drop = share > max_coverage
                out.append((doc, total, leaked, share, drop, None if drop or text is None else "".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_leaked long, coverage double, dropped boolean, text string")
