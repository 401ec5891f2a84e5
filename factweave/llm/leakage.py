"""P7: evaluation items that leak into training text.

Pigeonhole matching. An item of n words that may have k = floor(n/4) altered words is split into k+1 pieces; whatever copy of
it is left has at least one piece unaltered, and so does every run of 15 of its words. All pieces are searched at once in
the text's letters and digits (an Aho-Corasick automaton over the bounded item set), and each hit is verified: a run of
15 successive words by extending the hit, an altered copy by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import own_columns, ship

_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESCAPE = re.compile(r"\\+(?:[nrtbfv](?![a-zA-Z]*:\\)|(?=[\"'/\\]))")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--")
_LINK = re.compile(r"\]\((?:https?:|/|#)[^)\s]*\)")
_WORDS = re.compile(r"[^\W_]+")
_TRIM = re.compile("[­​-‏ -‮⁠-⁤﻿]")


def fold(text: str) -> list[str]:
    """The words of a text (runs of letters or digits) regardless of case, markup, escapes and odd white space."""
    if "\\" in text:
        text = _ESCAPE.sub(" ", _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text))
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _TRIM.sub("", text))
    return _WORDS.findall(text.casefold())


def myers(pattern: list, text: list) -> tuple[int, int]:
    """The least edit distance of the whole pattern to any part of the text, and where that part ends.

    Myers' bit-parallel scan in Hyyro's form; Python's integers serve as bit vectors of any length. Symbols may be of any kind.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, at = score, j
    return best, at


def pieces(n: int, run: int, share: float) -> list[tuple[int, int]]:
    """Word ranges that split an item of n words: more than it may have altered words, each short enough to lie within any run."""
    parts = max(n - -int(-(n * share) // 1) + 1, -(-n // max(1, (run + 1) // 2)))
    parts = min(parts, n)
    cuts = [round(i * n / parts) for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


@functools.lru_cache(maxsize=4096)
def _grams(text: str, q: int) -> tuple[str, ...]:
    return tuple(text[i : i + q] for i in range(len(text) - q + 1))


def shares_grams(text: str, window: str, budget: int) -> bool:
    """Whether a part of the window can be ``text`` with ``budget`` letters altered: each alters at most q of its runs of q letters."""
    for q in (4, 3):
        mine = _grams(text, q)
        need = len(mine) - q * budget
        if need > 0:
            theirs = {window[i : i + q] for i in range(len(window) - q + 1)}
            if sum(map(theirs.__contains__, mine)) < need:
                return False
    return True


class Matcher:
    """The automaton over the pieces of a block of items. ``items`` are (id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int, share: float):
        import ahocorasick

        self.run, self.share = run, share
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for key, words in items:
            if not words:
                continue
            stream, starts = "".join(words), [0]
            for w in words:
                starts.append(starts[-1] + len(w))
            for a, b in pieces(len(words), run, share):
                found.setdefault(stream[starts[a] : starts[b]], []).append((len(self.items), starts[b]))
            self.items.append((key, words, stream, starts))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        if found:
            self.auto.make_automaton()
        self.empty = not found

    def match(self, words: list[str]) -> list[tuple[int, str, float]]:
        """(item id, kind, share of its words) of each item that leaks: kind is run or altered."""
        if self.empty or not words:
            return []
        stream = "".join(words)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for end, (size, where) in self.auto.iter(stream):
            for item, place in where:
                hits.setdefault(item, []).append((end + 1, place, size))
        if not hits:
            return []
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w)
        edges = {*starts, at}
        out = []
        for item, places in hits.items():
            key, iwords, istream, istarts = self.items[item]
            longest = self._longest(stream, edges, istream, istarts, places)
            if longest >= min(self.run, len(iwords)):
                out.append((key, "run", longest / len(iwords)))
                continue
            share = self._altered(words, starts, iwords, istream, istarts, stream, places)
            if share >= self.share:
                out.append((key, "altered", share))
        return out

    def _longest(self, stream: str, edges: set[int], istream: str, istarts: list[int], places: list[tuple[int, int, int]]) -> int:
        """The most successive item words that stand in the text without a change, whatever separates them."""
        best, seen = 0, {}
        for end, place, size in places:
            shift = end - place
            if seen.get(shift, -1) >= place:
                continue
            a, b = place - size, place
            while a > 0 and a + shift > 0 and istream[a - 1] == stream[a - 1 + shift]:
                a -= 1
            while b < len(istream) and b + shift < len(stream) and istream[b] == stream[b + shift]:
                b += 1
            seen[shift] = b
            lo = next((i for i, s in enumerate(istarts) if s >= a and s + shift in edges), None)
            hi = next((i for i in range(len(istarts) - 1, -1, -1) if istarts[i] <= b and istarts[i] + shift in edges), None)
            if lo is not None and hi is not None and hi - lo > best:
                best = hi - lo
        return best

    def _altered(self, words: list[str], starts: list[int], iwords: list[str], istream: str, istarts: list[int], stream: str, places: list[tuple[int, int, int]]) -> float:
        """The largest share of the item's words that an alignment in one place keeps."""
        import bisect

        n, best = len(iwords), 0.0
        budget = n - -int(-(n * self.share) // 1)
        done: list[tuple[int, int]] = []
        for end, place, size in places:
            word = bisect.bisect_right(starts, end - size) - 1
            first = word - (bisect.bisect_right(istarts, place - size) - 1)
            lo, hi = max(0, first - budget), min(len(words), first + n + budget)
            if any(a <= lo and hi <= b for a, b in done):
                continue
            done.append((lo, hi))
            # Each altered word is an edit: a window that lacks more of the item's words than may be altered holds no copy.
            have = set(words[lo:hi])
            if sum(map(have.__contains__, iwords)) >= n - budget:
                distance, _ = myers(iwords, words[lo:hi])
                best = max(best, 1 - distance / n)
            if best < self.share:
                # Lost separators glue words together: compare letters, with a budget of a fifth of them.
                a, b = max(0, end - place - 40), min(len(stream), end - place + len(istream) + 40)
                window = stream[a:b]
                # Whatever is glued to them, the words that were not altered still stand there.
                if sum(w in window for w in iwords) < n - budget or not shares_grams(istream, window, len(istream) // 5):
                    continue
                letters, _ = myers(list(istream), list(window))
                if letters <= len(istream) / 5:
                    best = max(best, 1 - letters / len(istream))
        return best


@functools.lru_cache(maxsize=2)
def _matcher(items: tuple, run: int, share: float) -> Matcher:
    return Matcher([(k, list(w)) for k, w in items], run, share)


def item_blocks(items: DataFrame, key: str, text: str, block: int) -> Iterator[tuple]:
    """The items' words in blocks of bounded size, streamed through the driver one partition at a time."""
    part = []
    for k, t in own_columns(items, key, text).where(F.col(text).isNotNull()).dropDuplicates([key]).orderBy(key).toLocalIterator():
        words = tuple(fold(t))
        if words:
            part.append((k, words))
        if len(part) >= block:
            yield tuple(part)
            part = []
    if part:
        yield tuple(part)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", run: int = 15, share: float = 0.75, block: int = 20_000) -> DataFrame:
    """key, item_key, kind (run or altered), kept (share of the item's words found): one row per document row and item it carries.

    The items are a stated query set: they are read in blocks of ``block`` items, each sent to the executors and matched against
    all documents, so neither side's size is bounded by memory. Items of fewer than ``run`` words must stand there whole.
    Null and empty texts on either side match nothing; repeated document rows count each, repeated item ids once (the
    text that comes first). Whole texts are read. Extra columns are ignored; empty tables give no rows.
    """
    docs = own_columns(docs, key, text).where(F.col(text).isNotNull() & (F.col(text) != ""))
    types = f"{key} {docs.schema[key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}, kind string, kept double"
    sc = ship(docs.sparkSession).sparkContext
    found = None
    for part in item_blocks(items, item_key, item_text, block):
        shared = sc.broadcast(part)

        def match(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = _matcher(shared.value, run, share)
            for b in batches:
                rows = [(k, *hit) for k, t in b.itertuples(index=False, name=None) for hit in m.match(fold(t))]
                yield pd.DataFrame(rows, columns=[key, item_key, "kind", "kept"])

        one = docs.mapInPandas(match, types)
        found = one if found is None else found.unionByName(one)
    return docs.sparkSession.createDataFrame([], types) if found is None else found
