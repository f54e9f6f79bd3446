"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

WORD = re.compile(r"\w+")
#: Characters of benchmark items that a task holds at a time; a larger benchmark is taken in several passes.
BLOCK_CHARS = 4_000_000
#: What an item counts beside its characters, so that very many short items make blocks too.
ITEM_CHARS = 32
#: Shared q-grams of a text and a block that are looked at together, so that memory stays bounded on very long texts.
BLOCK_HITS = 1 << 20


@dataclass(frozen=True)
class Budget:
    """An item of m characters may differ by rate * m edits, or as many as leave it a shared q-gram, if that is less.

    A place counts wherever it is, within words too; with whole_words only where no word character of the plain text
    adjoins it, whatever the item's length. Scripts without spaces have no such places inside a sentence.
    """

    q: int = 9
    rate: float = 0.08
    whole_words: bool = False

    def edits(self, m: int) -> int:
        return max(0, min(int(self.rate * m), (m - self.q) // self.q))

    def shared(self, m: int) -> int:
        """The q-gram lemma: so many q-grams at least are shared with any text within the edit budget."""
        return m + 1 - self.q * (self.edits(m) + 1)


def plain(text: str | None) -> str:
    """Lower case, words only, one space between them: edits count on this."""
    return " ".join(WORD.findall((text or "").lower()))


def gram_hashes(text: str, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < q:
        return np.empty(0, np.uint64)
    n = len(codes) - q + 1
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[k : k + n]
    return out ^ (out >> np.uint64(29))


def run_length(a: str, i: int, b: str, j: int) -> int:
    """How many characters of a from i and of b from j on are the same."""
    most, done, step = min(len(a) - i, len(b) - j), 0, 16
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return done


def banded_alignment(item: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of item in text with at most budget edits, on diagonals low to high.

    Furthest-reaching points: for each number of edits and each diagonal (place in text minus place in item), how
    far into the item an alignment gets. The start is free, so all diagonals of the band start at no cost.
    """
    m, n = len(item), len(text)
    reach: dict[int, tuple[int, int]] = {}
    for edits in range(budget + 1):
        now: dict[int, tuple[int, int]] = {}
        best: tuple[int, int, int] | None = None
        for d in range(low - budget, high + budget + 1):
            options = [(0, d)] if edits == 0 and 0 <= d <= n and low <= d <= high else []
            if d in reach:
                options.append((reach[d][0] + 1, reach[d][1]))
            if d - 1 in reach:
                options.append(reach[d - 1])
            if d + 1 in reach:
                options.append((reach[d + 1][0] + 1, reach[d + 1][1]))
            options = [(min(r, m, n - d), o) for r, o in options if r >= 0 and 0 <= d + min(r, m, n - d) <= n]
            if not options:
                continue
            r, origin = max(options)
            if r < 0:
                continue
            r += run_length(item, r, text, r + d)
            now[d] = (r, origin)
            if r >= m and (best is None or origin < best[1]):
                best = (edits, origin, m + d)
        if best:
            return best
        reach = now
    return None


class Index:
    """Benchmark items by their q-grams; items of less than q characters by themselves, by length."""

    def __init__(self, items: list[tuple[int, str]], budget: Budget):
        self.budget, self.items, by_length = budget, [], {}
        for number, text in items:
            words = plain(text)
            if len(words) >= budget.q:
                self.items.append((number, words))
            elif words:
                by_length.setdefault(len(words), {}).setdefault(words, []).append(number)
        self.short = {n: (of, np.sort([gram_hashes(w, n)[0] for w in of])) for n, of in by_length.items()}
        hashes = [gram_hashes(t, budget.q) for _, t in self.items]
        which = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.empty(0, int)])
        grams = np.concatenate([*hashes, np.empty(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.grams, self.which, self.place = grams[order], which[order].astype(np.int64), place[order].astype(np.int64)
        self.width = np.array([budget.edits(len(t)) + 1 for _, t in self.items], np.int64)
        self.least = np.array([budget.shared(len(t)) for _, t in self.items], np.int64)
        self.bits = max(16, int(max(1, len(grams)) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)  # rules nearly all other q-grams out at the cost of one look
        self.seen[self.grams >> np.uint64(64 - self.bits)] = True

    def regions(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of each band that shares as many q-grams as the lemma asks for.

        Bands are of twice the width, one beginning in the middle of the last: every run of `width` diagonals lies in
        one. Shared q-grams are counted by (item, band) in sorted order, a block of the text after another.
        """
        grams = gram_hashes(text, self.budget.q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(64 - self.bits)])
        first, last = np.searchsorted(self.grams, grams[at], "left"), np.searchsorted(self.grams, grams[at], "right")
        n = last - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        if not len(at):
            return
        item_at, zero = 1 << 36, 1 << 35  # an item's bands are numbered around zero
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for block in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // BLOCK_HITS)) + 1):
            k = n[block]
            entry = np.repeat(first[block] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
            which = self.which[entry]
            low = np.floor_divide(np.repeat(at[block], k) - self.place[entry], self.width[which])
            key = which * item_at + (low + zero)
            keys, of = np.unique(np.r_[keys, key, key - 1], return_inverse=True)
            counts = np.bincount(of, np.r_[counts, np.ones(2 * len(key), np.int64)], len(keys)).astype(np.int64)
        for key in keys[counts >= self.least[keys // item_at]].tolist():
            item, band = key // item_at, key % item_at - zero
            width = int(self.width[item])
            yield item, band * width, (band + 2) * width - 1

    def short_places(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item number, start, end) of each place of an item of less than q characters."""
        for n, (of, hashes) in self.short.items():
            grams = gram_hashes(text, n)
            at = np.searchsorted(hashes, grams)
            for i in np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == grams).tolist():
                for number in of.get(text[i : i + n], ()):
                    yield number, i, i + n

    def counts(self, text: str, start: int, end: int) -> bool:
        return not self.budget.whole_words or text[start - 1 : start] in ("", " ") and text[end : end + 1] in ("", " ")

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, edits, start, end) of each place of an item in text; of places that overlap, the one with the least edits."""
        places: dict[int, set[tuple[int, int, int]]] = {}
        for number, start, end in self.short_places(text):
            places.setdefault(number, set()).add((0, start, end))
        for item, low, high in self.regions(text):
            number, words = self.items[item]
            budget = self.budget.edits(len(words))
            start = max(0, low - budget)
            piece = text[start : high + len(words) + budget + 1]
            if not budget:
                places.setdefault(number, set()).update((0, d, d + len(words)) for d in range(max(0, low), high + 1) if text.startswith(words, d))
            elif found := banded_alignment(words, piece, low - start, high - start, budget):
                places.setdefault(number, set()).add((found[0], found[1] + start, found[2] + start))
        for number, found_at in places.items():
            kept: list[tuple[int, int, int]] = []  # by start; none overlaps another
            for edits, start, end in sorted(x for x in found_at if self.counts(text, x[1], x[2])):
                k = bisect_left(kept, (start,))
                if (k == 0 or kept[k - 1][1] <= start) and (k == len(kept) or end <= kept[k][0]):
                    kept.insert(k, (start, end, edits))
            for start, end, edits in kept:
                yield number, edits, start, end




def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items with text and the block of each, and the number of blocks."""
    items = benchmark.select("item_id", "text").where("length(text) > 0")
    chars = items.agg(F.sum(F.length("text") + ITEM_CHARS)).first()[0] or 0
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    return items.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks))), n_blocks


def _finder(items: DataFrame, block: int, budget: Budget) -> tuple:
    """A function of a text column: the items of a block that it holds; and the broadcast of the block, whose size is bounded."""
    rows = [(r["item_id"], r["text"]) for r in items.where(F.col("block") == block).collect()]
    own = items.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf(f"array<struct<item_id:{items.schema['item_id'].dataType.simpleString()},edits:int,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index([(k, t) for k, (_, t) in enumerate(own.value)], budget)
        for batch in batches:
            yield pd.Series([[(own.value[k][0], *place) for k, *place in index.find(plain(t))] for t in batch], dtype=object)

    return find, own


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: Budget = Budget()) -> DataFrame:
    """(id, item_id, edits, start, end) for each place of a benchmark item (item_id, text) in a text of docs.

    Edits, start and end count characters of the text in plain form: lower case, words only, single spaces. Items of
    any length are found wherever they stand, within words too, so an item of a few letters is held by very many texts:
    leave such items out, or ask for whole_words. Of overlapping places of an item that with the least edits counts, the
    first on ties. item_id keeps its type. Null and empty texts and items hold and match nothing. Repeated rows of docs give repeated rows; repeated items
    count one by one. Null ids stay null. Empty tables give an empty result. Other columns are ignored.

    The benchmark is a query set: it is held against all documents in blocks of about BLOCK_CHARS characters. One
    block at a time is on the driver and in the tasks; the hits of each are written before the next. Documents stay
    where they are: no shuffle.
    """
    items, n_blocks = _blocks(benchmark)
    found = None
    for block in range(n_blocks):
        find, own = _finder(items, block, budget)
        part = docs.select(F.col(id_col).alias("id"), F.explode(find(F.col(text_col))).alias("hit")).select("id", "hit.*")
        if n_blocks > 1:
            part = materialize(part, "hits")
            own.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", budget: Budget = Budget()) -> DataFrame:
    """The rows of docs whose text holds no benchmark item; all columns kept, repeated rows too. No shuffle.

    A benchmark of several blocks is taken block by block, and what is left of docs is written between them.
    """
    items, n_blocks = _blocks(benchmark)
    for block in range(n_blocks):
        find, own = _finder(items, block, budget)
        rest = docs.where(F.size(find(F.col(text_col))) == 0)
        if n_blocks > 1:
            rest = materialize(rest, "clean")
            own.destroy()
            if block:
                discard(docs)
        docs = rest
    return docs
