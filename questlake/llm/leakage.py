"""Evaluation passages that stand, wholly or partly, in corpus documents.

Pigeonhole edit matching: a passage is split into more pieces than its error budget can
break, exact hits of piece hashes are looked up in the texts, and the text around a hit
is verified by Myers' bit-parallel edit distance. Errors are words of the passage that
are missing and words of the text that stand between.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlake.llm.words import words
from questlake.workspace import spread

RESULT = "item_id bigint, doc_id bigint, rule string, matched_words int, passage_words int, piece_place int, piece_words int, text_place int"
ARROW = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("rule", pa.string()), *((c, pa.int32()) for c in ("matched_words", "passage_words", "piece_place", "piece_words", "text_place"))])
#: Words that may stand between the two words of a piece.
GAP = 5
#: Words of texts that are searched together.
CHUNK = 50_000


@dataclass
class Item:
    """A passage: its words as numbers, the words that a case needs, and the longest stretch they may stand in."""

    item_id: int
    words: np.ndarray
    need: int
    reach: int
    masks: dict[int, int] = field(default_factory=dict)

    @property
    def budget(self) -> int:
        return len(self.words) - self.need


def sure_hits(n: int, need: int, reach: int, gap: int = GAP) -> int:
    """Of the n // 2 pairs of neighbouring words, how many stand in the text whatever errors a case has; 0 or less if none is sure.

    At most n - need words are missing, each of which breaks one pair. The words between
    those of unbroken pairs number at most reach - need, and it takes gap + 1 of them to
    push a pair out of reach. All other pairs stand in order in the text with no more
    than ``gap`` words between, within the stretch of the case.
    """
    return n // 2 - (n - need) - (reach - need) // (gap + 1)


class Postings:
    """From the hash of a piece to the passages and places that have it."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows.sort()
        keys, item, place = (np.array([r[c] for r in rows], np.uint64 if c == 0 else np.int64) for c in range(3))
        self.keys, starts = np.unique(keys, return_index=True)
        self.starts = np.append(starts, len(rows))
        self.item, self.place = item, place

    def hits(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in the passage and place in the text of every exact hit."""
        if not len(self.keys) or not len(keys):
            return (np.empty(0, np.int64),) * 3
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[slot] == keys)
        slot = slot[hit]
        lengths = self.starts[slot + 1] - self.starts[slot]
        first = np.repeat(self.starts[slot] - np.cumsum(lengths) + lengths, lengths)
        index = first + np.arange(lengths.sum())
        return self.item[index], self.place[index], np.repeat(at[hit], lengths)


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` words."""
    x = ids.astype(np.uint64) + np.uint64(1)
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out


def edit_distance(item: Item, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the passage to any stretch of the text, and where that ends (Myers' bit vectors).

    One step a text word: the bits of two integers hold where neighbouring cells of a
    column of the distance table go up and down by one.
    """
    n = len(item.words)
    full, high = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, n, 0
    masks = item.masks
    for j, word in enumerate(text.tolist()):
        equal = masks.get(word, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rises, falls = down | ~(horizontal | up) & full, up & horizontal
        if rises & high:
            score += 1
        elif falls & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        rises, falls = (rises << 1) & full, (falls << 1) & full
        up, down = falls | ~(vertical | rises) & full, rises & vertical
    return best, end


def common_in_order(masks: Sequence[int], n: int) -> int:
    """Words in common order: the same bit-vector scheme for a distance without substitutions; distance = n + len(text) - 2 · result."""
    full = (1 << n) - 1
    v = full
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def ordered_within(item: Item, text: np.ndarray) -> int:
    """Most passage words in order within any stretch of the item's reach; stops at the needed number."""
    masks = [item.masks.get(x, 0) for x in text.tolist()]
    upto = [0]
    for m in masks:
        upto.append(upto[-1] + (m != 0))
    best = 0
    for s, m in enumerate(masks):
        if m:
            end = min(len(masks), s + item.reach)
            if upto[end] - upto[s] >= item.need:
                best = max(best, common_in_order(masks[s:end], len(item.words)))
                if best >= item.need:
                    return best
    return best


def longest_run(text: np.ndarray, at: int, item: np.ndarray, place: int, size: int) -> int:
    """Equal consecutive words around ``size`` places that may agree; 0 if they don't."""
    if at + size > len(text) or (text[at : at + size] != item[place : place + size]).any():
        return 0
    a = 0
    while at - a > 0 and place - a > 0 and text[at - a - 1] == item[place - a - 1]:
        a += 1
    b = size
    while at + b < len(text) and place + b < len(item) and text[at + b] == item[place + b]:
        b += 1
    return a + b


class Searcher:
    """Finds the leaked items of texts.

    Pieces, all found by exact hash:

    * pairs of neighbouring words laid end to end, hit where both words stand in order
      with at most ``GAP`` words between. ``sure_hits`` of them must be hit within a
      stretch of the item's reach; a passage too short for that has single words, one
      more than may be missing, and one hit is enough;
    * for the rule of ``run`` equal words: pieces of (run + 1) / 2 words laid end to end,
      one of which lies whole in every such run.

    Around a hit the text is verified by ``edit_distance``: within the budget it is a
    case by itself (rule `edit`). Beyond it, since the case allows more words between
    than missing ones, by ``ordered_within`` (`ordered`), and where only the run is there,
    by extending the run's piece (`run`). Every row names the piece that led to it.
    """

    def __init__(self, rows: Iterable[tuple[int, str | None]], run: int = 10, share: float = 0.75, stretch: float = 1.5):
        self.run, self.size = run, (run + 1) // 2
        self.vocabulary: dict[str, int] = {}
        self.items: list[Item] = []
        number = self.vocabulary.setdefault
        for item_id, passage in rows:
            if w := words(passage):
                n = len(w)
                ids = np.array([number(x, len(self.vocabulary)) for x in w], np.int64)
                self.items.append(Item(item_id, ids, need=max(1, -(-int(round(share * n * 1000)) // 1000)), reach=int(stretch * n + 1e-9)))
        seen = Counter(int(x) for i in self.items for x in set(i.words.tolist()))
        rarity = np.array([seen[k] for k in range(len(self.vocabulary))], np.float64)
        pairs, singles, runs, least = [], [], [], []
        for k, item in enumerate(self.items):
            w, n = item.words, len(item.words)
            for p, x in enumerate(w.tolist()):
                item.masks[x] = item.masks.get(x, 0) | 1 << p
            sure = sure_hits(n, item.need, item.reach)
            if sure > 0:
                # of an odd number of words the first or the last is left out
                tilings = [range(o, n - 1, 2) for o in range(1 + n % 2)]
                pairs += [(self._pair(int(w[p]), int(w[p + 1])), k, p) for p in min(tilings, key=lambda t: sum(rarity[w[p]] * rarity[w[p + 1]] for p in t))]
            else:
                singles += [(int(w[p]), k, p) for p in sorted(range(n), key=lambda p: (rarity[w[p]], p))[: item.budget + 1]]
            least.append(max(1, sure))
            hashes = _rolled(w, self.size).tolist() if n >= run else []
            runs += [(hashes[p], k, p) for p in range(0, len(hashes), self.size)]
        self.heads = np.zeros(len(self.vocabulary) + 1, bool)  # the last stands for all unknown words
        self.heads[[key >> 32 for key, _, _ in pairs]] = True
        self.pairs, self.singles, self.runs = Postings(pairs), Postings(singles), Postings(runs)
        self.least, self.reach = np.array(least, np.int64), np.array([i.reach for i in self.items], np.int64)
        self._marks = np.zeros(len(self.vocabulary) + 1, bool)

    @staticmethod
    def _pair(a, b):
        return a << 32 | b

    def search(self, text: str | None) -> list[tuple]:
        """(item id, rule, matched words, passage words, piece's place, its words, place in the text) of each leaked item."""
        return [row for _, row in self.search_all([text])]

    def search_all(self, texts: Iterable[str | None]) -> Iterator[tuple[int, tuple]]:
        """``search`` of many texts: the text's number and a row."""
        held, total = [], 0
        for i, text in enumerate(texts):
            if w := words(text):
                held.append((i, w))
                total += len(w)
            if total >= CHUNK:
                yield from self._chunk(held, total)
                held, total = [], 0
        if held:
            yield from self._chunk(held, total)

    def _hits(self, ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """Size of the pieces, and item, piece's place and place in the text of their hits."""
        heads = np.flatnonzero(self.heads[ids])
        for gap in range(GAP + 1):
            a = heads[heads < len(ids) - 1 - gap]
            b = a + 1 + gap
            a = a[(ids[b] >= 0) & (doc[a] == doc[b])]
            yield 2, self.pairs.hits((ids[a] << 32 | ids[a + 1 + gap]).astype(np.uint64), a)
        if len(self.singles.keys):
            at = np.flatnonzero(ids >= 0)
            yield 1, self.singles.hits(ids[at].astype(np.uint64), at)
        if len(self.runs.keys) and len(ids) >= self.size:
            known = np.convolve(ids >= 0, np.ones(self.size, np.int64), "valid") == self.size
            at = np.flatnonzero(known & (doc[: len(known)] == doc[self.size - 1 :]))
            yield self.size, self.runs.hits(_rolled(ids, self.size)[at], at)

    def _chunk(self, held: list[tuple[int, list[str]]], total: int) -> Iterator[tuple[int, tuple]]:
        get = self.vocabulary.get
        ids = np.fromiter((get(x, -1) for _, w in held for x in w), np.int64, total)
        lengths = [len(w) for _, w in held]
        doc = np.repeat(np.arange(len(held)), lengths)
        starts = np.append(0, np.cumsum(lengths))
        near, whole = {}, {}
        for size, (item, place, at) in self._hits(ids, doc):
            for c, x in enumerate((item, place, at, np.full(len(item), size))):
                (near if size <= 2 else whole).setdefault(c, []).append(x)
        cases: dict[tuple[int, int], tuple] = {}
        for d, k, lo, hi, place, at, size in self._dense(near, doc):
            if (d, k) not in cases:
                text = ids[starts[d] : starts[d + 1]]
                if found := self._verified(self.items[k], text, lo - starts[d], hi - starts[d]):
                    cases[d, k] = (*found, place, size, at - starts[d])
        for item, place, at, size in zip(*(np.concatenate(whole[c]).tolist() for c in range(4))) if whole else ():
            if (d := int(doc[at]), item) not in cases:
                words_ = self.items[item].words
                matched = longest_run(ids[starts[d] : starts[d + 1]], at - starts[d], words_, place, size)
                if matched >= self.run:
                    cases[d, item] = ("run", matched, len(words_), place, size, at - starts[d])
        for (d, k), row in cases.items():
            yield held[d][0], (self.items[k].item_id, *map(lambda x: x if isinstance(x, str) else int(x), row))

    def _dense(self, hits: dict[int, list[np.ndarray]], doc: np.ndarray) -> Iterator[tuple]:
        """Text, item, first and last place of each stretch with enough hits, and its first hit's piece, place and size."""
        if not hits:
            return
        item, place, at, size = (np.concatenate(hits[c]) for c in range(4))
        order = np.lexsort((place, at, item, doc[at]))
        item, place, at, size = item[order], place[order], at[order], size[order]
        fresh = np.r_[True, (item[1:] != item[:-1]) | (at[1:] != at[:-1]) | (place[1:] != place[:-1])][: len(item)]
        item, place, at, size = item[fresh], place[fresh], at[fresh], size[fresh]
        first = np.arange(len(item))
        last = first + self.least[item] - 1
        first, last = first[last < len(item)], last[last < len(item)]
        inside = (item[first] == item[last]) & (doc[at[first]] == doc[at[last]]) & (at[last] - at[first] < self.reach[item[first]])
        first, last = first[inside], last[inside]
        if not len(first):
            return
        # stretches of one text and item that touch are verified together
        reach = self.reach[item[first]]
        apart = (item[first[1:]] != item[first[:-1]]) | (doc[at[first[1:]]] != doc[at[first[:-1]]]) | (at[first[1:]] - at[last[:-1]] > 2 * reach[1:])
        heads = np.flatnonzero(np.r_[True, apart])
        tails = np.r_[heads[1:], len(first)] - 1
        for a, b in zip(heads, tails):
            h = first[a]
            yield int(doc[at[h]]), int(item[h]), int(at[h]), int(at[last[b]]), int(place[h]), int(at[h]), int(size[h])

    def _verified(self, item: Item, text: np.ndarray, first: int, last: int) -> tuple[str, int, int] | None:
        """Rule, matched words and passage words, if the text around these places is a case."""
        part = text[max(0, first - item.reach + 1) : min(len(text), last + item.reach)]
        self._marks[item.words] = True
        marked = self._marks[part]
        self._marks[item.words] = False
        upto = np.zeros(len(part) + item.reach, np.int64)
        np.cumsum(marked, out=upto[1 : len(part) + 1])
        upto[len(part) + 1 :] = upto[len(part)]
        full = np.flatnonzero(marked & (upto[item.reach :] - upto[: len(part)] >= item.need))
        if not len(full):  # no stretch has enough of the passage's words in any order
            return None
        for a, b in zip(*self._apart(full, item.reach)):
            if found := self._case(item, part[a : b + item.reach]):
                return found
        return None

    @staticmethod
    def _apart(places: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the places whose stretches touch."""
        cut = np.flatnonzero(np.diff(places) > reach)
        return places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]

    @staticmethod
    def _case(item: Item, part: np.ndarray) -> tuple[str, int, int] | None:
        n = len(item.words)
        distance, end = edit_distance(item, part)
        if distance <= item.budget and n + distance <= item.reach:
            return "edit", common_in_order([item.masks.get(x, 0) for x in part[max(0, end - n - distance) : end].tolist()], n), n
        matched = ordered_within(item, part)
        return ("ordered", matched, n) if matched >= item.need else None


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 10, share: float = 0.75, stretch: float = 1.5, block: int = 20_000) -> DataFrame:
    """item_id, doc_id, rule, matched_words, passage_words, piece_place, piece_words, text_place; each case once.

    A case: the text has ``run`` consecutive words of the passage, or ``share`` of its
    words in order within a stretch of ``stretch`` times its length. The search has no
    false negatives and is verified exactly: see ``Searcher``, where the rules are named
    too. piece_place and text_place are the word numbers of the piece hit in passage and
    text.

    Items are taken in blocks by id, each sent to all tasks (at most ``block`` passages
    at a time); documents are read once a block and never shuffled. Null and empty
    texts and passages give no case; repeated ids give a row for each pair of rows
    that matches, once per pair of ids. Ties don't arise.
    """
    spark = docs.sparkSession
    ids = items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage")
    total = ids.count()
    blocks = max(1, -(-total // block))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    texts = spread(docs.select("doc_id", "text").where("text IS NOT NULL"))
    out = None
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in ids.where(part == b).collect()]  # a block: the stated bound
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
        one = texts.mapInArrow(_search(shared, run, share, stretch), RESULT)
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["item_id", "doc_id"])


_SEARCHERS: dict[str, Searcher] = {}


def _searcher(name: str, rows: list[tuple[int, str]], *rules) -> Searcher:
    """One searcher for all tasks of a worker, the last block's."""
    if name not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[name] = Searcher(rows, *rules)
    return _SEARCHERS[name]


def _search(shared, run: int, share: float, stretch: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(*shared.value, run, share, stretch)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(row[0], ids[i], *row[1:]) for i, row in searcher.search_all(batch.column(1).to_pylist())]
            columns = list(zip(*rows)) or [[] for _ in ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    return search
