"""Evaluation passages inside training text: anchors of item-sized windows, weighted-shingle similarity, exact verification.

1. Texts and passages are reduced to plain words (``plain_words``): case, punctuation, spacing, markup, accents, invisible
   characters and look-alike letters make no difference.
2. Every window of ``STRETCH`` words of a passage holds one of its aligned blocks of ``BLOCK`` words whole. Of each block
   the ``ANCHORS`` rarest words are indexed. As a window may lack ``STRETCH - NEEDED`` words, all but so many of a block's
   anchors stand within ``SPAN`` words of a document that holds it: documents are looked up by that, and none is missed,
   whatever words are put in or taken out, and whatever other passages there are.
3. A pair (document, item) that met is compared by weighted shingles: the words of the passage within some ``SPAN`` words
   of the document must weigh what a window of it weighs without its ``STRETCH - NEEDED`` heaviest words. Rare words weigh more.
4. What is left is verified exactly: some stretch of ``STRETCH`` words of the passage of which ``NEEDED`` stand in the
   document in order within ``SPAN`` words.

Why no SimHash: with three words of twenty replaced the fingerprints of two windows differ in about eleven of 64 bits, and
up to twenty; blocks that guarantee such a radius are three bits wide and select nothing (figures in the README).

Items are broadcast, at most ``SHARD_ITEMS`` at a time: a longer list is cut into shards by hash and every document passes
through each, so the size of a broadcast is bounded whatever the number of items. Documents are never grouped, shuffled or
collected; each is verified in the task that read it.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.common import bounded_shard
from roadloom.session import cut_lineage, map_batches

STRETCH, NEEDED, SPAN = 20, 17, 32
#: Words of a block: two blocks less one word fit a stretch. Anchors of a block.
BLOCK, ANCHORS = STRETCH // 2, 7
SHARD_ITEMS = 5_000
#: Meetings of a word with blocks that are held at a time, to bound memory.
CHUNK_ROWS = 2_000_000

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "абвгдезикмнопрстухѕіјԁһԛԝүӏ" "αβγεηικνορτυχω" "ıɡɩʟꜱ",
    "a6vrdezukmhonpctyxsijdhqwyl" "abyenikvoptuxw" "iglls",
)

_TAG = re.compile(r"<[^<>]{0,200}>")
_WORD = re.compile(r"[^\W_]+")


class _Folding(dict):
    """Plain form of single characters, each worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code))
        kept = "".join(c for c in parts if unicodedata.category(c) not in ("Mn", "Cf", "Cc") or c in "\n\t\r")
        self[code] = kept.translate(LOOKALIKES)
        return self[code]


_FOLDING = _Folding()


def plain_words(text: str) -> list[str]:
    """The words of a text in plain form."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.casefold()
    if not text.isascii():
        text = text.translate(_FOLDING)
    return _WORD.findall(text.replace("'", "").replace("’", ""))


class ItemIndex:
    """The passages of one shard: anchors of their blocks, and weights of their words."""

    def __init__(self, items: tuple[tuple[int, str], ...]):
        self.ids = [item for item, _ in items]
        self.words = [plain_words(passage) for _, passage in items]
        long = [(item, words) for item, words in enumerate(self.words) if len(words) >= STRETCH]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in long for w in words}))}
        self.blocks = [(item, words[b : b + BLOCK]) for item, words in long for b in range(0, len(words) - BLOCK + 1, BLOCK)]
        used = Counter(w for _, words in self.blocks for w in set(words))
        rarity = lambda w: (used[w], -len(w), w)
        self.owner = np.array([item for item, _ in self.blocks], np.int64)
        self.needed = np.ones(len(self.blocks), np.int64)
        postings: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        for k, (_, words) in enumerate(self.blocks):
            anchors = sorted(set(words), key=rarity)[:ANCHORS]
            self.needed[k] = len(anchors) - _losable([words.count(w) for w in anchors])
            for bit, w in enumerate(anchors):
                postings[self.vocabulary[w]].append((k, 1 << bit))
        self.length = np.array([len(x) for x in postings] + [0], np.int64)  # the last place is that of strange words
        self.start = np.cumsum(self.length) - self.length
        self.posts = np.array([k for x in postings for k, _ in x], np.int64)
        self.bits = np.array([bit for x in postings for _, bit in x], np.uint16)
        # Whole numbers, so that sums are exact.
        heavy = [round(100 * (1 + math.log(max(1, len(self.blocks)) / max(1, used[w])))) for w in self.vocabulary]
        self.weights = np.array([*heavy, 0], np.int64)
        self.members = [np.array([self.vocabulary[w] for w in set(words)] if len(words) >= STRETCH else [], np.int64) for words in self.words]
        self.floor = [self._least(words) for words in self.words]

    def _least(self, passage: list[str]) -> int:
        """What the lightest stretch of a passage weighs without the heaviest words that may be missing."""
        found = []
        for s in range(len(passage) - STRETCH + 1):
            weighed = sorted(int(self.weights[self.vocabulary[w]]) for w in passage[s : s + STRETCH])
            found.append(sum(weighed[:NEEDED]))
        return min(found, default=0)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words of a document as numbers of the vocabulary; strange words are the number after the last."""
        strange = len(self.vocabulary)
        return np.fromiter((self.vocabulary.get(w, strange) for w in words), np.int64, len(words))

    def candidates(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """(number of document, number of passage), sorted: all pairs where the anchors of a block stand close together; none is missed."""
        if not self.blocks or not docs:
            return []
        words = np.concatenate(docs)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        place = np.concatenate([np.arange(len(d)) for d in docs])
        kept = self.length[words] > 0
        words, doc, place = words[kept], doc[kept], place[kept]
        total = np.cumsum(self.length[words])
        found: list[np.ndarray] = []
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK_ROWS)))
            # Further words than a span holds can't belong to what begins before: the overlap loses nothing.
            part = slice(a, b + SPAN)
            found.append(self._close(words[part], doc[part], place[part]))
            a = b
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return [(int(x) // len(self.words), int(x) % len(self.words)) for x in pairs]

    def _close(self, words: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        count = self.length[words]
        which = np.repeat(np.arange(len(words)), count)
        post = np.repeat(self.start[words], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        group = doc[which] * len(self.blocks) + self.posts[post]
        order = np.argsort(group, kind="stable")  # words of one document stay in order
        group, at, post = group[order], place[which[order]], post[order]
        needed = self.needed[self.posts[post]]
        # Enough anchors within a span, repeats counted; then different ones, by the bits of all that follow in the span.
        last = np.arange(len(group)) + needed - 1
        inside = last < len(group)
        last = np.minimum(last, max(len(group) - 1, 0))
        begin = np.flatnonzero(inside & (group[last] == group) & (at[last] - at < SPAN))
        met = self.bits[post[begin]]
        open_ones, step = np.arange(len(begin)), 1
        while len(open_ones):
            nxt = begin[open_ones] + step
            open_ones, nxt = open_ones[nxt < len(group)], nxt[nxt < len(group)]
            near = (group[nxt] == group[begin[open_ones]]) & (at[nxt] - at[begin[open_ones]] < SPAN)
            open_ones, nxt = open_ones[near], nxt[near]
            met[open_ones] |= self.bits[post[nxt]]
            step += 1
        hit = begin[np.bitwise_count(met) >= needed[begin]]
        return np.unique(doc[which[order[hit]]] * len(self.words) + self.owner[self.posts[post[hit]]])

    def alike(self, doc: np.ndarray, item: int) -> bool:
        """Weighted-shingle similarity: do words of the passage within some span of the document weigh enough?"""
        own = np.zeros(len(self.weights), bool)
        own[self.members[item]] = True
        held = own[doc]
        span = min(SPAN, len(doc))

        def rolling(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x)])
            return sums[span:] - sums[:-span]

        enough = rolling(held) >= NEEDED
        return bool(enough.any() and np.any(enough & (rolling(held * self.weights[doc]) >= self.floor[item])))


def _losable(counts: list[int]) -> int:
    """How many of the words that stand so often in a stretch can be gone altogether."""
    lost, left = 0, STRETCH - NEEDED
    for n in sorted(counts):
        left -= n
        if left < 0:
            break
        lost += 1
    return lost


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...]) -> ItemIndex:
    """Built once in each Python worker, which serves many tasks."""
    return ItemIndex(items)


def holds_stretch(words: list[str], places: dict[str, list[int]], passage: list[str]) -> bool:
    """Does some stretch of the passage stand in the document: enough of its words, in order, close together?

    Exact: every stretch with enough words present is compared, by bit vectors for the longest common subsequence, with
    the ``SPAN`` words from each place where its alignment can begin.
    """
    present = [w in places for w in passage]
    count = sum(present[:STRETCH])
    full = (1 << STRETCH) - 1
    for s in range(len(passage) - STRETCH + 1):
        if s:
            count += present[s + STRETCH - 1] - present[s - 1]
        if count < NEEDED:
            continue
        stretch = passage[s : s + STRETCH]
        masks: dict[str, int] = defaultdict(int)
        for i, w in enumerate(stretch):
            masks[w] |= 1 << i
        begins = sorted({p for w in stretch[: STRETCH - NEEDED + 1] for p in places.get(w, ())})
        hits = sorted({p for w in masks for p in places.get(w, ())})
        lo = hi = 0
        for begin in begins:
            # Words of the document that belong to the stretch, within the span from here.
            while lo < len(hits) and hits[lo] < begin:
                lo += 1
            hi = max(hi, lo)
            while hi < len(hits) and hits[hi] < begin + SPAN:
                hi += 1
            if hi - lo < NEEDED:
                continue
            v = full
            for p in hits[lo:hi]:
                u = v & masks[words[p]]
                v = ((v + u) | (v - u)) & full
            if STRETCH - v.bit_count() >= NEEDED:
                return True
    return False


def leaked_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage") -> DataFrame:
    """(``item_col``, ``id_col``): every document whose text holds a stretch of the passage of an item, once each.

    Null and empty texts hold nothing; passages of fewer than ``STRETCH`` words are never found; rows with a null id are
    left out. Repeated rows count once; an item with several passages leaks by any of them. Very long texts are read whole. Further columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).alias("t")).where("d is not null and t is not null")
    wanted = items.select(F.col(item_col).cast("bigint").alias("i"), F.col(passage_col).alias("p")).where("i is not null and p is not null").distinct()
    shards = max(1, -(-wanted.count() // SHARD_ITEMS))
    passes = []
    for shard in range(shards):
        listed = tuple(bounded_shard(wanted, ["i", "p"], shard, shards, 2 * SHARD_ITEMS))

        def run(batches: Iterator[pd.DataFrame], listed: tuple[tuple[int, str], ...] = listed) -> Iterator[pd.DataFrame]:
            index = _index(listed)
            for batch in batches:
                ids = batch["d"].to_numpy()
                texts = [plain_words(t) for t in batch["t"]]
                numbers = [index.numbers(words) for words in texts]
                found: list[tuple[int, int]] = []
                last, places = -1, {}
                for d, number in index.candidates(numbers):
                    if not index.alike(numbers[d], number):
                        continue
                    if d != last:
                        last, places = d, defaultdict(list)
                        for k, w in enumerate(texts[d]):
                            if w in index.vocabulary:
                                places[w].append(k)
                    if holds_stretch(texts[d], places, index.words[number]):
                        found.append((index.ids[number], int(ids[d])))
                yield pd.DataFrame(found, columns=[item_col, id_col], dtype="int64")

        part = map_batches(docs, run, f"`{item_col}` bigint, `{id_col}` bigint")
        # With several shards each is worked off before the next is fetched: the driver holds one at a time.
        passes.append(cut_lineage(part) if shards > 1 else part)
    return reduce(DataFrame.unionByName, passes).distinct()
