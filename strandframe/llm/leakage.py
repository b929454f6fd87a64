"""Passages of held-out test items inside a large corpus.

The seeds are word n-grams of the items, looked up in every document; item and document are aligned around each seed
(Smith-Waterman over words), and the alignment tells the longest exact run and scores edited copies. Either every n-gram is
a seed, so that whatever shares one with an item is aligned, or only the rarest of each passage, counted over the whole
corpus: that is enough for exact passages and spares the alignments of common phrases, but an edited copy may lack it. The
item set is the side of fixed size: it is broadcast in blocks of bounded size, as numbers instead of words. The corpus isn't
shuffled and is read once a block; only documents with a gram of an item are kept for the alignment.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandframe.session import cut

#: Words of items that are broadcast at once; larger item sets are worked off in several passes. A word takes about 30 bytes.
BLOCK_WORDS = 2_000_000
SEED_WORDS = 5
MATCH, MISMATCH, GAP = 2, -1, -1

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", re.S)
# Letters that are not seen: soft hyphen, zero-width letters and joiners, marks of direction, variation selectors.
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD, _PLAIN = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC and lower case; tags separate words, unseen letters don't."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return _PLAIN.findall(text.lower())
    text = _UNSEEN.sub("", text)
    if not unicodedata.is_normalized("NFKC", text):
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


#: An odd factor: the number of a gram is that of its words as digits, modulo 2^64.
_DIGIT = np.uint64(0x9E3779B97F4A7C15)


def gram_numbers(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n codes; 0 for runs with a code of 0."""
    size = max(len(codes) - n + 1, 0)
    out, whole = np.full(size, np.uint64(n)), np.ones(size, bool)
    for j in range(n):
        part = codes[j : j + size]
        out = (out ^ (out >> np.uint64(29))) * _DIGIT + part.astype(np.uint64)
        whole &= part > 0
    return np.where(whole, out | np.uint64(1), np.uint64(0))


class Seeds:
    """The words of items as codes from 1 on, and their grams by number. Items shorter than the gram have one of their own length."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int, passage: int) -> None:
        self.n, self.passage = n, passage
        self.code: dict[str, int] = {}
        self.ids, self.items = [], []
        for i, t in items:
            if t:
                self.ids.append(i)
                self.items.append(np.array([self.code.setdefault(w, len(self.code) + 1) for w in t], np.int32))
        self.sizes = sorted({min(n, len(t)) for t in self.items})
        made = [gram_numbers(t, min(n, len(t))) for t in self.items]
        self._keep(np.concatenate(made or [np.zeros(0, np.uint64)]), np.repeat(np.arange(len(made)), [len(x) for x in made]), np.concatenate([np.arange(len(x)) for x in made] or [np.zeros(0, np.int64)]))

    def _keep(self, number: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(number, kind="stable")
        self.number, self.item, self.at = number[order], item[order].astype(np.int32), at[order].astype(np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the words of texts, one behind the other with a 0 after each, and the begins of the texts."""
        get, flat, begins = self.code.get, [], [0]
        for t in texts:
            flat += [get(w, 0) for w in words(t)]
            flat.append(0)
            begins.append(len(flat))
        return np.array(flat, np.int32), np.array(begins)

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of the known grams in a sequence of codes, in order of size and place."""
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n in self.sizes:
            number = gram_numbers(codes, n)
            some = np.flatnonzero(number)
            if len(some) and len(self.number):
                k = np.minimum(np.searchsorted(self.number, number[some]), len(self.number) - 1)
                some = some[self.number[k] == number[some]]
                at.append(some), found.append(number[some])
        return np.concatenate(at), np.concatenate(found)

    def keep_rare(self, df: dict[int, int]) -> None:
        """Keeps, of each passage of each item, the gram with the fewest occurrences in the corpus, of those that occur."""
        kept = set()
        by_item = np.lexsort((self.at, self.item))
        number, item, at = self.number[by_item], self.item[by_item], self.at[by_item]
        times = np.array([df.get(x, 0) for x in number.view(np.int64).tolist()], np.int64)
        rank = np.where(times > 0, times, np.iinfo(np.int64).max)
        begins = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else []
        for b, e in zip(begins, [*begins[1:], len(item)]):
            span = max(1, min(self.passage, len(self.items[item[b]])) - self.n + 1)
            for w in range(b, max(b + 1, e - span + 1)):
                kept.add(w + int(np.argmin(rank[w : min(w + span, e)])))
        some = np.array(sorted(kept), np.int64)
        self._keep(number[some], item[some], at[some])

    def seeds(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Of each seeded item the (place in the item, place in the text) of its seeds in a text."""
        out: dict[int, list[tuple[int, int]]] = {}
        places, numbers = self.places(codes)
        lo, hi = np.searchsorted(self.number, numbers, "left"), np.searchsorted(self.number, numbers, "right")
        for p, a, b in zip(places.tolist(), lo.tolist(), hi.tolist()):
            for k in range(a, b):
                out.setdefault(int(self.item[k]), []).append((int(self.at[k]), p))
        return out


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The best local alignment score of two lists of word codes, and the longest run of matches in the table. Codes of 0 match nothing."""
    if len(a) > len(b):
        a, b = b, a  # both are symmetric; one step a word of the shorter list
    best = longest = 0
    row, run, place = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1) * -GAP
    for w in a:
        same = (b == w) & (w > 0)
        now = np.maximum(row + GAP, 0)
        now[1:] = np.maximum(now[1:], row[:-1] + np.where(same, MATCH, MISMATCH))
        now = np.maximum.accumulate(now + place) - place
        on = np.zeros_like(run)
        on[1:] = np.where(same, run[:-1] + 1, 0)
        best, longest, row, run = max(best, int(now.max())), max(longest, int(on.max())), now, on
    return best, longest


def _reachable(item: np.ndarray, stretch: np.ndarray) -> float:
    """No alignment of the item with the stretch has a larger share: each word they have in common is matched once."""
    word, n = np.unique(item, return_counts=True)
    k = np.searchsorted(word, stretch)
    k = k[(k < len(word)) & (word[np.minimum(k, len(word) - 1)] == stretch)]
    return float(np.minimum(n, np.bincount(k, minlength=len(word))).sum()) / len(item)


def align(seeds: Seeds, codes: np.ndarray, least: float = 0.0) -> list[tuple[int, int, int, int]]:
    """(item, words in the longest exact run, alignment score, words of the item) of each item seeded in a text.

    Stretches in which no alignment can reach the share ``least`` aren't aligned, and items with no other stretch are left out.
    """
    out = []
    for i, hits in seeds.seeds(codes).items():
        item = seeds.items[i]
        n = min(seeds.n, len(item))
        # the stretch of the text that an alignment through a seed can reach; stretches that touch are one
        reach: list[list[int]] = []
        for bgn, end in sorted((max(0, p - 2 * at - n), min(len(codes), p + 2 * (len(item) - at) + n)) for at, p in hits):
            if reach and bgn <= reach[-1][1]:
                reach[-1][1] = max(reach[-1][1], end)
            else:
                reach.append([bgn, end])
        tables = [smith_waterman(codes[b:e], item) for b, e in reach if least <= 0 or _reachable(item, codes[b:e]) >= least]
        if tables:
            out.append((seeds.ids[i], max(r for _, r in tables), max(s for s, _ in tables), len(item)))
    return out


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The items, block by block; a block has at most BLOCK_WORDS words or one item."""
    sized = items.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND length(text) > 0").distinct()
    letters = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-letters // (2 * BLOCK_WORDS)))
    for b in range(blocks):
        yield [(r.id, words(r.text)) for r in sized.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()]


_FORM = "item long, run int, score int, item_words int"


def _rows(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc", "item", "run", "score", "item_words"])


def leaked_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, passage: int = 12, n: int = SEED_WORDS, least: float = 0.0, rare: bool = True) -> DataFrame:
    """(doc_key, item_key, run, score, share, item_words): items of which a document has a passage, whole, in part or edited.

    ``run`` is the longest run of matches in the alignment around the seeds, ``score`` the Smith-Waterman score (2 for an equal
    word, -1 for another, a missing or an added one) and ``share`` the score over that of the whole item; rows below ``least``
    are left out. With ``rare`` the seed of each passage is its rarest n-gram: any exact passage of ``passage`` words, and
    any item shorter than that, is found, but edited copies only by chance. Without it every n-gram is a seed: any document
    that shares ``n`` successive words with an item is aligned with it, whatever other copies the corpus holds.
    Null and empty texts give no rows; an item or document repeated with the same key and text counts once.
    """
    from functools import reduce

    sc = docs.sparkSession.sparkContext
    kind = docs.schema[doc_key].dataType.simpleString()
    corpus = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).where("doc IS NOT NULL AND length(text) > 0")
    parts = []
    for block in _item_blocks(items, item_key, item_text):
        seeds = Seeds(block, n, passage)
        known = sc.broadcast(seeds)  # at most BLOCK_WORDS words

        def scan(batches: Iterator[pa.RecordBatch], held=known, direct=not rare) -> Iterator[pa.RecordBatch]:
            """The documents with a gram of an item, as codes, with these grams; or, ``direct``, their alignments."""
            own = held.value
            for batch in batches:
                keys = batch.column(0)
                for at in range(0, batch.num_rows, 256):
                    codes, begins = own.encode(batch.column(1)[at : at + 256].to_pylist())
                    places, numbers = own.places(codes)
                    doc = np.searchsorted(begins, places, side="right") - 1
                    order = np.argsort(doc, kind="stable")
                    some, first = np.unique(doc[order], return_index=True)
                    rows = pa.array(some + at)
                    if direct:
                        yield _rows(keys.type, [(k, *x) for k, d in zip(keys.take(rows).to_pylist(), some) for x in align(own, codes[begins[d] : begins[d + 1] - 1], least)])
                        continue
                    flat = numbers[order].view(np.int64)
                    size = begins[some + 1] - begins[some] - 1
                    texts = np.concatenate([codes[begins[d] : begins[d + 1] - 1] for d in some] or [codes[:0]])
                    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate((cuts, [len(v)])).astype(np.int32)), pa.array(v)) for cuts, v in ((np.cumsum(size) - size, texts), (first, flat))]
                    yield pa.RecordBatch.from_arrays([keys.take(rows), *lists], ["doc", "codes", "grams"])

        if not rare:
            parts.append(corpus.mapInArrow(scan, f"doc {kind}, {_FORM}"))
            continue
        seen = cut(corpus.mapInArrow(scan, f"doc {kind}, codes array<int>, grams array<long>"))
        counted = seen.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        seeds.keep_rare({r.gram: r.n for r in counted.collect()})  # at most the grams of one block
        known.unpersist()
        sown = sc.broadcast(seeds)

        def find(batches: Iterator[pa.RecordBatch], held=sown) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                yield _rows(batch.schema.field(0).type, [(doc, *x) for doc, codes in zip(batch.column(0).to_pylist(), batch.column(1)) for x in align(own, codes.values.to_numpy(), least)])

        parts.append(seen.select("doc", "codes").mapInArrow(find, f"doc {kind}, {_FORM}"))
    found = reduce(lambda a, b: a.unionByName(b), parts)
    share = F.col("score") / (F.col("item_words") * MATCH)
    found = found.where(share >= least).groupBy("doc", "item").agg(F.max("run").alias("run"), F.max("score").alias("score"), F.max(share).alias("share"), F.max("item_words").alias("item_words"))
    return found.withColumnsRenamed({"doc": doc_key, "item": item_key})
