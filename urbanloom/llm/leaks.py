"""Evaluation texts in a training corpus.

The corpus is read once and cut into shards. Each shard gets a suffix array over the places from which four words stand
that some evaluation text holds, in the order of LEAST words. Every suffix of every evaluation text is looked up in it by
binary search: over its whole depth for verbatim passages, over its first four words for runs that edits have cut short,
which are then grown over a few edits on either side. No run is too common to be looked up, and the result depends neither
on the order nor on the number of evaluation texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.words import words

#: Words of a seed, of a case at least, and about how many words there are to one edit.
SEED, LEAST, EDIT_EVERY = 4, 20, 8
#: Edits on either side of a run over which it is grown, and words to one edit at least in what is accepted.
SIDE_EDITS, ACCEPTED_EVERY = 4, EDIT_EVERY - 2
#: Seeds that a passage keeps at least: n words with n / ACCEPTED_EVERY edits keep n - 4 * edits - 3, for n = 20 and 24 five.
KEPT_SEEDS, WINDOW = 5, 28
#: Words of a shard and of a block of evaluation texts, about; longer evaluation texts are searched for in overlapping pieces.
SHARD_WORDS, BLOCK_WORDS, PIECE_WORDS, OVERLAP = 1_000_000, 1_000_000, 200_000, 100
_GAP = 40
_AT_ONCE = 400_000


def _numbered(known: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places from 1 on of the pairs (a, b) among the sorted pairs ``known``, 0 for other pairs and where either is 0."""
    out = np.zeros(len(a), np.int64)
    at = np.flatnonzero((a > 0) & (b > 0))
    if len(at) and len(known):
        key = a[at] << 32 | b[at]
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        out[at] = np.where(known[place] == key, place + 1, 0)
    return out


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])


class Items:
    """A block of evaluation texts as word numbers; ``grams`` numbers runs of four words in the order of the words."""

    def __init__(self, rows: list[tuple[int, list[str]]]) -> None:
        split = [(i, w) for i, w in rows if len(w) >= LEAST]
        self.ids = np.array([i for i, _ in split], np.int64)
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary
        flat: list[int] = [0] * _GAP
        self.start = np.zeros(len(split), np.int64)
        owner: list[np.ndarray] = [np.full(_GAP, -1)]
        for k, (_, w) in enumerate(split):
            self.start[k] = len(flat)
            flat += [number.setdefault(x, len(number) + 1) for x in w] + [0] * _GAP
            owner += [np.full(len(w), k), np.full(_GAP, -1)]
        self.flat, self.owner = np.array(flat, np.int64), np.concatenate(owner)
        a, b = self.flat, _shifted(self.flat, 1)
        self.twos = np.unique((a << 32 | b)[(a > 0) & (b > 0)])
        two = _numbered(self.twos, a, b)
        a, b = two, _shifted(two, 2)
        self.fours = np.unique((a << 32 | b)[(a > 0) & (b > 0)])
        gram = self.grams(self.flat)
        self.keys = suffix_keys(gram, np.arange(len(gram)))
        self.at = np.flatnonzero(gram)
        pairs = np.unique(gram[self.at] * (len(split) + 1) + self.owner[self.at])
        self.texts = np.bincount(pairs // (len(split) + 1), minlength=len(self.fours) + 1)

    def grams(self, flat: np.ndarray) -> np.ndarray:
        """Number of the four words from each place on, 0 where no evaluation text has them."""
        two = _numbered(self.twos, flat, _shifted(flat, 1))
        return _numbered(self.fours, two, _shifted(two, 2))


def suffix_keys(gram: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sort keys of the suffixes at places ``at``: LEAST words as five numbers of four words, two to a key."""
    parts = [np.where(at + SEED * k < len(gram), gram[np.minimum(at + SEED * k, len(gram) - 1)], 0) for k in range(LEAST // SEED)]
    return [parts[0] << 32 | parts[1], parts[2] << 32 | parts[3], parts[4]]


def suffix_array(gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places ``at`` in the order of the LEAST words that stand there, their keys)."""
    keys = suffix_keys(gram, at)
    order = np.lexsort(keys[::-1])
    return at[order], [k[order] for k in keys]


def _narrowed(keys: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Binary search of all ``want`` at once: the part of the sorted ``keys`` [lo, hi) that equals each."""
    out = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (live := a < b).any():
            mid = (a + b) // 2
            key = keys[np.minimum(mid, len(keys) - 1)]
            go = (key <= want) if right else (key < want)
            a, b = np.where(live & go, mid + 1, a), np.where(live & ~go, mid, b)
        out.append(a)
    return out


def _grown(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How far the words of ``a`` and ``b`` agree from i and j on, in the direction of ``step``."""
    length = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        x, y = i[live] + step * length[live], j[live] + step * length[live]
        ok = (x >= 0) & (x < len(a)) & (y >= 0) & (y < len(b))
        ok[ok] = (a[x[ok]] == b[y[ok]]) & (a[x[ok]] != 0)
        live = live[ok]
        length[live] += 1
    return length


def _reach(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """[k]: most words of ``a`` from i on, in the direction of ``step``, that ``b`` has from j on, with k edits; the last one matches.

    An edit replaces, drops or adds a word. For each number of edits the furthest place on each diagonal is enough to know.
    """
    best = np.zeros((SIDE_EDITS + 1, len(i)), np.int64)
    none = np.full(len(i), -1)
    ends = {0: np.zeros(len(i), np.int64)}
    for k in range(1, SIDE_EDITS + 1):
        new = {}
        for d in range(-k, k + 1):
            replaced, added, dropped = ends.get(d, none), ends.get(d - 1, none), ends.get(d + 1, none)
            x = np.maximum(np.maximum(np.where(replaced >= 0, replaced + 1, -1), added), np.where(dropped >= 0, dropped + 1, -1))
            x = np.where(x + d >= 0, x, -1)
            at = np.flatnonzero(x >= 0)
            more = _grown(a, i[at] + step * x[at], b, j[at] + step * (x[at] + d), step)
            x[at] += more
            np.maximum.at(best[k], at[more > 0], x[at[more > 0]])
            new[d] = x
        best[k] = np.maximum(best[k], best[k - 1])
        ends = new
    return best


def _accepted(items: Items, flat: np.ndarray, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the runs of ``length`` words at (i, j) grow to LEAST words with at most one edit in ACCEPTED_EVERY words."""
    left = _reach(items.flat, i - 1, flat, j - 1, -1)
    right = _reach(items.flat, i + length, flat, j + length, 1)
    out = length >= LEAST
    for a in range(SIDE_EDITS + 1):
        for b in range(SIDE_EDITS + 1):
            total = left[a] + length + right[b]
            out |= (total >= LEAST) & ((a + b) * ACCEPTED_EVERY <= total)
    return out


def _dense(known: np.ndarray) -> np.ndarray:
    """Places in some window of WINDOW places that has KEPT_SEEDS known ones; a passage lies in such places."""
    total = np.concatenate([[0], np.cumsum(known)])
    n = len(known)
    first = np.arange(n)
    full = np.flatnonzero(total[np.minimum(first + WINDOW, n)] - total[:n] >= KEPT_SEEDS)
    change = np.zeros(n + 1, np.int64)
    change[full] += 1
    np.add.at(change, np.minimum(full + WINDOW, n), -1)
    return known & (np.cumsum(change)[:n] > 0)


def _rare(gram: np.ndarray, at: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` aren't among the KEPT_SEEDS - 1 commonest of every window around them.

    Each window loses KEPT_SEEDS - 1 seeds at most, so each passage keeps one from which it is found.
    """
    common = np.zeros(len(gram), np.int64)
    common[at] = texts[gram[at]]
    own, beaten = common[at], np.zeros(len(at), np.int64)
    for s in range(1, WINDOW):
        beaten += common[np.maximum(at - s, 0)] * (at >= s) >= own
        after = at + s < len(gram)
        beaten += common[np.minimum(at + s, len(gram) - 1)] * after > own
    return beaten >= KEPT_SEEDS - 1


def _spread(lo: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) for each place of the ranges that start at ``lo`` and have ``times`` places."""
    q = np.repeat(np.arange(len(times)), times)
    return q, lo[q] + np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)


def _parts(times: np.ndarray) -> Iterator[slice]:
    """Slices of the queries with about _AT_ONCE places together."""
    if len(times):
        cuts = np.flatnonzero(np.diff(np.cumsum(times) // _AT_ONCE)) + 1
        yield from (slice(a, b) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(times)], strict=True))


def search(items: Items, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (document, item, place in the document, place in the item, length) of a shard: the longest verbatim run of each pair.

    flat: the shard's words by the numbers of ``items``, 0 for others, documents _GAP zeros apart; starts: their first places.
    """
    none = np.empty((0, 5), np.int64)
    gram = items.grams(flat)
    at = np.flatnonzero(_dense(gram > 0))
    if not len(at):
        return none
    places, keys = suffix_array(gram, at)
    asked = items.at
    # verbatim: all LEAST words of a suffix
    wanted = asked[items.keys[2][asked] > 0]
    wanted = wanted[((items.keys[0] & 0xFFFFFFFF)[wanted] > 0) & (items.keys[1][wanted] >> 32 > 0) & ((items.keys[1] & 0xFFFFFFFF)[wanted] > 0)]
    lo, hi = (np.searchsorted(keys[0], items.keys[0][wanted], side) for side in ("left", "right"))
    for level in (1, 2):
        hit = hi > lo
        wanted = wanted[hit]
        lo, hi = _narrowed(keys[level], items.keys[level][wanted], lo[hit], hi[hit])
    found, known = [none], np.empty(0, np.int64)
    size = len(items.ids)

    def runs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The verbatim runs through (i, j), each once, by their first places, and their pairs of document and item."""
        back = _grown(items.flat, i - 1, flat, j - 1, -1)
        key = np.unique((i - back) * len(flat) + j - back)
        i, j = key // len(flat), key % len(flat)
        return i, j, _grown(items.flat, i, flat, j, 1), (np.searchsorted(starts, j, "right") - 1) * size + items.owner[i]

    def keep(i: np.ndarray, j: np.ndarray, length: np.ndarray, pair: np.ndarray) -> None:
        order = np.lexsort((i, j, -length, pair))
        order = order[np.unique(pair[order], return_index=True)[1]]
        doc, item = pair[order] // size, pair[order] % size
        found.append(np.stack([doc, item, j[order] - starts[doc], i[order] - items.start[item], length[order]], axis=1))

    for part in _parts(hi - lo):
        q, k = _spread(lo[part], (hi - lo)[part])
        i, j, length, pair = runs(wanted[part][q], places[k])
        keep(i, j, length, pair)
        known = np.union1d(known, pair)
    # cut short: seeds of pairs that aren't found yet, grown over edits
    rare = np.zeros(len(gram), bool)
    rare[at[_rare(gram, at, items.texts)]] = True
    seeds = places[rare[places]]
    first = gram[seeds]
    lo, hi = (np.searchsorted(first, items.keys[0][asked] >> 32, side) for side in ("left", "right"))
    asked, lo, hi = asked[hi > lo], lo[hi > lo], hi[hi > lo]
    for part in _parts(hi - lo):
        q, k = _spread(lo[part], (hi - lo)[part])
        i, j = asked[part][q], seeds[k]
        new = ~np.isin((np.searchsorted(starts, j, "right") - 1) * size + items.owner[i], known)
        i, j, length, pair = runs(i[new], j[new])
        good = _accepted(items, flat, i, j, length)
        keep(i[good], j[good], length[good], pair[good])
        known = np.union1d(known, pair[good])
    return np.concatenate(found)


class Shard:
    """Words of some documents, numbered as they come; ``flat`` gives them in the numbers of a block of evaluation texts."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.local: list[int] = [0] * _GAP
        self.starts: list[int] = []

    def add(self, found: list[str]) -> None:
        number = self.number
        self.starts.append(len(self.local))
        self.local += [number.setdefault(w, len(number)) for w in found]
        self.local += [0] * _GAP

    def search(self, items: Items) -> np.ndarray:
        of = np.fromiter((items.vocabulary.get(w, 0) for w in self.number), np.int64, len(self.number))
        return search(items, of[np.array(self.local, np.int64)], np.array(self.starts, np.int64))


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The evaluation texts as words, in blocks of about BLOCK_WORDS; long texts in pieces that overlap by OVERLAP words."""
    block, size = [], 0
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).dropna().toLocalIterator():
        found = words(row["t"])
        for at in range(0, max(1, len(found) - OVERLAP), PIECE_WORDS - OVERLAP):
            piece = found[at : at + PIECE_WORDS]
            block.append((row["k"], piece))
            size += len(piece)
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key, doc_word, item_word, longest) of each document and evaluation text of which it holds a passage.

    A passage has LEAST words of the evaluation text or more. Case, punctuation, spacing, line breaks, accents and the
    encoding of characters are disregarded, as are single words replaced, dropped or added, up to about one in EDIT_EVERY.
    longest is the length in words of the longest verbatim run that was met, doc_word and item_word where it starts (for long
    evaluation texts, in their piece). Null, empty and blank texts, and evaluation texts of fewer than LEAST words, match
    nothing; copies of a document all come out. The corpus is read once, without a shuffle of texts, whatever the number of
    evaluation texts: they go out as broadcasts of about BLOCK_WORDS words each, held one at a time.
    """
    doc_kind, item_kind = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    slim = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).filter(F.length("text") > 0)
    shared = [docs.sparkSession.sparkContext.broadcast(Items(block)) for block in _blocks(items, item_key, item_text)]
    names = ["doc", "item", "doc_word", "item_word", "longest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys = Shard(), []

        def close() -> Iterator[pa.RecordBatch]:
            for block in shared:
                items_ = block.value
                rows = shard.search(items_)
                if len(rows):
                    columns = [pa.array([keys[d] for d in rows[:, 0]], kind), pa.array(items_.ids[rows[:, 1]]), *(pa.array(rows[:, c]) for c in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                if len(shared) > 1:
                    block.__dict__.pop("_value", None)  # one block in memory at a time; it is read again from the local disk

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                if len(found) < LEAST - SIDE_EDITS:
                    continue
                keys.append(key)
                shard.add(found)
                if len(shard.local) >= SHARD_WORDS:
                    yield from close()
                    shard, keys = Shard(), []
        if keys:
            yield from close()

    found = slim.mapInArrow(run, f"doc {doc_kind}, item long, doc_word long, item_word long, longest long")
    place = F.struct("longest", -F.col("doc_word"), -F.col("item_word"))
    best = found.groupBy("doc", "item").agg(F.max_by(F.struct("doc_word", "item_word", "longest"), place).alias("m"))
    return best.select(F.col("doc").alias(doc_key), F.col("item").cast(item_kind).alias(item_key), "m.*")


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """Pairs (doc_key, item_key) of a document and an evaluation text of which it holds a passage; see ``matches``."""
    return matches(docs, doc_key, doc_text, items, item_key, item_text).select(doc_key, item_key)


def without_leaks(docs: DataFrame, doc_key: str, found: DataFrame) -> DataFrame:
    """Documents that hold no passage of an evaluation text (rows with a null key stay)."""
    return docs.join(found.select(doc_key).distinct(), doc_key, "left_anti")
