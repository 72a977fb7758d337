"""Packing documents into fixed windows by order-preserving dynamic programming."""

from __future__ import annotations

import os
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import CACHE_ENTRIES, LONGEST_KEPT, by_bytes, text_batches

#: Costs in tokens of padding: cutting between sentences, within one, and of a window as such.
SENTENCE_COST, HARD_COST, WINDOW_COST = 24.0, 400.0, 4.0
#: Where no sentence ends, this many cuts are offered on the length of a window.
HARD_CUTS = 16
#: Ids of remembered words that an encoder holds before it starts anew.
CACHE_IDS = 4 << 20
#: Characters that the pre-tokenizer joins to one word behind letters (not the apostrophe, which may start an ending).
PUNCTUATION = ".,!?;:$&()\""
#: Tokens that are cut up together; windows don't cross this border.
BLOCK_TOKENS = 1 << 20


class _Places(dict):
    """word -> place in the tables of its encoder; a new word gets the next place and waits to be encoded."""

    def __init__(self, words: Iterable[str] = ()) -> None:
        super().__init__(zip(words, count()))
        self.taken = len(self)
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = self.taken
        self.taken += 1
        self.waiting.append(word)
        return place


class WordEncoder:
    """Token ids of texts, word by word, remembering the words it met.

    The vocabulary's normaliser folds white space and its pre-tokenizer drops it, so the ids
    of a text are those of its words one after the other. A word of letters with punctuation behind
    it is two words to the pre-tokenizer, so these are looked up and encoded apart. The last token of a
    word is marked in the vocabulary, so words of letters are encoded as one text and told apart again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.word_ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            plain = token.removesuffix("</w>")
            self.word_ends[i] = token.endswith("</w>")
            self.ends[i] = self.word_ends[i] and plain[-1:] in tuple(".!?")
        self.places, self.ids = _Places(), np.empty(0, "<u4")
        self.starts, self.sizes, self.uses = (np.empty(0, np.int64) for _ in range(3))

    def _trim(self) -> None:
        """Forget all words but those used most, which fill half the room at most."""
        words, at = list(self.places), np.fromiter(self.places.values(), np.int64, len(self.places))
        order = np.argsort(-self.uses[at], kind="stable")[:CACHE_ENTRIES // 2]
        order = order[(self.uses[at[order]] > 1) & (np.cumsum(self.sizes[at[order]]) <= CACHE_IDS // 2)]
        kept = at[order]
        self.places = _Places([words[i] for i in order.tolist()])
        self.ids, self.sizes = _gather(self.ids, self.starts[kept], self.sizes[kept]), self.sizes[kept]
        self.starts, self.uses = np.cumsum(self.sizes) - self.sizes, self.uses[kept] // 2

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.places) > CACHE_ENTRIES or len(self.ids) > CACHE_IDS:
            self._trim()
        words = [t.replace("\n", " ").split(" ") for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        del words
        self._learn()
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.sizes[at]
        ids = _gather(self.ids, self.starts[at], sizes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return np.split(ids, bounds[:-1]) if texts else []

    def _learn(self) -> None:
        """Encode the waiting words; long ones are not remembered after these texts."""
        places, first = self.places, len(self.starts)
        whole, long, halves, stems, tails = [], [], [], [], []
        for word in places.waiting:
            if len(word) > LONGEST_KEPT:
                long.append(word)
            stem = word.rstrip(PUNCTUATION)
            if len(stem) < len(word):
                ascii = stem.isascii()
                # Some letters normalise to a letter and a mark, which goes with the punctuation.
                low = stem.lower() if ascii else unicodedata.normalize("NFC", stem).lower()
                if low.isalpha():
                    halves.append(word)
                    stems.append(low if ascii else stem)
                    tails.append(word[len(stem):])
                    continue
            whole.append(word)
        places.waiting = []
        pairs = np.array([[places[w] for w in words] for words in (halves, stems, tails)], np.int64).T
        whole += places.waiting
        long += [w for w in places.waiting if len(w) > LONGEST_KEPT]
        places.waiting = []

        starts, sizes, uses = (np.concatenate([old, np.zeros(places.taken - first, np.int64)])
                               for old in (self.starts, self.sizes, self.uses))
        pieces, total = [self.ids], len(self.ids)
        for batch in by_bytes(whole, len, 1 << 18):
            ids, n = self._encode_words(batch)
            at = np.fromiter(map(places.__getitem__, batch), np.int64, len(batch))
            starts[at], sizes[at] = total + np.cumsum(n) - n, n
            pieces.append(ids)
            total += len(ids)
        ids = np.concatenate(pieces)
        # The two parts of a word lie next to each other in the order (stem, tail).
        both = pairs[:, 1:].ravel()
        starts[pairs[:, 0]] = len(ids) + np.concatenate([[0], np.cumsum(sizes[both])])[:-1:2]
        sizes[pairs[:, 0]] = sizes[both].reshape(-1, 2).sum(1)
        self.ids = np.concatenate([ids, _gather(ids, starts[both], sizes[both])])
        self.starts, self.sizes, self.uses = starts, sizes, uses + np.bincount(both, minlength=len(uses))
        for word in long:
            del places[word]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        lengths = np.zeros(len(words), np.int64)
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        letters = [w for w, p in zip(words, plain) if p]
        joined = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.word_ends[joined])
        if len(last) != len(letters):  # letters that the pre-tokenizer takes apart
            plain[:], joined, last = False, joined[:0], last[:0]
        others = [w for w, p in zip(words, plain) if not p]
        apart = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths[plain] = np.diff(last, prepend=-1)
        lengths[~plain] = np.fromiter(map(len, apart), np.int64, len(apart))
        ids = np.empty(int(lengths.sum()), "<u4")
        mine = np.repeat(plain, lengths)
        ids[mine] = joined
        ids[~mine] = np.fromiter(chain.from_iterable(apart), "<u4")
        return ids, lengths


@cache
def _encoder(path: str) -> WordEncoder:
    """One encoder per worker, so that later tasks find the words of earlier ones."""
    return WordEncoder(path)


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum()))]


def _candidates(marks: np.ndarray, costs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions (0 first) and costs, with hard cuts wherever two lie too far apart."""
    gaps, step = np.flatnonzero(np.diff(marks) > size // 2), max(1, size // HARD_CUTS)
    if len(gaps):
        extra = np.concatenate([np.arange(marks[g] + step, marks[g + 1], step) for g in gaps])
        marks = np.concatenate([marks, extra])
        costs = np.concatenate([costs, np.full(len(extra), HARD_COST)])
        order = np.argsort(marks, kind="stable")
        marks, costs = marks[order], costs[order]
    return marks, costs


def choose_cuts(marks: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """Cheapest windows over cut positions ``marks`` (first 0, last the total).

    A window [a, b) costs its padding to ``size`` (none where b - a is a power of two) plus
    WINDOW_COST plus the cost of cutting at b. The best start within reach is the head of a
    monotone queue over best[a] + a; the few starts at power-of-two distance are found by
    binary search for all positions at once. Linear in the number of positions.
    """
    marks, costs = _candidates(marks, costs, size)
    m = len(marks)
    pairs = []  # (start, end) of the possible windows of a power of two
    length = 1
    while length < size:
        at = np.minimum(np.searchsorted(marks, marks - length), m - 1)
        ends = np.flatnonzero(marks[at] == marks - length)
        pairs.append(np.stack([at[ends], ends]))
        length *= 2
    starts, ends = np.concatenate(pairs or [np.empty((2, 0), np.int64)], axis=1)
    exact = starts[np.argsort(ends, kind="stable")].tolist()
    first = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=m))]).tolist()
    where, price = marks.tolist(), (costs + WINDOW_COST).tolist()
    best, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (best + position, position, place)
    for j in range(1, m):
        here = where[j]
        low = here - size
        while queue[0][1] < low:
            queue.popleft()
        value, _, start = queue[0]
        value -= low
        for i in exact[first[j]:first[j + 1]]:
            if best[i] < value:
                value, start = best[i], i
        value += price[j]
        best[j], back[j] = value, start
        level = value + here
        while queue and queue[-1][0] >= level:
            queue.pop()
        queue.append((level, here, j))
    cuts = []
    j = m - 1
    while j:
        cuts.append(where[j])
        j = back[j]
    return [0, *cuts[::-1]]


class _Packer:
    """Gathers token ids of documents to blocks and emits their pieces."""

    def __init__(self, size: int, ends: np.ndarray, eos: int, sequence: int) -> None:
        self.size, self.ends, self.eos, self.sequence = size, ends, eos, sequence
        self.docs: list[tuple] = []  # (key, start, ids, tokens of the document)
        self.total = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        ids = np.append(ids, np.uint32(self.eos)).astype("<u4")
        for start in range(0, len(ids), BLOCK_TOKENS):
            part = ids[start:start + BLOCK_TOKENS]
            self.docs.append((key, start, part, len(ids)))
            self.total += len(part)
            if self.total >= BLOCK_TOKENS:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.docs:
            return
        stream = np.concatenate([d[2] for d in self.docs])
        firsts = np.cumsum([0] + [len(d[2]) for d in self.docs])
        sentence = np.flatnonzero(self.ends[np.minimum(stream, len(self.ends) - 1)]) + 1
        sentence = np.setdiff1d(sentence, firsts, assume_unique=True)
        marks = np.concatenate([firsts, sentence])
        order = np.argsort(marks, kind="stable")
        costs = np.concatenate([np.zeros(len(firsts)), np.full(len(sentence), SENTENCE_COST)])
        cuts = choose_cuts(marks[order], costs[order], self.size)
        edges = np.union1d(cuts, firsts)
        windows = np.searchsorted(cuts, edges[:-1], side="right") - 1
        owners = np.searchsorted(firsts, edges[:-1], side="right") - 1
        for a, b, w, d in zip(edges[:-1].tolist(), edges[1:].tolist(), windows.tolist(), owners.tolist()):
            key, start, _, tokens = self.docs[d]
            yield (key, start + a - int(firsts[d]), b - a, stream[a:b].tobytes(), tokens,
                   self.sequence + w, a - cuts[w])
        self.sequence += len(cuts) - 1
        self.docs, self.total = [], 0


def pack(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", size: int = 4096,
         eos: int = 2) -> DataFrame:
    """One row per piece: ``key``, start, length, ids (little-endian unsigned 32 bit),
    doc_tokens, sequence_id, offset.

    A document is its token ids followed by ``eos``; null and empty texts are that id alone.
    Each id lies in exactly one piece; the pieces of a sequence follow each other without a
    gap and fill ``size`` ids at most. Sequences are padded to ``size`` by whoever writes
    them, except those whose length is a power of two. Documents keep the order of their
    partition and each partition is packed by itself, in blocks of bounded size, so nothing
    is shuffled; repeated rows are packed each. Extra columns are ignored, an empty
    table gives no pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder = _encoder(tokenizer_path)
        packer = _Packer(size, encoder.ends, eos, TaskContext.get().partitionId() << 36)
        names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for rows in text_batches(batches):
            out = []
            for (k, _), ids in zip(rows, encoder.encode([t or "" for _, t in rows])):
                out.extend(packer.add(k, ids))
            if out:
                yield as_batch(out)
        if out := list(packer.flush()):
            yield as_batch(out)

    return (df.select(quoted(key).cast("long").alias("key"), quoted(text).alias("t"))
            .mapInArrow(run, "key long, start long, length long, ids binary, doc_tokens long, "
                             "sequence_id long, offset long").withColumnRenamed("key", key))
