"""Spelling variants: pairs of words one edit apart, by composing automata.

The minimal acceptor of a group of words, a transducer that replaces or deletes one code point, and
the acceptor again are composed; the states of the product are pairs of acceptor states after equal
prefixes (no edit so far) or after the edit. Pairs are enumerated per group of words that
share their first or their last half: the edit leaves one of the halves as it is. A group with too
many words is cut further by the place of the edit and the rest of the word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import hold, text_batches

LETTERS = "A-Za-zÀ-ÿ"
#: Words of a group that one acceptor should hold; characters of the words a task counts before it sends them on.
GROUP_WORDS, HELD_CHARS = 1 << 15, 4 << 20
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def typo_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 7, every: int = 31,
                least: int = 2) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur ``least`` times or more.

    Words are maximal runs of letters with A-Z in lower case. Where ``every`` divides the unsigned crc32
    h of "key:word", the code point h modulo length is taken out, which plants typing errors. A null text
    has no words; a null key counts as the empty text.
    """
    rows = docs.select(F.coalesce(quoted(key).cast("string"), F.lit("")).alias("k"), quoted(text).alias("t"))
    # A run of ``shortest`` letters or more is found from its start, so every match is a maximal run.
    pattern = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        chars = 0
        for batch in text_batches(batches):
            for k, t in batch:
                start = zlib.crc32(f"{k}:".encode())
                for word, n in Counter(pattern.findall(t or "")).items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < shortest:
                            continue
                    if word not in found:
                        chars += len(word)
                    found[word] += n
            if chars > HELD_CHARS:
                yield _counts(found)
                found, chars = Counter(), 0
        yield _counts(found)

    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least))


def _counts(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                      ["word", "n"])


def near_words(vocabulary: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """(word, n, n_near, best_n, best): per word with near ones how many they are, and the most frequent one.

    Near words differ by exactly one inserted, deleted or replaced code point; of equally frequent ones
    the smallest in code-point order is the best. ``word`` must be distinct; null or empty ones have none.
    Every pair is found in exactly one group, so the parts of a word add up.
    """
    given = vocabulary.filter(quoted(word).isNotNull() & (quoted(word) != "")).select(
        quoted(word).alias("word"), quoted(n).cast("long").alias("n"))
    shortest = given.agg(F.min(F.char_length("word"))).first()[0] or 1
    # A pair shares its first ``head`` code points, or else its last ``shortest - head``.
    head = shortest // 2
    rows = given.select("n", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("w"), F.lit(head).alias("shared")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"), F.lit(shortest - head).alias("shared")))))
    groups = None
    while True:
        rows = rows.withColumn("part", F.substring("w", F.lit(1), F.col("shared")))
        sizes = hold(rows.groupBy("side", "part").agg(F.count(F.lit(1)).alias("members"))
                     .filter(F.col("members") > GROUP_WORDS))
        hot = sizes.first() is not None
        known = rows.join(sizes, ["side", "part"], "left")
        usual = known.filter("members IS NULL").select(
            "side", "shared", F.lit("").alias("hot"), F.lit(False).alias("only"),
            F.pmod(F.xxhash64("part"), F.lit(_parts(rows))).alias("bucket"), F.lit(3).alias("roles"), "w", "n")
        groups = usual if groups is None else groups.unionByName(usual)
        if not hot:
            break
        # A hot group falls into those of twice the shared length, and the pairs that part before it.
        large = known.filter("members IS NOT NULL")
        groups = groups.unionByName(_by_place(large))
        rows = hold(large.filter(F.char_length("w") >= F.greatest(2 * F.col("shared"), F.lit(1))).select(
            "n", "side", "w", F.greatest(2 * F.col("shared"), F.lit(1)).alias("shared")))
    keys = ["side", "shared", "hot", "only", "bucket"]
    parts = (groups.repartition(*keys).sortWithinPartitions(*keys, "w")
             .mapInArrow(lambda batches: _groups(batches, head), "word string, n long, near long, best_n long, best string"))
    return (parts.groupBy("word").agg(F.first("n").alias("n"), F.sum("near").alias("n_near"),
                                      F.min(F.struct(-F.col("best_n"), "best")).alias("top"))
            .select("word", "n", "n_near", (-F.col("top.col1")).alias("best_n"), F.col("top.best").alias("best")))


def _parts(rows: DataFrame) -> int:
    return rows.count() // (GROUP_WORDS // 2) + 1


def _by_place(large: DataFrame) -> DataFrame:
    """Rows of hot groups cut by the place of the edit, from the shared length to twice of it.

    Without the code point at that place (role 1), or as the shorter word (role 2), the two words of a
    pair are equal, so they meet in one bucket.
    """
    top = F.least(F.greatest(2 * F.col("shared"), F.lit(1)) - 1, F.char_length("w"))
    placed = large.select("*", F.explode(F.sequence(F.col("shared"), top)).alias("at"))
    less = F.concat(F.substring("w", F.lit(1), F.col("at")), F.substring("w", F.col("at") + 2, F.char_length("w")))
    both = placed.select("side", "part", "at", "members", "w", "n", F.inline(F.filter(F.array(
        F.struct(less.alias("rest"), F.lit(1).alias("roles")), F.struct(F.col("w").alias("rest"), F.lit(2).alias("roles"))),
        lambda x: (x["roles"] == 2) | (F.col("at") < F.char_length("w")))))
    return both.select("side", F.col("at").alias("shared"), F.col("part").alias("hot"), F.lit(True).alias("only"),
                       F.pmod(F.xxhash64("rest"), F.ceil(F.col("members") / GROUP_WORDS) * 2).alias("bucket"), "roles", "w", "n")


def _groups(batches: Iterator[pa.RecordBatch], head: int) -> Iterator[pa.RecordBatch]:
    """Near words inside every group of a sorted partition."""
    key, words, counts, roles = None, [], [], []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for *here, role, w, n in zip(*columns):
            if here != key:
                if len(words) > 1:
                    yield from _near_in_group(words, counts, roles, key, head)
                key, words, counts, roles = here, [], [], []
            if words and words[-1] == w:
                roles[-1] |= role
                continue
            words.append(w)
            counts.append(n)
            roles.append(role)
    if len(words) > 1:
        yield from _near_in_group(words, counts, roles, key, head)


def _near_in_group(words: list[str], counts: list[int], roles: list[int], key: list, head: int) -> Iterator[pa.RecordBatch]:
    side, shared, _, only, _ = key
    left, right = pairs(words, shared, shared if only else None)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    role = np.array(roles)
    keep = np.ones(len(left), bool)
    if only:
        longer = np.where(lens[left] >= lens[right], left, right)
        other = left + right - longer
        keep = (role[longer] & 1 > 0) & (role[other] & np.where(lens[left] == lens[right], 1, 2) > 0)
    if side:  # pairs with equal beginnings belong to the other side
        starts = np.unique([w[len(w) - head:] for w in words], return_inverse=True)[1]
        keep &= starts[left] != starts[right]
    left, right = left[keep], right[keep]
    if not len(left):
        return
    if side:
        words = [w[::-1] for w in words]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    n = np.array(counts, np.int64)
    one, other = np.concatenate([left, right]), np.concatenate([right, left])
    order = np.lexsort((rank[other], -n[other], one))
    first = np.flatnonzero(np.diff(one[order], prepend=-1))
    word, best = one[order][first], other[order][first]
    yield pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in word], pa.string()), pa.array(n[word]), pa.array(np.diff(np.append(first, len(order)))),
         pa.array(n[best]), pa.array([words[i] for i in best], pa.string())], ["word", "n", "near", "best_n", "best"])


class Acceptor:
    """The minimal deterministic automaton of sorted distinct words; states have larger numbers than their targets.

    ``count`` words are accepted from a state, numbered in their order; ``low`` and ``high`` bound their lengths.
    """

    def __init__(self, words: Sequence[str]) -> None:
        self.edges: list[tuple[tuple[str, int], ...]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self._known: dict[tuple, int] = {}
        open_states: list[list] = [[False, []]]  # the path of the last word: final, edges
        last = ""
        for word in words:
            same, most = 0, min(len(last), len(word))
            while same < most and word[same] == last[same]:
                same += 1
            self._close(open_states, last, same)
            open_states.extend([False, []] for _ in range(len(word) - same))
            open_states[-1][0] = True
            last = word
        self._close(open_states, last, 0)
        self.start = self._state(*open_states[0])

    def _close(self, open_states: list[list], word: str, depth: int) -> None:
        for at in range(len(open_states) - 1, depth, -1):
            target = self._state(*open_states.pop())
            open_states[-1][1].append((word[at - 1], target))

    def _state(self, final: bool, edges: list[tuple[str, int]]) -> int:
        key = (final, tuple(edges))
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.edges)
            self.edges.append(key[1])
            self.final.append(final)
            self.count.append(final + sum(self.count[t] for _, t in edges))
            self.low.append(0 if final else min([self.low[t] for _, t in edges], default=0) + 1)
            self.high.append(max([self.high[t] for _, t in edges], default=-1) + 1)
        return state

    def offsets(self, state: int) -> Iterator[tuple[str, int, int]]:
        """(code point, target, number of the first word behind it) of the edges of a state."""
        at = int(self.final[state])
        for c, target in self.edges[state]:
            yield c, target, at
            at += self.count[target]


class _OneEdit:
    """The product of an acceptor, one edit and the acceptor again."""

    def __init__(self, acceptor: Acceptor) -> None:
        self.a = acceptor
        self._common: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._steps: dict[int, dict[str, tuple[int, int]]] = {}

    def _meet(self, p: int, q: int) -> bool:
        return self.a.low[p] <= self.a.high[q] and self.a.low[q] <= self.a.high[p]

    def _next(self, state: int) -> dict[str, tuple[int, int]]:
        if state not in self._steps:
            self._steps[state] = {c: (t, at) for c, t, at in self.a.offsets(state)}
        return self._steps[state]

    def _below(self, p: int, q: int) -> Iterator[tuple[int, int, int, int]]:
        other = self._next(q)
        for c, (t, at) in self._next(p).items():
            if c in other and self._meet(t, other[c][0]):
                yield t, other[c][0], at, other[c][1]

    def _number(self, p: int, q: int) -> int | None:
        """Number of the only word accepted from ``p`` among those from ``q``."""
        number, edges = 0, self.a.edges
        while p != q:
            if not edges[p]:
                return number if self.a.final[q] else None
            step = self._next(q).get(edges[p][0][0])
            if step is None:
                return None
            p, q, number = edges[p][0][1], step[0], number + step[1]
        return number

    def common(self, p: int, q: int) -> Sequence[tuple[int, int]]:
        """Numbers of equal words accepted from both states: what follows the edit."""
        if p == q:
            return [(i, i) for i in range(self.a.count[p])]
        if not self._meet(p, q):
            return ()
        if self.a.count[p] == 1:
            at = self._number(p, q)
            return () if at is None else [(0, at)]
        if self.a.count[q] == 1:
            at = self._number(q, p)
            return () if at is None else [(at, 0)]
        if (p, q) not in self._common:
            wanted, todo = set(), [(p, q)]
            while todo:
                pair = todo.pop()
                if pair[0] != pair[1] and pair not in wanted and pair not in self._common:
                    wanted.add(pair)
                    todo.extend(x[:2] for x in self._below(*pair))
            for x, y in sorted(wanted, key=sum):  # targets have smaller numbers
                found = [(0, 0)] if self.a.final[x] and self.a.final[y] else []
                for t, u, at, to in self._below(x, y):
                    found += [(at + i, to + j) for i, j in (
                        [(i, i) for i in range(self.a.count[t])] if t == u else self._common[t, u])]
                self._common[x, y] = found
        return self._common[p, q]

    def here(self, state: int) -> list[tuple[int, int]]:
        """Pairs from a state whose first code points differ: replaced, or deleted from the longer word."""
        edges, count = list(self.a.offsets(state)), self.a.count
        found = []
        for k, (_, t, at) in enumerate(edges):
            for _, u, to in edges[k + 1:]:
                if t == u or count[t] > 1 or count[u] > 1:  # single words are equal in one state only
                    found += [(at + i, to + j) for i, j in self.common(t, u)]
            if self._meet(t, state):
                end = at + count[t]
                found += [(at + i, j) for i, j in self.common(t, state) if not at <= j < end]
        return found


def pairs(words: Sequence[str], shared: int, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of sorted distinct words one edit apart that share exactly their first d code
    points, for d from ``shared`` on, or with ``last`` up to it."""
    acceptor = Acceptor(words)
    product, count, edges = _OneEdit(acceptor), acceptor.count, acceptor.edges
    # The states after ``shared`` equal code points, with the number of the first word behind each.
    todo, begun = [(acceptor.start, 0, 0)], []
    while todo:
        state, depth, first = todo.pop()
        if count[state] > 1:
            if depth == shared:
                begun.append((state, shared, first))
            else:
                todo.extend((t, depth + 1, first + at) for _, t, at in acceptor.offsets(state))
    reached, todo = set(), [state for state, _, _ in begun]
    while todo:
        state = todo.pop()
        if state not in reached:
            reached.add(state)
            if last is None:
                todo.extend(t for _, t in edges[state] if count[t] > 1)
    here = {s: np.array(found, np.int64).T for s in reached if (found := product.here(s))}
    live = set(here)
    for state in sorted(reached):  # targets come first
        if any(t in live for _, t in edges[state]):
            live.add(state)
    left, right, todo = [], [], begun
    while todo:
        state, depth, first = todo.pop()
        if state in here:
            left.append(here[state][0] + first)
            right.append(here[state][1] + first)
        if last is None or depth < last:
            todo.extend((t, depth + 1, first + at) for _, t, at in acceptor.offsets(state) if t in live)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def variant_groups(vocabulary: DataFrame, word: str = "word", n: str = "n", times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word, the form it is a variant of, and the end of its forms.

    The form is the near word of largest n if that is at least ``times`` the word's; null otherwise. A
    form is ``times`` as frequent as its variant, so chains of forms are short and end.
    """
    words = vocabulary.select(quoted(word).alias("word"), quoted(n).cast("long").alias("n"))
    near = hold(near_words(words))
    most = words.agg(F.max("n")).first()[0] or 1
    longest = 0
    while times > 1 and times ** longest * 2 <= most:
        longest += 1
    forms = near.filter(F.col("best_n") >= times * F.col("n")).select("word", F.col("best").alias("root"))
    rounds = max(longest - 1, 0).bit_length()
    for _ in range(rounds):  # each round doubles the steps a root stands for
        forms = hold(forms)
        onward = forms.select(F.col("word").alias("__at"), F.col("root").alias("__to"))
        forms = forms.join(onward, forms["root"] == onward["__at"], "left").select("word", F.coalesce("__to", "root").alias("root"))
    joined = words.join(near.drop("n"), "word", "left").join(forms, "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    return joined.select("word", F.when(is_form, F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
                         F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
