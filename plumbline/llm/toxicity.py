"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import by_bytes, fold, giving_back, labelled_sample, mix64, words_of

#: Words of a window and words from one window to the next; windows overlap.
WINDOW, STRIDE = 32, 24
#: Hashed rows of the word and character embeddings, their width, and the state of a direction.
WORD_ROWS, CHAR_ROWS, WIDTH, STATE = 1 << 15, 1 << 15, 6, 8
#: Bytes of a word that are one step, with its two end marks; longer words are several steps.
STEP_BYTES = 24
#: Bounds of the training sample: rows of either class, and bytes of a training text.
ROWS_PER_CLASS, TRAIN_BYTES = 1500, 16_384
#: Windows scored together; least number of updates in a training round over few rows.
BATCH, MIN_STEPS = 1024, 60
#: Bytes of text scored together, and distinct words whose inputs are worked out together.
TEXT_BYTES, WORDS = 3 << 20, 8192


def raw_words(text: str | None) -> list[bytes]:
    """Lower-case words as bytes."""
    return text.lower().encode("utf-8", "replace").split() if text else []


def pieces_of(word: bytes) -> list[bytes]:
    """A word as the network reads it: without outer punctuation, marked at both ends."""
    word = word.strip(b".,;:!?\"'()")
    return [b"\x02" + word[at:at + STEP_BYTES - 2] + b"\x03" for at in range(0, max(1, len(word)), STEP_BYTES - 2)]


def steps_of(text: str | None) -> list[bytes]:
    """The whole text as steps of the network."""
    return [p for w in raw_words(text) for p in pieces_of(w)]


class _Index(dict):
    """word -> its number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, character rows, which of these count) of distinct words.

    Character features are all three-byte pieces and the beginnings of five to seven bytes.
    """
    raw = np.array(words, f"S{STEP_BYTES}")
    m = raw.view(np.uint8).reshape(len(words), STEP_BYTES)
    blocks = np.ascontiguousarray(m).view("<u8")
    word = mix64(mix64(mix64(blocks[:, 0]) + blocks[:, 1]) + blocks[:, 2]) % np.uint64(WORD_ROWS)
    wide = m.astype(np.uint32)
    pieces = wide[:, :-2] * np.uint32(0x9E3779B1) + wide[:, 1:-1] * np.uint32(0x85EBCA77) + wide[:, 2:] * np.uint32(0xC2B2AE3D)
    size = np.char.str_len(raw)
    used = np.arange(STEP_BYTES - 2)[None, :] < np.maximum(1, size - 2)[:, None]
    heads = []
    for n in (5, 6, 7):
        h = np.full(len(words), n, np.uint32)
        for j in range(n):
            h = h * np.uint32(16777619) ^ wide[:, j]
        heads.append(h)
    char = np.concatenate([pieces ^ (pieces >> np.uint32(15)), np.stack(heads, 1)], 1)
    char = ((char ^ (char >> np.uint32(13))) % np.uint32(CHAR_ROWS)).astype(np.int32)
    used = np.concatenate([used, np.stack([size >= n for n in (5, 6, 7)], 1)], 1)
    return word.astype(np.int32), char, used


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        d, h = 2 * WIDTH, STATE
        def init(*shape: int, s: float) -> np.ndarray:
            return (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"Ew": init(WORD_ROWS, WIDTH, s=0.05), "Ec": init(CHAR_ROWS, WIDTH, s=0.05), "v": init(2 * h, s=0.3),
                  "w": init(2 * h, s=0.3), "b": np.zeros(1, np.float32)}
        for side in "fr":
            self.p |= {"W" + side: init(d, 3 * h, s=0.5 / np.sqrt(d)), "U" + side: init(h, 3 * h, s=0.5 / np.sqrt(h)),
                       "c" + side: np.zeros(3 * h, np.float32)}

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        word, char, used = hashed(words)
        weight = (used / np.sqrt(used.sum(1, keepdims=True))).astype(np.float32)
        x = np.concatenate([self.p["Ew"][word], np.einsum("wgd,wg->wd", self.p["Ec"][char], weight)], 1)
        return x, (word, char, weight)

    def tables(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Input projections of distinct words for both directions; the last row is padding."""
        parts = [self.inputs(words[at:at + WORDS])[0] for at in range(0, len(words), WORDS)]
        x = np.concatenate([*parts, np.zeros((1, 2 * WIDTH), np.float32)])
        return x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wr"] + self.p["cr"]

    def _side(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, side: str, keep: list | None) -> np.ndarray:
        n, length = ids.shape
        u, h = self.p["U" + side], np.zeros((n, STATE), np.float32)
        states = np.empty((length, n, STATE), np.float32)
        s2 = 2 * STATE
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            x, g = table[ids[:, t]], h @ u
            zr = np.tanh((x[:, :s2] + g[:, :s2]) * np.float32(0.5))
            zr = zr * np.float32(0.5) + np.float32(0.5)
            z, q = zr[:, :STATE], g[:, s2:]
            new = np.tanh(x[:, s2:] + zr[:, STATE:] * q)
            out = new + z * (h - new)
            if mask is not None:
                on = mask[:, t:t + 1]
                out = np.where(on, out, h)
            if keep is not None:
                keep.append((t, h, zr, q, new))
            states[t] = h = out
        return states

    def logits(self, tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray | None,
               keep: dict | None = None) -> np.ndarray:
        kf, kr = ([], []) if keep is not None else (None, None)
        s = np.concatenate([self._side(tables[0], ids, mask, "f", kf), self._side(tables[1], ids, mask, "r", kr)], 2)
        a = np.exp(np.clip(s @ self.p["v"], -20, 20))
        if mask is not None:
            a *= mask.T
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnd->nd", a, s)
        if keep is not None:
            keep |= {"s": s, "a": a, "pooled": pooled, "f": kf, "r": kr}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradients(self, words: list[bytes], ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        x, (word, char, weight) = self.inputs(words)
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        tables = (x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wr"] + self.p["cr"])
        k: dict = {}
        out = self.logits(tables, ids, mask, k)
        d = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)).astype(np.float32)
        g = {"w": k["pooled"].T @ d, "b": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["w"]
        da = np.einsum("tnd,nd->tn", k["s"], dpool)
        dlog = k["a"] * (da - (k["a"] * da).sum(0))
        g["v"] = np.einsum("tnd,tn->d", k["s"], dlog)
        ds = k["a"][:, :, None] * dpool + dlog[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        s2 = 2 * STATE
        for side, part in (("f", slice(0, STATE)), ("r", slice(STATE, None))):
            u, du = self.p["U" + side], np.zeros_like(self.p["U" + side])
            dtable = np.zeros_like(tables[0])
            dh = np.zeros((len(y), STATE), np.float32)
            for t, h, zr, q, new in reversed(k[side]):
                on = mask[:, t:t + 1].astype(np.float32)
                total = dh + ds[t][:, part]
                dnew = total * on
                z, r = zr[:, :STATE], zr[:, STATE:]
                an = dnew * (1 - z) * (1 - new * new)
                azr = np.concatenate([dnew * (h - new), an * q], 1) * zr * (1 - zr)
                dg = np.concatenate([azr, an * r], 1)
                du += h.T @ dg
                dh = total * (1 - on) + dnew * z + dg @ u.T
                np.add.at(dtable, ids[:, t], np.concatenate([azr, an], 1))
            g["U" + side], g["c" + side] = du, dtable.sum(0)
            g["W" + side] = x.T @ dtable
            dx += dtable @ self.p["W" + side].T
        dx = dx[:-1]
        g["Ew"], g["Ec"] = np.zeros_like(self.p["Ew"]), np.zeros_like(self.p["Ec"])
        np.add.at(g["Ew"], word, dx[:, :WIDTH])
        np.add.at(g["Ec"], char.ravel(), (weight[:, :, None] * dx[:, None, WIDTH:]).reshape(-1, WIDTH))
        return g


def windows_of(n: int) -> list[int]:
    """Starts of the windows over n steps; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def window_logits(net: Network, texts: list[str | None]) -> list[np.ndarray]:
    """The logit of every window of every text."""
    index = _Index()
    coded = [np.fromiter(map(index.__getitem__, w), np.int64, len(w)) for w in map(raw_words, texts)]
    if not index:
        return [np.empty(0) for _ in texts]
    pieces = [pieces_of(w) for w in index]
    count = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.cumsum(count) - count
    tables = net.tables([p for ps in pieces for p in ps])
    pad = int(count.sum())
    steps = []
    for c in coded:
        n = count[c]
        steps.append(first[c] if len(c) == n.sum() else
                     np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
    starts = [windows_of(len(x)) for x in steps]
    base = np.cumsum([0, *map(len, steps)])
    stream = np.concatenate([*steps, np.full(WINDOW, pad)])
    at = np.array([base[i] + s for i, ss in enumerate(starts) for s in ss], np.int64)
    size = np.array([min(WINDOW, len(x)) for x, ss in zip(steps, starts) for _ in ss], np.int64)
    out = np.empty(len(at), np.float32)
    reach = np.arange(WINDOW)
    for chosen, masked in ((np.flatnonzero(size == WINDOW), False), (np.flatnonzero(size < WINDOW), True)):
        for s in range(0, len(chosen), BATCH):
            part = chosen[s:s + BATCH]
            ids = stream[at[part, None] + reach]
            mask = reach < size[part, None] if masked else None
            out[part] = net.logits(tables, np.where(mask, ids, pad) if masked else ids, mask)
    ends = np.cumsum([0, *map(len, starts)])
    return [out[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _all_logits(net: Network, texts: list[str]) -> list[np.ndarray]:
    return [x for batch in by_bytes(texts, len, TEXT_BYTES // 4) for x in window_logits(net, batch)]


def _hints(net: Network, docs: list[list[bytes]], y: np.ndarray) -> None:
    """Start the embeddings with the log odds of words and pieces among the training documents."""
    for name, rows, part in (("Ew", WORD_ROWS, 0), ("Ec", CHAR_ROWS, 1)):
        seen = np.zeros((2, rows))
        for d, label in zip(docs, y):
            if d:
                h = hashed(sorted(set(d)))
                seen[int(label), np.unique(h[0] if part == 0 else h[1][h[2]])] += 1
        rate = (seen + 0.5) / (np.array([(y == 0).sum(), (y == 1).sum()])[:, None] + 1.0)
        net.p[name][:, 0] += np.clip(np.log(rate[1] / rate[0]), -3, 3).astype(np.float32) * (seen.sum(0) > 2)


def train(texts: list[str], labels: list[int], epochs: int = 4, rounds: int = 2, rate: float = 0.015,
          seed: int = 5) -> Network:
    """Fit on documents of which only the whole is labelled.

    The most suspicious window of a document stands for it (chosen by the hints first, by the
    network itself in later rounds), for clean documents besides one at random. Adam updates.
    At the end the bias is moved so that a score of 0.5 lies in the gap where the training documents
    of both classes are parted best, by the maxima over all their windows.
    Without both classes the untrained network is returned with a bias that scores 0.
    """
    net, rng = Network(), np.random.default_rng(seed)
    y = np.array(labels)
    one: dict[bytes, bytes] = {}
    docs = [[one.setdefault(p, p) for p in steps_of(t)] for t in texts]
    if len(set(labels)) < 2:
        net.p["w"][:] = 0
        net.p["b"][0] = -30
        return net
    _hints(net, docs, y)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        if turn:
            picked = [int(np.argmax(s)) if len(s) else 0 for s in _all_logits(net, texts)]
        else:
            picked = []
            for d in docs:
                x, _ = net.inputs(d) if d else (np.zeros((1, 2 * WIDTH)), None)
                hint = x[:, 0] + x[:, WIDTH]
                picked.append(int(np.argmax([hint[s:s + WINDOW].max() for s in windows_of(len(d))])) if d else 0)
        rows: list[tuple[list[bytes], int]] = []
        for d, label, best in zip(docs, labels, picked):
            starts = windows_of(len(d))
            if starts:
                rows.append((d[starts[best]:starts[best] + WINDOW], label))
                for _ in range(0 if label or len(starts) == 1 else 1):
                    s = starts[int(rng.integers(len(starts)))]
                    rows.append((d[s:s + WINDOW], 0))
        for _ in range(max(epochs, MIN_STEPS * 256 // max(1, len(rows)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), 256):
                chosen = [rows[i] for i in order[at:at + 256]]
                words = sorted({w for r, _ in chosen for w in r})
                index = {w: i for i, w in enumerate(words)}
                ids = np.full((len(chosen), WINDOW), len(words), np.int32)
                for i, (r, _) in enumerate(chosen):
                    ids[i, :len(r)] = [index[w] for w in r]
                g = net.gradients(words, ids, ids != len(words), np.array([c[1] for c in chosen], np.float32))
                step += 1
                for k, v in g.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v * v - second[k])
                    net.p[k] -= (rate * first[k] / (1 - 0.9 ** step)
                                 / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    tops = np.array([w.max() if len(w) else -30.0 for w in _all_logits(net, texts)])
    net.p["b"][0] -= _parting(tops, y)
    return net


def _parting(tops: np.ndarray, y: np.ndarray) -> float:
    """A value in the gap between neighbouring values that divides the classes best.

    It lies nearer to the toxic side, as clean text is by far more varied.
    """
    order = np.argsort(tops, kind="stable")
    tops, y = tops[order], y[order]
    right = np.cumsum(y == 0) / (y == 0).sum() + 1 - np.cumsum(y == 1) / (y == 1).sum()
    best = np.flatnonzero(right[:-1] >= right[:-1].max() - 1e-12)
    widest = best[np.argmax(tops[best + 1] - tops[best])]
    return float(0.35 * tops[widest] + 0.65 * tops[widest + 1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Network:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    The sample is at most 2 * ROWS_PER_CLASS rows of at most TRAIN_BYTES bytes; only texts
    and labels are looked at.
    """
    sample = labelled_sample(docs, labels, label, key, text, ROWS_PER_CLASS, TRAIN_BYTES)
    rows = sorted(sample.collect(), key=lambda r: str(r.k))
    return train([r.t for r in rows], [int(r.y) for r in rows])


def with_score(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of the most toxic of all overlapping windows of every text.

    Null, empty and blank texts have no window and score 0. A column named ``out`` is
    replaced, all others stay. The network, of fixed size, goes with the function.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)

    @giving_back
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in columns:
            scores = []
            for batch in by_bytes((t.as_py() for t in column), len, TEXT_BYTES):
                for logits in window_logits(model, batch):
                    top = float(np.clip(logits.max(), -30, 30)) if len(logits) else None
                    scores.append(0.0 if top is None else 1.0 / (1.0 + np.exp(-top)))
            yield pa.array(scores, pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(run, "double")(F.coalesce(quoted(text), F.lit(""))))


def score(df: DataFrame, net: Network, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``key``, held_out, score, predicted: one row per input row. Extra columns are ignored."""
    rows = with_score(df.select(quoted(key).alias("k"), quoted(text).alias("t")), net, "t")
    return rows.select(F.col("k").alias(key), (F.coalesce(fold("k"), F.lit(0)) == 0).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
