"""Toxicity scores from a bidirectional gated recurrent network, trained in numpy.

Words (runs of ASCII letters, digits, apostrophes and non-ASCII bytes, ASCII
in lower case) enter with word and character inputs: a learned vector of the
word, the mean of the learned vectors of its byte 4-grams, the log odds of the
word, and the largest and mean log odds of its byte 4-grams and 5-grams. A GRU
reads each window of WINDOW words in both directions; attention pools its
states and a logistic unit scores the window. Windows overlap by half and cover
the whole text; a text's score is that of its highest window.

The log odds and the network are fitted on the whole texts of a bounded sample
of labelled rows (TRAIN_DOCS of each class). While the network is trained, the
log odds of a text's words come from the other half of the sample, so that they
mean the same on texts never seen, and the learned vectors of half of the
windows are left out, so that the network doesn't rely on words it knows.
Training takes EPOCHS times STEPS steps, however many rows there are.

Null and empty texts, and texts without words, are scored as one empty window.
Very long texts are scored whole, WINDOWS windows at a time. Labels that are
null teach nothing; an id with several labels is toxic if one says so. If there
is no label of either class, all scores are 0. Repeated rows and null ids pass
through, columns of other names are left out, and a score of exactly 0.5 is
predicted as 1. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm._common import held_out, lean, table

WINDOW, STRIDE = 32, 16
#: Inputs of a word: numbers that are fitted, and the vectors of the word and of its characters.
FITTED, VECTOR = 6, 4
HIDDEN, INPUTS = 8, FITTED + 2 * VECTOR
TRAIN_DOCS = {1: 1500, 0: 2500}
EPOCHS, STEPS, BATCH = 10, 60, 128
BUCKETS = 1 << 17
#: Learned vectors have fewer buckets: the high bits of the others.
VECTORS, FEWER = 1 << 13, 4
VECTOR_RATE = 0.02
#: Bytes of text, and windows, that are worked on at once.
BLOCK, WINDOWS = 1 << 20, 1 << 11
SCORED = "doc_id long, held_out boolean, score double, predicted int"

_rng = np.random.RandomState(7)
_HASH = _rng.randint(0, 2**32, (16, 256), np.uint64).astype(np.uint32)
_KIND = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), 39, *range(128, 256)]:
    _KIND[_b] = _b
for _b in range(65, 91):
    _KIND[_b] = _b + 32


@dataclass
class Words:
    """The words of some text: the hash bucket of each, and of each byte's 4- and 5-gram."""

    word: np.ndarray
    length: np.ndarray
    gram4: np.ndarray
    gram5: np.ndarray
    cuts: np.ndarray  # begin and end of each word, in turn
    start: np.ndarray


def split(raw: bytes) -> Words:
    data = _KIND[np.frombuffer(raw + b" ", np.uint8)]
    inside = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    start, stop = edge[::2], edge[1::2]
    cuts = np.stack([start, stop], 1).ravel()
    begin = np.zeros(len(data), np.int32)
    begin[start] = start
    place = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(begin)
    top = np.uint32(32 - 17)
    hashed = _HASH[place & 15, data]
    word = np.add.reduceat(hashed, cuts, dtype=np.uint32)[::2] if len(cuts) else np.zeros(0, np.uint32)
    word = (word * np.uint32(2654435761)) >> top
    x = np.concatenate([np.full(4, 32, np.uint8), data]).astype(np.uint32)
    n = len(data)
    four = x[1 : n + 1] << 24 | x[2 : n + 2] << 16 | x[3 : n + 3] << 8 | x[4:]
    gram4 = (four * np.uint32(2246822519)) >> top
    gram5 = ((four ^ (x[:n] * np.uint32(3266489917))) * np.uint32(668265263)) >> top
    # A gram may reach back to the blank before its word, no further; bucket 0 stands for none.
    gram4[(place < 2) | ~inside] = 0
    gram5[(place < 3) | ~inside] = 0
    return Words(word, stop - start, gram4, gram5, cuts, start)


@dataclass
class Odds:
    """Log odds by bucket, of words and of 4- and 5-grams."""

    word: np.ndarray
    gram4: np.ndarray
    gram5: np.ndarray

    @classmethod
    def fit(cls, docs: Iterable[Words], labels: np.ndarray) -> Odds:
        """From documents, which are looked at one at a time."""
        kinds = ("word", "gram4", "gram5")
        counts = {k: np.zeros((2, BUCKETS)) for k in kinds}
        for d, y in zip(docs, labels):
            for k in kinds:
                counts[k][y, np.unique(getattr(d, k))] += 1
        n = np.maximum(1, np.bincount(labels, minlength=2))
        base = (2.0 / n).max()
        made = []
        for k, count in counts.items():
            rate = count / n[:, None]
            odds = np.log(rate[1] + base) - np.log(rate[0] + base)
            odds *= count.sum(0) / (count.sum(0) + 3)
            odds[0] *= k == "word"
            made.append(np.clip(odds, -3, 5).astype(np.float32) / 2)
        return cls(*made)


def fitted(words: Words, odds: Odds) -> np.ndarray:
    """One row of FITTED numbers for each word."""
    out = np.zeros((len(words.word), FITTED), np.float32)
    if len(out):
        g4, g5 = odds.gram4[words.gram4], odds.gram5[words.gram5]
        out[:, 0] = odds.word[words.word]
        out[:, 1] = np.maximum.reduceat(g4, words.cuts)[::2]
        out[:, 2] = np.maximum.reduceat(g5, words.cuts)[::2]
        out[:, 3] = np.add.reduceat(g4, words.cuts)[::2] / words.length
        out[:, 4] = np.minimum(words.length, 24) / 24
        out[:, 5] = 1
    return out


def _means(grams: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean vector of each word's 4-grams; cuts: begin and end of each word in grams, in turn."""
    if not len(cuts):
        return np.zeros((0, table.shape[1]), np.float32)
    n = (cuts[1::2] - cuts[::2]).astype(np.float32)
    return np.stack([np.add.reduceat(np.append(c[grams], np.float32(0)), cuts)[::2] / n for c in np.ascontiguousarray(table.T)], 1)


def inputs(words: Words, odds: Odds, network: Network) -> np.ndarray:
    """One row of INPUTS numbers for each word."""
    return np.concatenate([fitted(words, odds), network.p["words"][words.word >> FEWER], _means(words.gram4 >> FEWER, words.cuts, network.p["chars"])], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """GRU cells in both directions, attention and a logistic unit; gradients by hand."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.RandomState(seed)
        h = HIDDEN
        # The first matrix of each pair reads forwards, the second backwards.
        self.p = {
            "W": (r.randn(2, INPUTS, 3 * h) / INPUTS**0.5).astype(np.float32),
            "U": (r.randn(2, h, 3 * h) / h**0.5).astype(np.float32),
            "c": np.zeros((2, 1, 3 * h), np.float32),
            "att": (r.randn(2 * h) * 0.1).astype(np.float32),
            "out": (r.randn(2 * h) / (2 * h) ** 0.5).astype(np.float32),
            "bias": np.zeros(1, np.float32),
            "words": np.zeros((VECTORS, VECTOR), np.float32),
            "chars": np.zeros((VECTORS, VECTOR), np.float32),
        }

    def _read(self, x: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States [T, B, 2 * HIDDEN] of both directions; x is [T, B, INPUTS] and mask [T, B, 1] or None."""
        w, u, c, h = self.p["W"], self.p["U"], self.p["c"], HIDDEN
        steps, many = x.shape[:2]
        given = (x.reshape(1, -1, INPUTS) @ w + c).reshape(2, steps, many, 3 * h)
        state = np.zeros((2, many, h), x.dtype)
        states = np.empty((steps, many, 2 * h), x.dtype)
        here = np.empty((2, many, 3 * h), x.dtype)
        for t in range(steps):
            back = steps - 1 - t
            here[0], here[1] = given[0, t], given[1, back]
            own = state @ u
            gates = _sigmoid(here[:, :, : 2 * h] + own[:, :, : 2 * h])
            z, r = gates[:, :, :h], gates[:, :, h:]
            new = np.tanh(here[:, :, 2 * h :] + r * own[:, :, 2 * h :])
            after = new + z * (state - new)
            if mask is not None:
                after = state + np.stack([mask[t], mask[back]]) * (after - state)
            if keep is not None:
                keep.append((state, z, r, new, own[:, :, 2 * h :]))
            states[t, :, :h], states[back, :, h:] = after
            state = after
        return states

    def _pool(self, states: np.ndarray, mask: np.ndarray | None):
        e = states @ self.p["att"]
        if mask is not None:
            e = np.where(mask[:, :, 0] > 0, e, np.float32(-30))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return a, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        return self._pool(self._read(x, mask), mask)[2]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean weighted log loss, its gradients but for the vectors', and that of x."""
        kept: list = []
        states = self._read(x, mask, kept)
        a, pooled, logit = self._pool(states, mask)
        p = _sigmoid(logit)
        loss = float(-np.mean(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))))
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("words", "chars")}
        d_logit = (weight * (p - y) / len(y)).astype(x.dtype)
        g["out"], g["bias"][0] = pooled.T @ d_logit, d_logit.sum()
        d_pooled = d_logit[:, None] * self.p["out"]
        d_a = np.einsum("bh,tbh->tb", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_e *= mask[:, :, 0]
        g["att"] = np.einsum("tb,tbh->h", d_e, states)
        d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * self.p["att"]
        h, u = HIDDEN, self.p["U"].transpose(0, 2, 1)
        steps, many = x.shape[:2]
        given = np.empty((2, steps, many, 3 * h), x.dtype)
        inner = np.empty((2, many, 3 * h), x.dtype)
        back = np.zeros((2, many, h), x.dtype)
        for t in range(steps - 1, -1, -1):
            state, z, r, new, own = kept[t]
            other = steps - 1 - t
            there = np.stack([mask[t], mask[other]])
            total = back + np.stack([d_states[t, :, :h], d_states[other, :, h:]])
            after = total * there
            d_new = after * (1 - z) * (1 - new**2)
            inner[:, :, :h] = after * (state - new) * z * (1 - z)
            inner[:, :, h : 2 * h] = d_new * own * r * (1 - r)
            inner[:, :, 2 * h :] = d_new * r
            given[0, t], given[1, other] = inner
            given[0, t, :, 2 * h :], given[1, other, :, 2 * h :] = d_new
            g["U"] += state.transpose(0, 2, 1) @ inner
            back = total * (1 - there) + after * z + inner @ u
        flat = given.reshape(2, -1, 3 * h)
        g["W"] = x.reshape(1, -1, INPUTS).transpose(0, 2, 1) @ flat
        g["c"] = flat.sum(1, keepdims=True)
        d_x = (flat @ self.p["W"].transpose(0, 2, 1)).sum(0).reshape(x.shape)
        return loss, g, d_x


def windows(n: int) -> np.ndarray:
    """First words of the windows that cover n words; at least one."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _take(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Windows as [T, B, INPUTS], and a mask where words are missing; x has a last row of zeros."""
    at = starts + np.arange(WINDOW)[:, None]
    there = at < ends
    rows = x[np.where(there, at, len(x) - 1)]
    return rows, None if there.all() else there[:, :, None].astype(np.float32)


class Scorer:
    """Log odds and network together."""

    def __init__(self, odds: Odds | None, network: Network | None) -> None:
        self.odds, self.network = odds, network

    def _window_logits(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of some texts, and how many each text has; x: their words and a row of zeros."""
        first = np.cumsum(lengths) - lengths
        own = [windows(n) for n in lengths]
        starts = np.concatenate([w + a for w, a in zip(own, first)])
        many = np.array([len(w) for w in own])
        ends = np.repeat(first + lengths, many)
        out = np.empty(len(starts), np.float32)
        full = starts + WINDOW <= ends
        for group in (np.flatnonzero(full), np.flatnonzero(~full)):  # whole windows need no mask
            for a in range(0, len(group), WINDOWS):
                part = group[a : a + WINDOWS]
                out[part] = self.network.logits(*_take(x, starts[part], ends[part]))
        return out, many

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's score of each whole text."""
        if self.network is None:
            return np.zeros(len(texts))
        out, held, size = np.empty(len(texts)), [], 0

        def flush(stop: int) -> None:
            nonlocal held, size
            if held:
                logit, many = self._window_logits(np.concatenate([*held, np.zeros((1, INPUTS), np.float32)]), np.array([len(g) for g in held], np.int64))
                out[stop - len(held) : stop] = _sigmoid(np.maximum.reduceat(logit, np.cumsum(many) - many).astype(np.float64))
            held, size = [], 0

        for k, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "surrogatepass")
            held.append(np.concatenate([inputs(split(piece), self.odds, self.network) for piece in _pieces(raw)]))
            size += len(raw)
            if size >= BLOCK:
                flush(k + 1)
        flush(len(texts))
        return out


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text cut at blanks, so that memory for its characters is bounded."""
    a = 0
    while len(raw) - a > BLOCK:
        cut = raw.rfind(b" ", a + BLOCK // 2, a + BLOCK) + 1 or a + BLOCK
        yield raw[a:cut]
        a = cut
    yield raw[a:]


class Lesson:
    """The words of the training texts, one text after the other, with their grams."""

    def __init__(self, read: Iterable[Words], numbers: Iterable[np.ndarray]) -> None:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        at = 0
        for w, x in zip(read, numbers):
            # Few bytes a word, as all training texts are held at once.
            for own, c in zip(columns, ((w.word >> FEWER).astype(np.uint16), (w.gram4 >> FEWER).astype(np.uint16), (w.cuts + at).astype(np.uint32), x.astype(np.float16))):
                own.append(c)
            at += len(w.gram4)
        self.lengths = np.array([len(w) for w in columns[0]], np.int64)
        # A last word of zeros stands where a window is longer than its text.
        rest = (np.zeros(1, np.uint16), np.zeros(1, np.uint16), np.array([at, at + 1], np.uint32), np.zeros((1, FITTED), np.float16))
        made = []
        for own, last in zip(columns, rest):
            made.append(np.concatenate([*own, last]))
            own.clear()
        self.word, self.gram, self.cuts, self.given = made

    def rows(self, words: slice, network: Network) -> np.ndarray:
        """All inputs of words that follow each other, and a row of zeros."""
        cuts = self.cuts[2 * words.start : 2 * words.stop].astype(np.int64)
        grams = self.gram[cuts[0] : cuts[-1]] if len(cuts) else self.gram[:0]
        made = np.concatenate([self.given[words].astype(np.float32), network.p["words"][self.word[words]], _means(grams, cuts - cuts[0] if len(cuts) else cuts, network.p["chars"])], 1)
        return np.concatenate([made, np.zeros((1, INPUTS), np.float32)])

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram, which of the words it belongs to)."""
        begin, end = self.cuts[2 * words].astype(np.int64), self.cuts[2 * words + 1].astype(np.int64)
        n = end - begin
        of = np.repeat(np.arange(len(words)), n)
        return self.gram[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + begin[of]], of


def _window_ranks(lesson: Lesson, scorer: Scorer) -> np.ndarray:
    """The logits of all windows of the training texts."""
    ends = np.cumsum(lesson.lengths)
    out, a = [], 0
    while a < len(ends):
        begin = ends[a] - lesson.lengths[a]
        b = max(a + 1, int(np.searchsorted(ends, begin + BLOCK // 8, "right")))
        out.append(scorer._window_logits(lesson.rows(slice(begin, ends[b - 1]), scorer.network), lesson.lengths[a:b])[0])
        a = b
    return np.concatenate(out)


def _spread(rows: np.ndarray, grads: np.ndarray) -> np.ndarray:
    """Gradients of a table's rows, summed."""
    return np.stack([np.bincount(rows, c, VECTORS) for c in grads.T], 1).astype(np.float32)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Scorer:
    """Odds from both halves, and a network trained on windows with odds from the other half."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Scorer(None, None)
    half = np.arange(len(texts)) % 2
    read = lambda t: split(t.encode("utf-8", "surrogatepass"))  # noqa: E731  texts are split anew each time, to hold little
    pairs = [Odds.fit((read(t) for t, f in zip(texts, half) if f == k), y[half == k]) for k in (0, 1)]
    words = (read(t) for t in texts)
    twice = itertools.tee(words)
    lesson = Lesson(twice[0], (fitted(w, pairs[1 - f]) for w, f in zip(twice[1], half)))
    network = Network()
    scorer = Scorer(None, network)
    lengths = lesson.lengths
    first = np.cumsum(lengths) - lengths
    own = [windows(n) for n in lengths]
    many = np.array([len(w) for w in own])
    begin = np.cumsum(many) - many
    starts = np.concatenate([w + a for w, a in zip(own, first)])
    ends = np.repeat(first + lengths, many)
    # To begin with, a text is judged by the window with the largest odds.
    evidence = np.concatenate([[0], np.cumsum(np.maximum(lesson.given[:-1, 0], 0) + np.maximum(lesson.given[:-1, 2], 0), dtype=np.float64)])
    rank = evidence[np.minimum(starts + WINDOW, ends)] - evidence[starts]
    del evidence
    r = np.random.RandomState(5)
    weight = np.where(y == 1, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, (1 - y).sum()))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items() if k not in ("words", "chars")}
    squares = {k: np.full_like(network.p[k], 1e-6) for k in ("words", "chars")}
    clean = np.flatnonzero(y == 0)
    step = 0
    for epoch in range(epochs):
        top = begin + np.array([rank[b : b + m].argmax() for b, m in zip(begin, many)])
        other = begin + r.randint(0, many)
        chosen = np.concatenate([top, other[clean]])
        target, w = np.concatenate([y, y[clean]]), np.concatenate([weight, weight[clean] * 0.3])
        rate = 1 - 0.8 * epoch / epochs
        order = np.concatenate([r.permutation(len(chosen)) for _ in range(-(-STEPS * BATCH // len(chosen)))])
        for a in range(0, STEPS * BATCH, BATCH):
            k = order[a : a + BATCH]
            at = starts[chosen[k]] + np.arange(WINDOW)[:, None]
            there = at < ends[chosen[k]]
            at = np.where(there, at, len(lesson.word) - 1)
            mask = there[:, :, None].astype(np.float32)
            keep = (r.rand(1, len(k), 1) < 0.5) * mask
            flat = at.ravel()
            gram, of = lesson.grams_of(flat)
            size = np.bincount(of, minlength=len(flat)).astype(np.float32)[:, None]
            chars = np.stack([np.bincount(of, c[gram], len(flat)) for c in network.p["chars"].T], 1) / size
            learned = np.concatenate([network.p["words"][lesson.word[flat]], chars], 1).reshape(WINDOW, len(k), 2 * VECTOR)
            x = np.concatenate([lesson.given[at], learned * keep], 2).astype(np.float32)
            _, g, d_x = network.gradients(x, mask, target[k].astype(np.float32), w[k].astype(np.float32))
            step += 1
            for name, grad in g.items():
                m, v = moment[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                network.p[name] -= (0.01 * rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            d_x = (d_x[:, :, FITTED:] * keep).reshape(len(flat), -1)
            for name, grad in (("words", _spread(lesson.word[flat], d_x[:, :VECTOR])), ("chars", _spread(gram, (d_x[:, VECTOR:] / size)[of]))):
                squares[name] += grad**2
                network.p[name] -= VECTOR_RATE * rate * grad / np.sqrt(squares[name])
        if epoch % 2:  # windows are judged anew after every other epoch
            rank = _window_ranks(lesson, scorer)
    # The mean of both halves' odds has the scale that the network was trained on.
    scorer.odds = Odds(*((getattr(pairs[0], k) + getattr(pairs[1], k)) / 2 for k in ("word", "gram4", "gram5")))
    return scorer


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The training rows: of each class those with the smallest hash of their id.

    Counts over all labels give a hash bound under which enough rows lie; the
    sample that reaches the driver is bounded by TRAIN_DOCS. An id with several
    labels is toxic if one of them says so.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    marks = marks.where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = 1 << 30
    bound = {k: int(scale * min(1.0, (m + 6 * m**0.5) / max(1, counts.get(k, 0)))) + 1 for k, m in TRAIN_DOCS.items()}
    place = F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(scale))
    few = marks.withColumn("_place", place).where(F.col("_place") < F.when(F.col("_toxic") == 1, bound[1]).otherwise(bound[0]))
    # At most about 5,500 rows are left, whatever the size of the labels.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    found = sorted({(r["_place"], r["doc_id"], r["text"] or "", r["_toxic"]) for r in rows.collect()})
    texts, marked = [], []
    left = dict(TRAIN_DOCS)
    for _, _, text, toxic in found:
        if left[toxic]:
            left[toxic] -= 1
            texts.append(text)
            marked.append(toxic)
    return texts, marked


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                s = shared.value.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(*sample(docs, table(spark, sf_dir, "labels"))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the others go."""
    scorer = fit(*sample(docs, table(spark, sf_dir, "labels")))
    shared = spark.sparkContext.broadcast(scorer)
    names = ["doc_id", "text", "lang", "source", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array(shared.value.score(part.column("text").to_pylist()) < 0.5))

    return docs.select(*names).mapInArrow(lean(run), docs.select(*names).schema)
