"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes deep is counted
once, on a bounded sample of labelled documents. A text's score in a language
is the exact code length that the frozen tree gives it: a byte seen after the
longest known context costs -log2(count / (total + distinct)); one not seen
costs the escape -log2(distinct / (total + distinct)) and is tried after the
next shorter context, down to equal shares for all 256 bytes. The shortest
code wins.

Trees are kept as tables over all languages: for each seen (context, byte) of
each depth a row of costs, escapes included, so that a byte takes one lookup
where its longest context is known.

The score is the winner's share of the odds that the exact code lengths give,
2^-bits over the sum of all languages' 2^-bits, whatever the text's length.

The language is 'und' with score 0 where the text is null or has no letter, or
where nothing could be learned. Rows with null lang or null text teach nothing.
Equal code lengths go to the first language by name. Repeated rows and null ids
pass through; other columns are left out. Very long texts are coded whole,
BLOCK bytes at a time. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm._common import held_out, lean, table

ORDER = 4
#: Each language's tree is fitted on the whole texts of at most so many documents.
TRAIN_DOCS = 200
#: More distinct values of lang than this are an error: each has a tree in every task.
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: Bytes that are scored at once: each takes some 80 bytes meanwhile, in every worker of an executor.
BLOCK = 1 << 18
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position from n - 1 on, as a number."""
    made = data[: len(data) - n + 1].astype(np.uint64)
    for k in range(1, n):
        made = (made << np.uint64(8)) | data[k : len(data) - n + 1 + k]
    return made


@dataclass
class Lookup:
    """Places of keys: two hash tables, and a sorted rest for what fits neither."""

    keys: np.ndarray
    bits: int = field(init=False)

    FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __post_init__(self) -> None:
        self.bits = max(8, int(len(self.keys) * 2).bit_length())
        self.tables = []
        left = np.arange(len(self.keys))
        for factor in self.FACTORS:
            slot = self._slot(self.keys[left], factor)
            place = np.full(1 << self.bits, -1, np.int32)
            place[slot[::-1]] = left[::-1]
            self.tables.append((factor, place))
            left = left[place[slot] != left]
        self.rest = left[np.argsort(self.keys[left])]
        self.rest_keys = self.keys[self.rest]
        self.padded = np.append(self.keys, np.uint64(2**64 - 1))

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys * factor) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        factor, place = self.tables[0]
        at = place[self._slot(keys, factor)]
        wrong = np.flatnonzero(self.padded[at] != keys)
        if len(wrong):
            at[wrong] = -1
            factor, place = self.tables[1]
            other = place[self._slot(keys[wrong], factor)]
            hit = self.padded[other] == keys[wrong]
            at[wrong[hit]] = other[hit]
            if len(self.rest):
                wrong = wrong[~hit]
                k = np.minimum(np.searchsorted(self.rest_keys, keys[wrong]), len(self.rest) - 1)
                hit = self.rest_keys[k] == keys[wrong]
                at[wrong[hit]] = self.rest[k[hit]]
        return at


class ContextTrees:
    """The frozen statistics of all languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER) -> None:
        self.languages, self.order = sorted(samples), order
        n = len(self.languages)
        pad = b"\0" * order
        data = [np.frombuffer(pad + pad.join(samples[x]), np.uint8) for x in self.languages]
        self.base = np.zeros((256, n), np.float32)
        for k, x in enumerate(data):
            # The padding is a context, never a coded byte.
            coded = np.concatenate([np.frombuffer(s, np.uint8) for s in samples[self.languages[k]]] or [x[:0]])
            c = np.bincount(coded, minlength=256).astype(np.float64)
            total, distinct = c.sum(), (c > 0).sum()
            escape = -np.log2(distinct / (total + distinct)) if distinct else 0.0
            with np.errstate(divide="ignore"):
                self.base[:, k] = np.where(c > 0, -np.log2(c / max(1.0, total + distinct)), escape + 8)
        #: For each depth: lookup of (context, byte), its costs, lookup of contexts, their escapes.
        self.levels: list[tuple[Lookup, np.ndarray, Lookup, np.ndarray]] = []
        for depth in range(1, order + 1):
            self.levels.append(self._level(data, samples, depth))

    def _level(self, data: list[np.ndarray], samples: dict[str, list[bytes]], depth: int):
        found = []
        for x, name in zip(data, self.languages):
            starts = np.cumsum([self.order] + [len(s) + self.order for s in samples[name]])[:-1]
            code = np.zeros(len(x), bool)
            for a, s in zip(starts, samples[name]):
                code[a : a + len(s)] = True
            found.append(np.unique(grams(x, depth + 1)[code[depth:]], return_counts=True))
        keys = np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.uint64)
        counts = np.zeros((len(keys), len(found)))
        for k, (own, c) in enumerate(found):
            counts[np.searchsorted(keys, own), k] = c
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((len(contexts), len(found))), np.zeros((len(contexts), len(found)))
        np.add.at(total, of, counts)
        np.add.at(distinct, of, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            coded = -np.log2(counts / (total + distinct)[of])
        lower = keys & np.uint64((1 << (8 * depth)) - 1)
        if depth == 1:
            below = self.base[lower.astype(np.int64)]
        else:
            below = self.levels[-1][1][self.levels[-1][0].find(lower)]  # a suffix of what was seen was seen
        costs = np.where(counts > 0, coded, escape[of] + below)
        return Lookup(keys), costs.astype(np.float32), Lookup(contexts), escape.astype(np.float32)

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte from place `order` on, in each language; the bytes before are context."""
        key = grams(data, self.order + 1)
        out = np.empty((len(key), len(self.languages)), np.float32)
        todo: np.ndarray | slice = slice(None)
        add: np.ndarray | float = 0.0
        for depth in range(self.order, 0, -1):
            lookup, costs, contexts, escapes = self.levels[depth - 1]
            here = key[todo] & np.uint64((1 << (8 * depth + 8)) - 1)
            at = lookup.find(here)
            if depth == self.order:
                out[:] = costs[at] if len(costs) else 0
                todo = np.flatnonzero(at < 0)
                here, add = here[todo], np.zeros((len(todo), out.shape[1]), np.float32)
            else:
                hit = at >= 0
                out[todo[hit]] = costs[at[hit]] + add[hit]
                todo, here, add = todo[~hit], here[~hit], add[~hit]
            if not len(todo):
                return out
            c = contexts.find(here >> np.uint64(8))
            add[c >= 0] += escapes[c[c >= 0]]
        out[todo] = self.base[(key[todo] & np.uint64(255)).astype(np.int64)] + add
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        sums = np.zeros((len(texts), len(self.languages)))
        pad = np.zeros(self.order, np.uint8)
        held, size, first = [], 0, 0

        def flush(stop: int) -> None:
            nonlocal held, size, first
            if not held:
                return
            each = self.costs(np.concatenate(held))
            lengths = [len(x) for x in held]
            # A piece's own costs begin after its context; those between pieces belong to padding.
            starts = np.cumsum([0, *lengths])[:-1]
            for k, (a, n) in enumerate(zip(starts, lengths)):
                if n > self.order:
                    sums[first + k] += each[a : a + n - self.order].sum(0, dtype=np.float64)
            held, size, first = [], 0, stop

        for k, text in enumerate(texts):
            x = np.concatenate([pad, np.frombuffer(text, np.uint8)])
            if len(x) > BLOCK:
                flush(k)
                for a in range(0, len(x) - self.order, BLOCK):
                    sums[k] += self.costs(x[a : a + BLOCK + self.order]).sum(0, dtype=np.float64)
                first = k + 1
                continue
            held.append(x)
            size += len(x)
            if size >= BLOCK:
                flush(k + 1)
        flush(len(texts))
        return sums

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits per byte); the score is the winner's share in odds of whole code lengths."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        bits = self.code_lengths(raw)
        best = bits.argmin(1)
        n = np.array([max(1, len(x)) for x in raw], np.float64)
        score = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
        out = []
        for t, b, s, x, m in zip(texts, best, score, bits.min(1), n):
            letter = t is not None and any(c.isalpha() for c in t)
            out.append((self.languages[b], float(s), float(x / m)) if letter else (UNKNOWN, 0.0, 0.0))
        return out


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS) -> dict[str, list[bytes]]:
    """The training texts of each language: those with the smallest hash of their id.

    Counts by language over all rows give a hash bound under which enough rows
    lie; only these come to the driver, about per_language of each language.
    More than MAX_LANGUAGES languages raise an error.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} distinct values")
    if not counts:
        return {}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("language")), F.lit(1 << 30))
    wanted = per_language + 6 * per_language**0.5 + 20
    bounds = docs.sparkSession.createDataFrame([(k, min(1 << 30, int((1 << 30) * min(1.0, wanted / n)) + 1)) for k, n in counts.items()], "_lang string, _bound long")
    few = known.withColumn("_place", place).join(F.broadcast(bounds), (F.col("lang") == F.col("_lang")) & (F.col("_place") < F.col("_bound")))
    rows = few.select("lang", "_place", "doc_id", "text").collect()
    found: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["_place"], r["doc_id"], r["text"])):
        own = found.setdefault(r["lang"], [])
        if len(own) < per_language:
            own.append(r["text"].encode("utf-8", "surrogatepass"))
    return found


def identify(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = shared.value.predict(part.column("text").to_pylist())
                cols = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *cols], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), PREDICTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, ContextTrees(sample(docs)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; lang becomes the prediction. Others go."""
    trees = ContextTrees(sample(docs))
    shared = spark.sparkContext.broadcast(trees)
    names = ["doc_id", "text", "lang", "source", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = shared.value.predict(part.column("text").to_pylist())
                lang = pa.array([p for p, _, _ in found], pa.string())
                keep = pa.array([p != UNKNOWN for p, _, _ in found], pa.bool_())
                made = pa.RecordBatch.from_arrays([lang if n == "lang" else part.column(n) for n in names], names=names)
                yield made.filter(keep)

    return docs.select(*names).mapInArrow(lean(run), docs.select(*names).schema)
