"""SentencePiece encoding and decoding that keeps source offsets.

A text is normalised by longest-prefix matching in the model's compiled
character map. Every normalised character remembers the source bytes that it
was made from, so every piece can be projected to a byte span of the original
text. Merges follow the model's piece scores; characters without a piece fall
back to byte pieces. The model is read with the sentencepiece library, but the
normalisation, the merging, the spans and the decoding are done here.

Null text is empty: no pieces. Repeated rows and null ids pass through.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm._common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose pieces are remembered, for each worker; then it begins anew.
REMEMBERED = 600_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Normalizer:
    """The compiled character map and the switches that go with it."""

    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    keys: dict[str, str] = field(default_factory=dict, init=False)
    longest: int = field(default=0, init=False)

    @classmethod
    def of(cls, model: bytes) -> Normalizer:
        """From a serialised model: field 3 holds the normaliser."""
        spec = dict(_fields(dict(_fields(model)).get(3, b"")))
        return cls(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    def __post_init__(self) -> None:
        if not self.charsmap:
            return
        # A double array trie of 32-bit units: every key with the place of its replacement.
        (n,) = struct.unpack_from("<I", self.charsmap)
        units = struct.unpack_from(f"<{n // 4}I", self.charsmap, 4)
        strings = self.charsmap[4 + n :]
        shift = lambda u: (u >> 10) << ((u & 512) >> 6)
        todo = [(shift(units[0]), b"")]
        while todo:
            base, key = todo.pop()
            for c in range(1, 256):
                at = base ^ c
                if at < len(units) and units[at] & 0x800000FF == c:
                    below = at ^ shift(units[at])
                    if units[at] >> 8 & 1:
                        value = units[below] & 0x7FFFFFFF
                        self.keys[(key + bytes([c])).decode("utf-8", "surrogateescape")] = strings[value : strings.index(0, value)].decode()
                    todo.append((below, key + bytes([c])))
        self.longest = max(map(len, self.keys), default=0)
        self.first = {k[0] for k in self.keys}

    def plain(self, text: str) -> bool:
        """Whether no rule touches the text but that for blanks."""
        return not self.keys and not self.squeeze and self.escape and SPACE not in text

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the source byte where it begins."""
        out: list[str] = []
        at: list[int] = []
        done, spaced = 0, self.squeeze
        blank = SPACE if self.escape else " "
        k = 0

        def longest_prefix() -> tuple[str, int, int]:
            if text[k] in getattr(self, "first", ()):
                for n in range(min(self.longest, len(text) - k), 0, -1):
                    if (made := self.keys.get(text[k : k + n])) is not None:
                        return made, n, len(text[k : k + n].encode())
            return text[k], 1, len(text[k].encode())

        if self.squeeze:
            while k < len(text):
                made, n, size = longest_prefix()
                if made != " ":
                    break
                k, done = k + n, done + size
        if k < len(text) and self.dummy_prefix:
            out.append(blank)
            at.append(done)
        while k < len(text):
            made, n, size = longest_prefix()
            if spaced:
                made = made.lstrip(" ")
            for c in made:
                out.append(blank if c == " " else c)
                at.append(done)
            if made:
                spaced = made.endswith(" ") and self.squeeze
            k, done = k + n, done + size
        while self.squeeze and out and out[-1] == blank:
            done = at.pop()
            out.pop()
        return "".join(out), np.array([*at, done], np.int64)


class Codec:
    """A BPE model: ids, spans and text."""

    def __init__(self, path: str) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalizer = Normalizer.of(lib.serialized_model_proto())
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.unknown = lib.unk_id()
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.control = {i for i in range(n) if lib.is_control(i)}
        normal = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        if any(lib.is_unused(i) for i in normal):
            raise ValueError("a model with unused pieces is not supported")
        self.ids = {self.pieces[i]: i for i in normal}
        self.rank = {self.pieces[i]: -lib.get_score(i) for i in normal}
        joined = [p for p in self.rank if len(p) > 1]
        # A text falls apart before a blank that follows another character, if no piece has that
        # inside, and at characters that no longer piece holds: merges never cross these places.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in joined):
            self.segments = re.compile("(?s).+")
        else:
            alone = "" if any("\n" in p for p in joined) else "\n"
            # So it is between a letter or digit and a sign, but for the few that a piece joins to a sign.
            joins = {x for p in joined for x, y in zip(p, p[1:]) if x.isalnum() and not y.isalnum()}
            word = f"{SPACE}*[^\\W_{re.escape(''.join(sorted(joins)))}]+(?![^\\W_])"
            self.segments = re.compile(f"{word}|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else ""))
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        # The lengths in bytes of the source, where blanks are plain blanks.
        self.size = np.array([len(s.encode()) for s in self.surface], np.int64)
        self.byte_of = np.full(n, -1, np.int64)
        for b, i in self.byte_ids.items():
            self.byte_of[i] = b
            self.surface[i] = chr(0xDC00 + b)  # a lone surrogate stands for one byte until the end
        self.surface[self.unknown] = " ⁇ "
        for i in self.control:
            self.surface[i] = ""
        self.text_of_id = [str(i) for i in range(n)]
        self.known: dict[str, tuple[int, ...]] = {}

    def _symbols(self, segment: str) -> list[str]:
        """Merge neighbours, best score first, leftmost first among equals."""
        symbols = list(segment)
        if len(symbols) > 64:
            return self._symbols_of_long(symbols)
        rank, none = self.rank.get, math.inf
        # The rank of each neighbouring pair; a merge changes two of them.
        pairs = [rank(a + b, none) for a, b in zip(segment, segment[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            symbols[i] += symbols.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(symbols[i] + symbols[i + 1], none)
            if i:
                pairs[i - 1] = rank(symbols[i - 1] + symbols[i], none)
        return symbols

    def _symbols_of_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap, for segments of any length."""
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != made:
                continue
            symbols[i], symbols[j], after[i] = made, "", after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(made + symbols[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, made + symbols[after[i]]))
            if before[i] >= 0 and (r := rank.get(symbols[before[i]] + made)) is not None:
                heapq.heappush(heap, (r, before[i], symbols[before[i]] + made))
        return [s for s in symbols if s]

    def _segment_ids(self, segment: str) -> tuple[int, ...]:
        out: list[int] = []
        for s in self._symbols(segment):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode()]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(segment) <= 64:
            self.known[segment] = tuple(out)
        return tuple(out)

    def _ids(self, normal: str) -> list[int]:
        known, make = self.known, self._segment_ids
        found = [known.get(s) or make(s) for s in self.segments.findall(normal)]
        return list(chain.from_iterable(found))

    def encode(self, text: str) -> list[int]:
        return self.encode_with_spans(text)[0]

    def encode_with_spans(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and for each piece the (begin, end) of its bytes in the text.

        Of the byte pieces of one character, the last has the character's span
        and those before it are empty, as in the library.
        """
        if not text:
            return [], np.zeros((0, 2), np.int64)
        if self.normalizer.plain(text):
            ids = self._ids((SPACE if self.normalizer.dummy_prefix else "") + text.replace(" ", SPACE))
            a = np.array(ids)
            size = self.size[a]
            ends = self._byte_ends(a)
            if ends is not None:
                size[self.byte_of[a] >= 0] = 0
                size[ends[0]] = ends[1]
            size[0] -= self.normalizer.dummy_prefix
            stop = np.cumsum(size)
            return ids, np.stack([stop - size, stop], 1)
        normal, at = self.normalizer(text)
        ids = self._ids(normal)
        a = np.array(ids, np.int64)
        n_chars = np.array([len(p) for p in self.pieces], np.int64)[a]
        ends = self._byte_ends(a)
        if ends is not None:
            n_chars[self.byte_of[a] >= 0] = 0
            n_chars[ends[0]] = 1
        stop = np.cumsum(n_chars)
        return ids, np.stack([at[stop - n_chars], at[stop]], 1)

    def _byte_ends(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The places of the last byte piece of each character, and its bytes."""
        value = self.byte_of[a]
        lead = np.flatnonzero((value >= 0) & ((value < 0x80) | (value >= 0xC0)))
        if not len(lead):
            return None
        n = 1 + (value[lead] >= 0xC0) + (value[lead] >= 0xE0) + (value[lead] >= 0xF0)
        return lead + n - 1, n

    def decode(self, ids: list[int]) -> str:
        """The text of pieces; bytes that aren't UTF-8 become U+FFFD each."""
        parts = list(map(self.surface.__getitem__, ids))
        if self.normalizer.dummy_prefix or self.normalizer.squeeze:
            first = next((k for k, i in enumerate(ids) if i not in self.control), None)
            if first is not None and self.pieces[ids[first]].startswith(SPACE):
                parts[first] = parts[first].lstrip(" ") if self.normalizer.squeeze else parts[first][1:]
        text = "".join(parts)
        if not (self.byte_ids and _BYTES.search(text)):
            return text
        return _BYTES.sub(lambda m: _utf8(bytes(ord(c) - 0xDC00 for c in m[0])), text)


_BYTES = re.compile("[\udc00-\udcff]+")


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                n = 1
            k += n
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, once for each worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id with ids and spans (begin, end in bytes), as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or public_tokenizers.path(MODEL))
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                got = [own.encode_with_spans(t or "") for t in batch.column(1)[k : k + 64].to_pylist()]
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                cols = [pa.array([g[0] for g in got], kinds[0]), pa.array([g[1][:, 0] for g in got], kinds[1]), pa.array([g[1][:, 1] for g in got], kinds[2])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 64], *cols], names=["doc_id", "ids", "begins", "ends"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of ids, spans and the decoded text, by ENCODED.

    Made where the ids are, so that no token leaves its worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or public_tokenizers.path(MODEL))
        names = own.text_of_id
        for batch in batches:
            n, coded, plain, spans = [], [], [], []
            for text in batch.column(1):
                ids, where = own.encode_with_spans(text.as_py() or "")
                n.append(len(ids))
                coded.append(sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                plain.append(sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                spans.append(zlib.crc32(where.astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string()), pa.array(spans, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
