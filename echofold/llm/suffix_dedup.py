"""Removal of long strings that an earlier document holds, by suffix order.

Every byte is removed that is covered by a string of LENGTH bytes which also
starts in a document with a smaller doc_id. All of it is decided by longest
previous factors over the bytes themselves; hashes only choose which suffixes
meet:

1. Each window of LENGTH bytes has an anchor: the first of its GRAM-byte grams
   with the smallest hash. Equal windows have equal anchors at the same place
   inside, so documents share a window only if they share an anchor's gram.
   Windows next to each other with one anchor form a stretch. All texts are read
   once before that to count the grams with small hashes, which may be anchors;
   one that is more than one in 2^SHARE of them is an anchor only where a window
   has no other, so a common phrase doesn't gather what stands around it.
2. A task puts stretches with equal hashes in suffix order: of each group the
   previous and the next place with a smaller document give the longest
   previous factor, and a stretch that it covers whole is removed whole. What
   is not removed is dealt to buckets by gram.
3. In a bucket, each stretch that seems to stand in an earlier document as well
   is paired with the nearest such document, as a chain, so that a passage with
   very many copies gathers nowhere. Pairs that follow each other in both
   documents become one passage, whose text moves to the earlier document and
   is put in suffix order with it, stretch by stretch.
4. Where a gram occurs in several different stretches, the first of each may
   still share single windows with another: their texts meet in the bucket, and
   all their windows are put in suffix order.

Grams with very many different stretches are dealt out window by window
instead. Two strings that share a gram and a 48-bit hash but differ raise an
error: nothing is removed, or kept, by hash alone.

A null text is empty. Null ids come after all others and are not smaller than
each other. Rows that share a doc_id are one document: what is found in one is
removed from each, as far as it reaches. Very long texts are worked on whole,
BLOCK windows at a time. Other columns are left out. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import _common
from echofold.llm._common import lean, table, written
from echofold.llm._packed import from_planes, mix, pack, planes, runs, unpack

LENGTH, GRAM = 50, 24
#: Bytes of a stretch at most: its windows share an anchor.
WIDTH = 2 * LENGTH - GRAM
#: Windows of a text that are worked on at once, and stretches that are dealt out at once.
BLOCK, FLUSH = 1 << 18, 400_000
#: From so many different stretches with one gram on, they are dealt out window by window.
MANY = 20_000
#: Windows that are put in order at once.
SLICE = 100_000
LAST_ID = 2**63 - 1
#: Grams with a hash below 1 << SMALL, a quarter of all, are counted: of a window's 27 nearly always the anchor is one.
SMALL = 62
#: Of these, more than one in 2^SHARE makes a gram hot; so many bits of a hash below 1 << SMALL find it in a table.
SHARE, HOT_BITS = 18, 22
#: Grams that are counted at once, and how many equal ones of them are worth a report.
COUNTED, REPORTED = 1 << 21, 8

_rng = np.random.RandomState(97)
_BYTE = _rng.randint(0, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64; kept and doubled as needed."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each gram, sums of bytes times powers, and powers of the inverse."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=sums[1:])
    back = powers(_INVERSE, n)
    return mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1]), sums, back


def _hot_place(gram: np.ndarray) -> np.ndarray:
    """Where the table of hot grams has a gram; large hashes have its last place, which is never hot."""
    return np.minimum(gram >> np.uint64(SMALL - HOT_BITS), np.uint64(1 << HOT_BITS)).astype(np.int64)


def stretches(data: np.ndarray, ends: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, further windows, gram hash, text hash) of each stretch.

    data holds texts one after the other, ends where each ends; windows lie
    within one text. The text hash covers the whole stretch, from its first
    window's first byte to its last window's last byte. hot is the table
    of grams that come after all others; whatever it holds, equal windows have
    equal anchors.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram, sums, back = grams(data)
    # Hash and place in one number: the smallest is the first of those with the smallest hash.
    place_bits = np.uint64((1 << 24) - 1)
    least = gram >> np.uint64(1)
    if hot is not None:
        least |= hot[_hot_place(gram)].astype(np.uint64) << np.uint64(63)
    least = (least & ~place_bits) | np.arange(len(gram), dtype=np.uint64)
    wide, reach = least, 1
    span = LENGTH - GRAM + 1
    while reach * 2 <= span:
        wide = np.minimum(wide[:-reach], wide[reach:])
        reach *= 2
    if reach < span:
        wide = np.minimum(wide[: len(least) - span + 1], wide[span - reach :])
    anchor = (wide & place_bits).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for e in ends[:-1]:
        inside[max(0, e - LENGTH + 1) : e] = False
    first = np.flatnonzero(inside & np.append(True, (anchor[1:] != anchor[:-1]) | ~inside[:-1]))
    last = np.flatnonzero(inside & np.append((anchor[1:] != anchor[:-1]) | ~inside[1:], True))
    text = mix(((sums[last + LENGTH] - sums[first]) * back[first]) ^ (last - first).astype(np.uint64))
    return first, last - first, gram[anchor[first]], text


def _pieces(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(document, where in it, bytes) of texts with windows, about `block` bytes at a time; of a long text several pieces."""
    for batch in batches:
        group, many = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
            # Each piece has all bytes of its windows.
            for a in range(0, len(raw) - LENGTH + 1, block):
                group.append((LAST_ID if doc_id is None else doc_id, a, raw[a : a + block + LENGTH - 1]))
                many += len(group[-1][2])
                if many >= block:
                    yield group
                    group, many = [], 0
        if group:
            yield group


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def hot_grams(docs: DataFrame) -> np.ndarray | None:
    """The table of hot grams, None if there is none.

    Fewer than 2^SHARE grams can be more than one in 2^SHARE, so no more reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, how often) of grams with REPORTED or more of COUNTED; with no gram: how many were counted."""
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            gram = np.sort(np.concatenate(held))
            ends = runs(gram)
            n = np.diff(ends)
            k = np.flatnonzero(n >= REPORTED)
            rows = [pa.array([None, *gram[ends[k]].view(np.int64).tolist()], pa.int64()), pa.array([size, *n[k].tolist()], pa.int64())]
            held, size = [], 0
            return pa.RecordBatch.from_arrays(rows, names=["gram", "n"])

        for group in _pieces(batches, BLOCK):
            gram = grams(np.concatenate([x for *_, x in group]))[0]
            held.append(gram[gram < np.uint64(1 << SMALL)])
            size += len(held[-1])
            if size >= COUNTED:
                yield flush()
        if held:
            yield flush()

    counts = written(_texts(docs).mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = counts.where("gram IS NULL").agg(F.sum("n")).head()[0] or 0
    found = counts.where(F.col("gram").isNotNull() & (F.col("n") > total >> SHARE)).select("gram").toArrow().column(0).to_numpy()
    if not len(found):
        return None
    table = np.zeros((1 << HOT_BITS) + 1, bool)
    table[_hot_place(found.view(np.uint64))] = True
    return table


EXCHANGED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
EXCHANGED_SQL = "bucket int, kind int, payload binary"
#: Kinds of rows: stretches of a bucket's grams; spans (doc, start, end) to remove; texts asked for; texts; stretches
#: and where an earlier document seems to hold them; texts of such passages.
STRETCHES, SPANS, ASKED, TEXTS, PAIRED, COPIES = range(6)
#: Bytes of passages that are put in order at once.
PASSAGES = 1 << 21


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), EXCHANGED)], schema=EXCHANGED)


def _home(doc: np.ndarray, homes: int) -> np.ndarray:
    """The bucket of a document: Spark's xxhash64 of its id, as docs_by_bucket() has it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    x = turn(doc.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turn((np.array([42 + 8], np.uint64) + p5) ^ x, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % homes


def _deal(kind: int, doc: np.ndarray, columns: list[np.ndarray], to: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows of one kind, dealt to buckets `to`."""
    order = np.argsort(to, kind="stable")
    ends = runs(to[order])
    return [(int(to[order[a]]), kind, pack(*[c[order[a:b]] for c in (doc, *columns)])) for a, b in zip(ends[:-1], ends[1:])]


def suffix_order(windows: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in lexicographic order, and each one's common prefix with the one before.

    Rows shorter than the others are filled with zeros; sizes has their lengths.
    """
    n, width = windows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = windows
    keys = wide.view(">u8").astype(np.uint64)
    order = np.lexsort([*([] if sizes is None else [sizes]), *keys.T[::-1]])
    there = windows[order]
    same = there[1:] == there[:-1]
    common = np.where(same.all(1), width, same.argmin(1)) if n > 1 else np.zeros(0, np.int64)
    if sizes is not None and n > 1:
        common = np.minimum(common, np.minimum(sizes[order][1:], sizes[order][:-1]))
    return order, np.concatenate([[0], common]).astype(np.int64)[:n]


def _slices(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Places of windows in stretches of the suffix order, cut where the first eight bytes change.

    Windows of two slices share no long prefix, so each slice is sorted alone
    and memory is bounded by SLICE, or by the windows with one beginning.
    """
    key = np.zeros(len(at), np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | data[at + k]
    order = np.argsort(key)
    ends = runs(key[order])
    begin = 0
    for a, b in zip(ends[:-1], ends[1:]):
        if b - begin > SLICE and a > begin:
            yield order[begin:a]
            begin = a
    if begin < len(order):
        yield order[begin:]


def longest_previous(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor at each place of a suffix order.

    rank orders the sources; common is the prefix shared with the place
    before. The nearest place on either side with a smaller rank shares most.
    """

    def nearest(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
        n = len(rank)
        to, shared = np.arange(n) - 1, common.copy()
        # A place with no smaller rank hands on where it looks itself, so ways double in length.
        while True:
            go = np.flatnonzero((to >= 0) & (shared > 0))
            go = go[rank[to[go]] >= rank[go]]
            if not len(go):
                break
            via = to[go]
            shared[go], to[go] = np.minimum(shared[go], shared[via]), to[via]
        shared[to < 0] = 0
        return shared

    after = np.concatenate([common[1:], [0]])[::-1] if len(common) else common
    return np.maximum(nearest(rank, common), nearest(rank[::-1], after)[::-1])


def covered(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each string data[at : at + sizes] covers it whole; who ranks the sources."""
    found = np.zeros(len(at), bool)
    wide = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(WIDTH, np.uint8)), WIDTH)
    for part in _slices(data, at):
        rows = wide[at[part]]
        rows[np.arange(WIDTH) >= sizes[part][:, None]] = 0
        order, common = suffix_order(rows, sizes[part])
        found[part[order]] = longest_previous(who[part[order]], common) >= sizes[part][order]
    return found


def window_factors(doc: np.ndarray, first: np.ndarray, more: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in it, place in data, whether an earlier document holds it) of every window of stretches."""
    n = more.astype(np.int64) + 1
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(begin, n) + inner
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    who, where = np.repeat(doc, n), np.repeat(first.astype(np.int64), n) + inner
    found = np.zeros(len(at), bool)
    for part in _slices(data, at):
        order, common = suffix_order(windows[at[part]])
        found[part[order]] = longest_previous(who[part[order]], common) >= LENGTH
    return who, where, at, found


def _spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, homes: int) -> list[tuple[int, int, bytes]]:
    """Rows of spans to remove; those that touch are one."""
    if not len(doc):
        return []
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1]))
    heads = np.flatnonzero(new)
    ends = np.maximum.reduceat(stop, heads)
    return _deal(SPANS, doc[heads], [start[heads].astype("<u4"), ends.astype("<u4")], _home(doc[heads], homes))


def _find(docs: DataFrame, buckets: int, homes: int) -> DataFrame:
    """The stretches of all texts, dealt by gram; what a task's own texts show to be removed."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_grams(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        data: list[np.ndarray] = []
        size = length = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, data, size, length
            doc, first, more, gram, text, at = (np.concatenate(c) for c in zip(*held))
            # Of equal stretches the task keeps the one of the smallest document; later documents' are removed.
            order = np.lexsort((doc, text, gram))
            g, t, d = gram[order], text[order], doc[order]
            new = np.append(True, (g[1:] != g[:-1]) | (t[1:] != t[:-1]))
            heads, of = np.flatnonzero(new), np.cumsum(new) - 1
            later = d > d[heads][of]
            own = np.flatnonzero(later | (new & np.logical_or.reduceat(later, heads)[of]))
            k = order[own]
            sizes = more[k] + LENGTH
            gone = k[covered(np.concatenate(data), at[k], sizes, doc[k]) & later[own]]
            rows = _spans(doc[gone], first[gone], first[gone] + more[gone] + LENGTH, homes)
            stay = np.ones(len(doc), bool)
            stay[gone] = False
            k = np.flatnonzero(stay)
            bucket = ((gram[k] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.lexsort((doc[k], bucket))
            k, bucket = k[order], bucket[order]
            ends = runs(bucket)
            for a, b in zip(ends[:-1], ends[1:]):
                own = k[a:b]
                step = np.diff(doc[own], prepend=0).view(np.uint64)  # ids in order: small steps, however many buckets there are
                rows.append((int(bucket[a]), STRETCHES, pack(planes(step, 8), planes(gram[own], 5), planes(text[own], 6), planes(first[own], 4), more[own].astype(np.uint8))))
            held, data, size, length = [], [], 0, 0
            return _rows(rows)

        for group in _pieces(batches, BLOCK):
            joined = np.concatenate([x for *_, x in group])
            ends = np.cumsum([len(x) for *_, x in group])
            first, more, gram, text = stretches(joined, ends, hot.value)
            if not len(first):
                continue
            which = np.searchsorted(ends, first, "right")
            shift = np.array([a for _, a, _ in group], np.int64) - (ends - [len(x) for *_, x in group])
            # The smallest hash of many is a small number: it is spread again before buckets are made of it.
            held.append((np.array([d for d, *_ in group], np.int64)[which], first + shift[which], more, mix(gram + np.uint64(1)), text, first + length))
            data.append(joined)
            size, length = size + len(first), length + len(joined)
            if size >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return _texts(docs).mapInArrow(lean(run), EXCHANGED_SQL)


def _match(homes: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A bucket's stretches against each other: which to hold against which, and texts to ask for."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        payload = t.column("payload")
        own = [unpack(payload[int(i)].as_py(), *[np.uint8] * 5) for i in np.flatnonzero(kind == STRETCHES)]
        rows: list[tuple[int, int, bytes]] = []
        if own:
            doc = np.concatenate([np.cumsum(from_planes(x[0], 8), dtype=np.uint64).view(np.int64) for x in own])
            gram = np.concatenate([from_planes(x[1], 5) for x in own])
            text = np.concatenate([from_planes(x[2], 6) for x in own])
            first = np.concatenate([from_planes(x[3], 4).astype(np.uint32) for x in own])
            more = np.concatenate([x[4] for x in own])
            order = np.argsort(gram)
            ends = runs(gram[order])
            order = order[np.repeat(np.diff(ends) > 1, np.diff(ends))]
            order = order[np.lexsort((first[order], doc[order], text[order], gram[order]))]
            if len(order):
                g, x, d = gram[order], text[order], doc[order]
                new_gram = np.append(True, g[1:] != g[:-1])
                new_text = new_gram | np.append(True, x[1:] != x[:-1])
                new_doc = new_text | np.append(True, d[1:] != d[:-1])
                top = d[np.flatnonzero(new_text)][np.cumsum(new_text) - 1]
                later = np.flatnonzero(d > top)
                if len(later):
                    # The first place in the nearest earlier document: its run of equal ids ends before the own one.
                    heads, run_of = np.flatnonzero(new_doc), np.cumsum(new_doc) - 1
                    k, s = order[later], order[heads[run_of[later] - 1]]
                    rows += _deal(PAIRED, doc[k], [first[k].astype("<u4"), more[k], doc[s], first[s].astype("<u4")], _home(doc[k], homes))
                # Grams with several different stretches in several documents: the first of each is asked for.
                of, heads = np.cumsum(new_gram) - 1, np.flatnonzero(new_gram)
                texts = np.bincount(of, new_text)
                several = np.minimum.reduceat(d, heads) < np.maximum.reduceat(d, heads)
                wanted = ((texts > 1) & several)[of] & (d == top)
                ask = order[wanted]
                if len(ask):
                    many = (texts[of[wanted]] >= MANY).astype(np.uint8)
                    back = np.full(len(ask), key[0].as_py(), "<u4")
                    rows += _deal(ASKED, doc[ask], [first[ask].astype("<u4"), more[ask], many, back], _home(doc[ask], homes))
        return _passed(t, kind, rows)

    return run


def _passed(t: pa.Table, kind: np.ndarray, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """New rows, and the spans that were there already."""
    return pa.concat_tables([t.select(["bucket", "kind", "payload"]).filter(pa.array(kind == SPANS)).cast(EXCHANGED), pa.Table.from_batches([_rows(rows)])])


def _texts_by_doc(t: pa.Table) -> dict[int, list[bytes]]:
    found: dict[int, list[bytes]] = {}
    for d, x in zip(t.column("doc_id").to_pylist(), t.column("text")):
        own = found.setdefault(LAST_ID if d is None else d, [])
        raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
        if raw not in own:
            own.append(raw)
    return found


def _answer(buckets: int, homes: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The texts that were asked for, sent back, and those of paired passages, sent to the earlier document; spans pass through."""

    def asked_for(rows: list, asked: list[list[np.ndarray]], raw: dict[int, list[bytes]]) -> None:
        doc, first, more, many, back = (np.concatenate(c) for c in zip(*asked))
        order = np.lexsort((first, doc))
        out: dict[int, list[tuple[int, int, int, bytes]]] = {}
        hot: list[tuple[int, int, int, bytes]] = []
        for d, a, n, common, to in zip(*(c[order].tolist() for c in (doc, first, more, many, back))):
            for source in raw.get(d, ()):
                piece = source[a : a + n + LENGTH]
                if len(piece) == n + LENGTH:
                    (hot if common else out.setdefault(to, [])).append((d, a, n, piece))
        for to, own in out.items():
            rows.append((to, TEXTS, pack(*_columns(own))))
        if hot:
            doc, first, more, data = _columns(hot)
            who, where, at, found = window_factors(doc, first, more, data)
            rows += _spans(who[found], where[found], where[found] + LENGTH, homes)
            # The windows that are left are dealt by their hash, each with its own text.
            k = np.flatnonzero(~found)
            sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * powers(_BASE, len(data))))
            to = (mix((sums[at[k] + LENGTH] - sums[at[k]]) * powers(_INVERSE, len(data))[at[k]]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = runs(to[order])
            windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
            for a, b in zip(ends[:-1], ends[1:]):
                own = k[order[a:b]]
                rows.append((int(to[order[a]]), TEXTS, pack(who[own], where[own].astype("<u4"), np.zeros(b - a, np.uint8), windows[at[own]].ravel())))

    def paired(rows: list, pairs: list[list[np.ndarray]], raw: dict[int, list[bytes]]) -> None:
        doc, first, more, source, place = (np.concatenate(c) for c in zip(*pairs))
        first, place = first.astype(np.int64), place.astype(np.int64)
        order = np.lexsort((first, first - place, source, doc))
        doc, first, more, source, place = (c[order] for c in (doc, first, more, source, place))
        follows = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (first[1:] - place[1:] == first[:-1] - place[:-1]) & (first[1:] == first[:-1] + more[:-1] + 1)
        ends = [*np.flatnonzero(np.append(True, ~follows)).tolist(), len(doc)]
        to = _home(source, homes)
        out: dict[int, list[tuple[int, int, int, int, np.ndarray, bytes]]] = {}
        for a, b in zip(ends[:-1], ends[1:]):
            d, start, n = int(doc[a]), int(first[a]), int(first[b - 1] - first[a]) + int(more[b - 1]) + LENGTH
            for text in raw.get(d, ()):
                piece = text[start : start + n]
                if len(piece) == n:
                    out.setdefault(int(to[a]), []).append((d, start, int(source[a]), int(place[a]), more[a:b], piece))
        for home, own in out.items():
            d, start, s, p, steps, pieces = zip(*own)
            numbers = [np.array(c, k) for c, k in ((d, "<i8"), (start, "<u4"), (s, "<i8"), (p, "<u4"), ([len(x) for x in steps], "<u4"))]
            rows.append((home, COPIES, pack(*numbers, np.concatenate(steps), np.frombuffer(b"".join(pieces), np.uint8))))

    def run(key: tuple, docs: pa.Table, t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        payload = t.column("payload")
        rows: list[tuple[int, int, bytes]] = []
        asked = [unpack(payload[int(i)].as_py(), "<i8", "<u4", np.uint8, np.uint8, "<u4") for i in np.flatnonzero(kind == ASKED)]
        pairs = [unpack(payload[int(i)].as_py(), "<i8", "<u4", np.uint8, "<i8", "<u4") for i in np.flatnonzero(kind == PAIRED)]
        raw = _texts_by_doc(docs) if asked or pairs else {}
        if asked:
            asked_for(rows, asked, raw)
        if pairs:
            paired(rows, pairs, raw)
        return _passed(t, kind, rows)

    return run


def _columns(own: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    return [np.array([o[0] for o in own], "<i8"), np.array([o[1] for o in own], "<u4"), np.array([o[2] for o in own], np.uint8), np.frombuffer(b"".join(o[3] for o in own), np.uint8)]


def _copied(passages: list[tuple[int, int, int, int, np.ndarray, bytes]], raw: dict[int, list[bytes]], homes: int) -> list[tuple[int, int, bytes]]:
    """Spans of passages (document, place, earlier document, place there, further windows of its stretches, text)."""
    data: list[bytes] = []
    items: list[tuple[np.ndarray, ...]] = []
    base = 0

    def add(source: int, piece: bytes, which: int, start: int, inner: np.ndarray, sizes: np.ndarray) -> None:
        nonlocal base
        data.append(piece)
        items.append((base + inner, sizes, np.full(len(inner), source), np.full(len(inner), which), start + inner))
        base += len(piece)

    for i, (d, start, s, place, more, piece) in enumerate(passages):
        sizes = more.astype(np.int64) + LENGTH
        inner = np.cumsum(more.astype(np.int64) + 1) - more - 1
        add(d, piece, i, start, inner, sizes)
        for text in raw.get(s, ()):
            other = text[place : place + len(piece)]
            if len(other) == len(piece):
                add(s, other, -1, 0, inner, sizes)
    at, sizes, who, which, where = (np.concatenate(c) for c in zip(*items))
    found = covered(np.frombuffer(b"".join(data), np.uint8), at, sizes, who)
    own = np.flatnonzero(which >= 0)
    good = own[found[own]]
    names = np.array([p[0] for p in passages])
    if len(good) < len(own) and len(set(zip(names[which[own]].tolist(), where[own].tolist()))) > len(set(zip(names[which[good]].tolist(), where[good].tolist()))):
        raise RuntimeError("two different strings share a gram and a hash; take other numbers for _BYTE")
    return _spans(who[good], where[good], where[good] + sizes[good], homes)


def _sort(homes: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A bucket's texts and passages in suffix order: those with a long previous factor are spans."""

    def run(key: tuple, docs: pa.Table, t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        payload = t.column("payload")
        rows: list[tuple[int, int, bytes]] = []
        own = [unpack(payload[int(i)].as_py(), "<i8", "<u4", np.uint8, np.uint8) for i in np.flatnonzero(kind == TEXTS)]
        if own:
            who, where, _, found = window_factors(*(np.concatenate(c) for c in zip(*own)))
            rows += _spans(who[found], where[found], where[found] + LENGTH, homes)
        copies = np.flatnonzero(kind == COPIES)
        raw = _texts_by_doc(docs) if len(copies) else {}
        held, size = [], 0
        for i in copies:
            d, start, s, place, n, more, text = unpack(payload[int(i)].as_py(), "<i8", "<u4", "<i8", "<u4", "<u4", np.uint8, np.uint8)
            a = b = 0
            for k in range(len(d)):
                steps = more[a : a + n[k]]
                many = int(steps.sum(dtype=np.int64)) + int(n[k]) - 1 + LENGTH
                held.append((int(d[k]), int(start[k]), int(s[k]), int(place[k]), steps, text[b : b + many].tobytes()))
                a, b, size = a + int(n[k]), b + many, size + many
                if size >= PASSAGES:
                    rows += _copied(held, raw, homes)
                    held, size = [], 0
        if held:
            rows += _copied(held, raw, homes)
        return _passed(t, kind, rows)

    return run


def merged(starts: np.ndarray, stops: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The maximal runs that spans cover, within n bytes."""
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(starts[order].tolist(), stops[order].tolist()):
        b = min(b, n)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _apply(schema: pa.Schema, finish: Callable[[dict, bytes, list[tuple[int, int]]], dict], columns: list[str]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Every document of a bucket with its removed runs, made into a row by `finish`."""

    def run(key: tuple, docs: pa.Table, t: pa.Table) -> pa.Table:
        spans = [unpack(p.as_py(), "<i8", "<u4", "<u4") for p in t.column("payload")]
        doc, start, stop = (np.concatenate(c) for c in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 3
        order = np.argsort(doc, kind="stable")
        ids, begin = np.unique(doc[order], return_index=True)
        begin = np.append(begin, len(doc))
        place = dict(zip(ids.tolist(), range(len(ids))))
        rows = []
        others = [docs.column(c) for c in columns]
        for i, (d, x) in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("text"))):
            raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
            k = place.get(LAST_ID if d is None else d)
            own = order[begin[k] : begin[k + 1]] if k is not None else order[:0]
            rows.append(finish({c: o[i].as_py() for c, o in zip(columns, others)}, raw, merged(start[own], stop[own], len(raw))))
        return pa.Table.from_pylist(rows, schema)

    return run


def _kept(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    if not removed:
        return raw
    cuts = [0, *(x for span in removed for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def docs_by_bucket(docs: DataFrame, homes: int, columns: list[str]) -> DataFrame:
    """Documents with the bucket that their spans are dealt to."""
    home = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))), F.lit(homes)).cast("int")
    return docs.select(home.alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def _removed(docs: DataFrame, finish, schema: pa.Schema, sql: str, columns: list[str]) -> DataFrame:
    """All steps as one plan, so that the exchange of the documents is made once and used twice."""
    # A group of grams makes a row for each bucket of documents, so neither are more than the partitions.
    buckets = homes = _common.buckets(docs.sparkSession, 1)
    by_bucket = docs_by_bucket(docs, homes, columns)
    matched = _find(docs, buckets, homes).groupBy("bucket").applyInArrow(_match(homes), EXCHANGED_SQL)
    told = by_bucket.groupBy("bucket").cogroup(matched.groupBy("bucket")).applyInArrow(_answer(buckets, homes), EXCHANGED_SQL)
    spans = by_bucket.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_sort(homes), EXCHANGED_SQL)
    return by_bucket.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_apply(schema, finish, ["doc_id", *columns]), sql)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def finish(row: dict, raw: bytes, removed: list[tuple[int, int]]) -> dict:
        kept = _kept(raw, removed)
        return row | {"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(removed), "kept_sha256": sha256(kept).hexdigest()}

    return _removed(docs, finish, schema, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", [])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their removed bytes; what is left of a cut character goes too. n_chars is counted anew."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])

    def finish(row: dict, raw: bytes, removed: list[tuple[int, int]]) -> dict:
        text = _kept(raw, removed).decode("utf-8", "ignore")
        return row | {"text": text, "n_chars": len(text)}

    typed = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return _removed(typed, finish, schema, "doc_id long, text string, lang string, source string, n_chars long", ["lang", "source"])


#: All strings of LENGTH bytes with the smallest document of each, as hex digits.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, k, substr(h, 2 * k + 1, {2 * (500 + LENGTH - 1)}) AS h FROM (SELECT *, unnest(range(0, n, 500)) AS k FROM d)),
w AS (SELECT doc_id, k, h, unnest(range(0, least(500, n - k - {LENGTH - 1}))) AS i FROM c),
g AS (SELECT doc_id, k + i AS i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM w),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM g JOIN f USING (s) WHERE first < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m) GROUP BY doc_id, k),
k AS (SELECT r.doc_id, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS piece, a, b FROM r JOIN d USING (doc_id) WINDOW o AS (PARTITION BY r.doc_id ORDER BY a)),
j AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)
"""
