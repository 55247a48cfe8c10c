"""Exact Jaccard join of word shingle sets by prefix trees, and its components.

A text's set holds the hashes of its distinct shingles of SHINGLE words (ASCII
capitals in lower case, words between blanks of ASCII); a shorter text has its
whole word sequence as one, a text without words none. Equal sets are one node
from the start. Then:

1. Every task deals its sets' hashes to buckets by hash. A bucket counts in how
   many sets each hash occurs and sends on only those that occur in several: a
   set of which more than a fifth occurs nowhere else can't link. Hashes that
   are frequent within a task skip their bucket's group, so that a very common
   passage doesn't gather in one place.
2. What is left of each set is ordered by how many sets hold a hash, rarest
   first. Linked sets must share a hash among the first few; groups of sets
   that do so, directly or through others, are found as components.
3. Each group's sets stand in a compressed prefix tree, most frequent hash
   first, and are looked up in it. A walk counts hashes shared with all sets
   below a node at once, leaves out subtrees whose sizes and remaining hashes
   can't reach the threshold, and those that are linked already. A group with
   more sets or hashes than a task should have is cut into blocks, and each
   pair of blocks is a tile of its own. Where that would copy its sets too
   often, the sets are dealt out by each of their first hashes instead.
4. Links make components; a document gets the smallest id of its component.

Shingle hashes have 64 bits (48 and the last 16 of the bucket's number in the exchange), a set's
digest 128: sets with equal digests are equal. Null texts have no words. Rows
without words link with nothing. A null id never is a component's id unless
all its ids are null. Repeated rows are linked rows like any other. Very long
texts are cut into words whole. Other columns are left out. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import _common
from echofold.llm._common import lean, table, written
from echofold.llm._packed import from_planes, mix, pack, planes, runs, unpack
from echofold.operators.graph import connected_components

SHINGLE, PERCENT = 5, 80
#: Bytes of text that are cut into words at once, and hashes that are dealt out at once.
BLOCK, FLUSH = 1 << 20, 800_000
#: In how many sets of one flush a hash counts as frequent; all such have the last place in the order.
FREQUENT, LAST = 64, 255
#: Sets and hashes of a block: more of either in a group make several tiles.
GROUP_SETS, GROUP_HASHES = 256, 1 << 18
#: Blocks of a group beyond which its sets are dealt by their first hashes.
BLOCKS = 256

_rng = np.random.RandomState(31)
_BYTE = _rng.randint(0, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.randint(0, 2**63, 1 << 12, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and where it starts."""
    data = np.frombuffer(raw + b" ", np.uint8)
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    begin = np.zeros(len(data), np.int64)
    begin[start] = start
    place = np.arange(len(data)) - np.maximum.accumulate(begin)
    each = _BYTE[_LOWER[data]] * (_PLACE[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(2))
    each = mix(each)
    sums = np.add.reduceat(each, edge)[::2]
    return mix(sums ^ (stop - start).astype(np.uint64)), start


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        starts = np.cumsum([0] + [len(t) + 1 for t in group])
        words, at = word_hashes(b" ".join(group))
        first = np.searchsorted(at, starts)
        salts = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(size)]
        if len(words) >= size:
            made = words[: len(words) - size + 1] * salts[0]
            for k in range(1, size):
                made = made + words[k : len(words) - size + 1 + k] * salts[k]
            made = mix(made)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= size:
                out.append(np.unique(made[a : b - size + 1]))
            elif b > a:
                short = words[a:b] * np.array(salts[: b - a], np.uint64)
                out.append(mix(short.sum(dtype=np.uint64, keepdims=True) ^ np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        group, held = [], 0

    for t in texts:
        group.append(t)
        held += len(t)
        if held >= BLOCK:
            flush()
    flush()
    return out


def set_digest(hashes: np.ndarray) -> bytes:
    """16 bytes from two sums over a set's hashes, each spread in its own way, and its size."""
    one, two = (mix(x).sum(dtype=np.uint64) for x in (hashes, hashes * _PLACE[0]))
    return mix(np.array([one, two ^ one], np.uint64) ^ np.uint64(len(hashes))).tobytes()


# Rows of the exchange. kind 0: a document (doc_id, n, digest of 16 bytes). A task numbers its sets within lots; kind 1: a lot's
# hashes of a bucket; kind 2: frequent hashes of a bucket; kind 3: hashes that several sets hold, sent to the lot's
# home; kind 4: digests and sizes of a lot's sets, sent there too.
DEALT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("payload", pa.binary())])
DEALT_SQL = "bucket int, kind int, doc_id long, n long, digest binary, payload binary"


def _row(bucket: int, kind: int, payload: bytes) -> tuple:
    return (bucket, kind, None, None, None, payload)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), DEALT)] if rows else [pa.array([], f.type) for f in DEALT], schema=DEALT)


#: Sets of a lot are numbered in so many bits.
LOT_BITS = 24


def _homes(lots: np.ndarray, homes: int) -> np.ndarray:
    return (mix(lots.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)


def _deal_shared(places: np.ndarray, hashes: np.ndarray, classes: np.ndarray, homes: int) -> list[tuple]:
    """Rows of kind 3: (lot and set, hash, class) dealt by lot."""
    to = _homes(places >> np.uint64(LOT_BITS), homes)
    order = np.lexsort((places, to))
    ends = runs(to[order])
    rows = []
    for a, b in zip(ends[:-1], ends[1:]):
        k = order[a:b]
        # Places in order: small steps, however few hashes a set has here.
        rows.append(_row(int(to[k[0]]), 3, pack(planes(np.diff(places[k], prepend=np.uint64(0)), 8), planes(hashes[k], 8), classes[k].astype(np.uint8))))
    return rows


def _deal(docs: DataFrame, buckets: int, homes: int) -> DataFrame:
    """Documents and their sets' hashes, dealt to buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sets: list[np.ndarray] = []
        names: list[bytes] = []
        held = lots = 0

        def flush() -> pa.RecordBatch:
            nonlocal sets, names, held, lots
            # The rows of a partition come in one order, so a task that runs again makes the same lots.
            lot = np.uint64((TaskContext.get().partitionId() << 16) + lots)
            sizes = np.array([len(s) for s in sets])
            all_hashes = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            place = lot << np.uint64(LOT_BITS) | owner.astype(np.uint64)
            # Numbers of 16 bits are sorted faster.
            bucket = (((all_hashes >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            low = all_hashes & np.uint64((1 << 48) - 1)
            rows = [_row(int(_homes(np.array([lot]), homes)[0]), 4, pack(np.array([lot]), np.frombuffer(b"".join(names), np.uint8), sizes.astype("<u4")))]
            order = np.argsort(all_hashes)
            ends = runs(all_hashes[order])
            many = np.diff(ends) >= FREQUENT
            if many.any():
                common = np.zeros(len(all_hashes), bool)
                common[order] = np.repeat(many, np.diff(ends))
                k = np.flatnonzero(common)
                full = low[k] | bucket[k].astype(np.uint64) << np.uint64(48)
                rows += _deal_shared(place[k], full, np.full(len(k), LAST), homes)
                heads = order[ends[:-1][many]]
                for b in np.unique(bucket[heads]):
                    rows.append(_row(int(b), 2, pack(low[heads[bucket[heads] == b]])))
                k = np.flatnonzero(~common)
                bucket, low, owner = bucket[k], low[k], owner[k]
            order = np.argsort(bucket, kind="stable")
            ends = runs(bucket[order])
            for a, b in zip(ends[:-1], ends[1:]):
                k = order[a:b]
                rows.append(_row(int(bucket[k[0]]), 1, pack(np.array([lot]), planes(np.diff(owner[k], prepend=0), 3), planes(low[k], 6))))
            lots += 1
            sets, names, held = [], [], 0
            return _table(rows)

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                made = shingle_sets(texts)
                digest = [set_digest(x) for x in made]
                empty = pa.nulls(len(made), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((a + np.arange(len(made))) % buckets, pa.int32()), pa.array(np.zeros(len(made), np.int32)), part.column(0), pa.array([len(s) for s in made], pa.int64()), pa.array(digest, pa.binary()), empty], schema=DEALT)
                for s, d in zip(made, digest):
                    if len(s) and d not in seen:
                        seen.add(d)
                        sets.append(s)
                        names.append(d)
                        held += len(s)
                        if held >= FLUSH:
                            yield flush()
        if sets:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), DEALT_SQL)


def _count(homes: int):
    """A bucket's hashes that occur in several sets; documents pass through."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        through = t.filter(pa.array((kind != 1) & (kind != 2)))
        payloads = t.column("payload")
        read = lambda k, *kinds: [unpack(payloads[int(i)].as_py(), *kinds) for i in np.flatnonzero(kind == k)]
        own, frequent = read(1, "<u8", np.uint8, np.uint8), read(2, "<u8")
        rows: list[tuple] = []
        if own:
            places = np.concatenate([x[0] << np.uint64(LOT_BITS) | np.cumsum(from_planes(x[1], 3), dtype=np.uint64) for x in own])
            low = np.concatenate([from_planes(x[2], 6) for x in own])
            order = np.argsort(low)
            ends = runs(low[order])
            df = np.repeat(np.diff(ends), np.diff(ends))
            common = np.unique(np.concatenate([x[0] for x in frequent])) if frequent else np.zeros(0, np.uint64)
            known = np.isin(low[order], common) if len(common) else np.zeros(len(order), bool)
            keep = (df > 1) | known
            classes = np.where(known, LAST, np.minimum(df, LAST - 1))[keep]
            at = order[keep]
            rows = _deal_shared(places[at], low[at] | np.uint64((key[0].as_py() & 0xFFFF) << 48), classes, homes)
        return pa.concat_tables([through.cast(DEALT), pa.Table.from_batches([_table(rows)])])

    return run


SETS_SQL = "digest binary, n long, hashes binary"


def _assemble(key: tuple, t: pa.Table) -> pa.Table:
    """Sets of which at least four fifths occur elsewhere: their shared hashes, rarest first."""
    kind = t.column("kind").to_numpy()
    payloads = t.column("payload")
    out = []
    own = [unpack(payloads[int(i)].as_py(), *[np.uint8] * 3) for i in np.flatnonzero(kind == 3)]
    names = {int(x[0][0]): (x[1], x[2]) for x in (unpack(payloads[int(i)].as_py(), "<u8", "V16", "<u4") for i in np.flatnonzero(kind == 4))}
    if own:
        places = np.concatenate([np.cumsum(from_planes(x[0], 8), dtype=np.uint64) for x in own])
        hashes, classes = np.concatenate([from_planes(x[1], 8) for x in own]), np.concatenate([x[2] for x in own])
        order = np.lexsort((hashes, classes, places))
        ends = runs(places[order])
        for a, b in zip(ends[:-1], ends[1:]):
            place = int(places[order[a]])
            digests, sizes = names[place >> LOT_BITS]
            i = place & (1 << LOT_BITS) - 1
            n = int(sizes[i])
            if 100 * (b - a) >= PERCENT * n:
                out.append((digests[i].tobytes(), n, hashes[order[a:b]].tobytes()))
    cols = list(zip(*out)) or [[], [], []]
    return pa.Table.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["digest", "n", "hashes"])


def _first_hashes(n: int, raw: pa.Scalar) -> np.ndarray:
    """The hashes of which a linked set must share one."""
    h = np.frombuffer(raw.as_py(), np.int64)
    # Hashes that occur nowhere else stand before all others in the order.
    return h[: max(0, n - (PERCENT * n + 99) // 100 + 1 - (n - len(h)))]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, set) for the first hashes of each set."""
    for batch in batches:
        heads = [_first_hashes(n, raw) for n, raw in zip(batch.column(1).to_numpy(), batch.column(2))]
        of = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *heads])), batch.column(0).take(pa.array(of))], names=["hash", "digest"])


def _by_first_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once for each of its first hashes, a few sets at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            heads = [_first_hashes(n, raw) for n, raw in zip(part.column(1).to_numpy(), part.column(2))]
            of = pa.array(np.repeat(np.arange(len(heads)), [len(h) for h in heads]))
            labels = np.concatenate([np.zeros(0, np.int64), *heads]).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in labels], pa.binary()), *(c.take(of) for c in part.columns)], names=["label", "digest", "n", "hashes"])


class Forest:
    """Disjoint sets of the places 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class PrefixTree:
    """Sets of ordered numbers in a compressed trie, looked up with a bound on what can be missing."""

    __slots__ = ("begin", "end", "row", "kids", "member", "low", "high", "least", "same", "own")

    def __init__(self, row: np.ndarray, begin: int, end: int) -> None:
        # The node's numbers are row[begin:end]; all sets below start with row[:end].
        self.row, self.begin, self.end = row, begin, end
        self.kids: list[PrefixTree] = []
        self.own: list[int] = []  # sets that end here
        self.low, self.high = 1 << 62, 0  # sizes of the sets below
        self.member, self.same = -1, False  # one of them, and whether all are known to be linked

    @classmethod
    def build(cls, rows: list[np.ndarray], sizes: list[int]) -> PrefixTree:
        """Over sorted rows; sizes are those of the whole sets."""
        order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">u4").tobytes())
        root = cls(np.zeros(0, np.int64), 0, 0)
        path = [root]
        last = np.zeros(0, np.int64)
        for i in order:
            row = rows[i]
            n = min(len(row), len(last))
            differ = np.flatnonzero(row[:n] != last[:n])
            shared = int(differ[0]) if len(differ) else n
            while path[-1].end > shared and path[-1].begin >= shared:
                path.pop()
            top = path[-1]
            if top.end > shared:  # the node is cut where the new row leaves it
                below = cls(top.row, shared, top.end)
                below.kids, below.own = top.kids, top.own
                top.end, top.kids, top.own = shared, [below], []
            if len(row) > shared:
                leaf = cls(row, shared, len(row))
                top.kids.append(leaf)
                path.append(leaf)
                top = leaf
            top.own.append(i)
            last = row
        root.bound(sizes)
        return root

    def bound(self, sizes: list[int]) -> None:
        todo: list[tuple[PrefixTree, bool]] = [(self, False)]
        while todo:
            node, done = todo.pop()
            if not done:
                todo.append((node, True))
                todo += [(k, False) for k in node.kids]
                continue
            for i in node.own:
                node.low, node.high, node.member = min(node.low, sizes[i]), max(node.high, sizes[i]), i
            for k in node.kids:
                node.low, node.high, node.member = min(node.low, k.low), max(node.high, k.high), k.member
            node.same = len(node.own) + len(node.kids) == 1 and (not node.kids or node.kids[0].same)

    def link(self, i: int, row: np.ndarray, size: int, sizes: list[int], mark: np.ndarray, forest: Forest) -> None:
        """Unite set i with every set in the tree that it links to, but for those that are united already."""
        mark[row] = True
        todo: list[tuple[PrefixTree, int, int]] = [(self, 0, 0)]
        while todo:
            node, shared, depth = todo.pop()
            if node.same and forest.find(node.member) == forest.find(i):
                continue
            # Sizes that can link with this one.
            low, high = max(node.low, -(-PERCENT * size // 100)), min(node.high, 100 * size // PERCENT)
            if low > high:
                continue
            here = node.row[node.begin : node.end]
            shared += int(np.count_nonzero(mark[here]))
            depth += len(here)
            # A set of size s shares at most what of it is not known to be missing, and what the row has left.
            most = high - (depth - shared)
            if 100 * most < PERCENT * (size + high - most):
                continue
            if len(here):
                left = len(row) - np.searchsorted(row, here[-1], "right")
                if 100 * (shared + left) < PERCENT * (size + low - shared - left):
                    continue
            for j in node.own:
                if j != i and 100 * shared >= PERCENT * (size + sizes[j] - shared):
                    forest.union(i, j)
            todo += [(k, shared, depth) for k in node.kids]
        mark[row] = False

    def refresh(self, forest: Forest) -> None:
        """Note below which nodes all sets are linked by now."""
        todo: list[tuple[PrefixTree, bool]] = [(self, False)]
        while todo:
            node, done = todo.pop()
            if node.same:
                continue
            if not done:
                todo.append((node, True))
                todo += [(k, False) for k in node.kids]
                continue
            roots = {forest.find(j) for j in node.own} | {forest.find(k.member) if k.same else -1 for k in node.kids}
            node.same = len(roots) == 1 and -1 not in roots


def join_group(hashes: list[np.ndarray], sizes: list[int]) -> list[int]:
    """The smallest place linked with each set, directly or through others."""
    n = len(hashes)
    forest = Forest(n)
    numbers, counts = np.unique(np.concatenate(hashes), return_counts=True)
    # Most frequent first: near copies share long prefixes.
    rank = np.empty(len(numbers), np.int64)
    rank[np.lexsort((numbers, -counts))] = np.arange(len(numbers))
    rows = [np.sort(rank[np.searchsorted(numbers, h)]) for h in hashes]
    tree = PrefixTree.build(rows, sizes)
    mark = np.zeros(len(numbers), bool)
    pause = 8
    for k, i in enumerate(np.argsort([-s for s in sizes], kind="stable").tolist()):
        tree.link(i, rows[i], sizes[i], sizes, mark, forest)
        if k == pause:
            tree.refresh(forest)
            pause *= 2
    return [forest.find(i) for i in range(n)]


def _join_tile(key: tuple, t: pa.Table) -> pa.Table:
    """Stars (set, smallest linked set) of the groups of one tile."""
    out: list[tuple[bytes, bytes]] = []
    t = t.sort_by([("label", "ascending"), ("digest", "ascending")])
    label, digest, size = t.column("label").to_pylist(), t.column("digest").to_pylist(), t.column("n").to_pylist()
    hashes = t.column("hashes")
    a = 0
    for b in range(1, len(label) + 1):
        if b < len(label) and label[b] == label[a]:
            continue
        if b - a > 1:
            found = join_group([np.frombuffer(hashes[i].as_py(), np.uint64) for i in range(a, b)], size[a:b])
            out += [(digest[a + i], digest[a + r]) for i, r in enumerate(found) if i != r]
        a = b
    cols = list(zip(*out)) or [[], []]
    return pa.Table.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], names=["a", "b"])


def _tiles(grouped: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(tile, label, digest, n, hashes) of groups of up to BLOCKS blocks, and the rows of larger groups.

    Small groups share tiles; of one with several blocks each pair of blocks is a tile.
    """
    work = F.sum(F.octet_length("hashes")) / 8
    held = grouped.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_SETS), F.ceil(work / GROUP_HASHES), F.lit(1)).cast("int").alias("blocks"))
    rows = grouped.join(held, "label").withColumn("block", F.pmod(F.xxhash64("digest", F.lit("block")), F.col("blocks")).cast("int"))
    partner = F.explode(F.expr("sequence(0, blocks - 1)"))
    several = rows.where(F.col("blocks") <= BLOCKS).withColumn("partner", partner).where("blocks = 1 OR partner != block")
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(buckets))).otherwise(-1 - F.abs(F.xxhash64("label", F.least("block", "partner"), F.greatest("block", "partner")) % (1 << 40)))
    names = ["label", "digest", "n", "hashes"]
    return several.select(tile.alias("tile"), *names), rows.where(F.col("blocks") > BLOCKS).select(*names, "blocks", "block")


def _join_groups(grouped: DataFrame, buckets: int) -> DataFrame:
    """The links (a, b) of all groups, as stars."""
    tiles, large = _tiles(grouped, buckets)
    # Of a very large group only sets that share a first hash meet.
    by_hash, rest = _tiles(large.select("digest", "n", "hashes").mapInArrow(_by_first_hash, "label binary, " + SETS_SQL), buckets)
    # A hash that very many sets have among their first: all pairs of its blocks, whatever their number.
    pair = F.explode(F.expr("sequence(0, blocks - 1)"))
    rest = rest.withColumn("partner", pair).where("partner != block")
    rest = rest.select((-1 - F.abs(F.xxhash64("label", F.least("block", "partner"), F.greatest("block", "partner")) % (1 << 40))).alias("tile"), "label", "digest", "n", "hashes")
    return tiles.unionByName(by_hash).unionByName(rest).groupBy("tile").applyInArrow(_join_tile, "a binary, b binary")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    # Smaller groups of hashes would repeat sets' heads more often; sets have fewer buckets than hashes.
    buckets, homes = _common.buckets(spark, 2), _common.buckets(spark, 1)
    dealt = _deal(docs, buckets, homes).groupBy("bucket").applyInArrow(_count(homes), DEALT_SQL)
    counted = written(dealt, "shingles")
    rows = counted.where("kind = 0").select("doc_id", "n", "digest")
    sets = written(counted.where("kind >= 3").groupBy("bucket").applyInArrow(_assemble, SETS_SQL).dropDuplicates(["digest"]), "sets")
    heads = sets.mapInArrow(_prefixes, "hash long, digest binary")
    least = heads.groupBy("hash").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least < most")
    coarse = connected_components(heads.join(least, "hash").select(F.col("digest").alias("a"), F.col("least").alias("b")))
    grouped = written(sets.join(coarse.select(F.col("node").alias("digest"), F.col("component").alias("label")), "digest"), "groups")
    linked = connected_components(_join_groups(grouped, buckets))
    first = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    joined = first.join(linked.select(F.col("node").alias("digest"), "component"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of_set = joined.join(smallest, "component").select(F.col("digest").alias("_digest"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(of_set, F.col("digest") == F.col("_digest")).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id. Documents without words or id stay."""
    keep = components(docs).where("doc_id = component_id").select("doc_id").distinct()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    return docs.select(*names).join(keep, "doc_id", "left_semi").unionByName(docs.select(*names).where("doc_id IS NULL"))


#: Sets as lists of words, all pairs that share one, and the smallest id that is reached by links.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS k, len(w) AS m FROM w),
l AS (SELECT doc_id, k, m, t, lead(t) OVER q AS t2, lead(t, 2) OVER q AS t3, lead(t, 3) OVER q AS t4, lead(t, 4) OVER q AS t5 FROM o WINDOW q AS (PARTITION BY doc_id ORDER BY k)),
g AS (SELECT DISTINCT doc_id, concat_ws(' ', t, t2, t3, t4, t5) AS g FROM l WHERE k = 1 OR k <= m - {SHINGLE - 1}),
s AS (SELECT w.doc_id, count(g.g) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
x AS (SELECT g.doc_id, n, g.g FROM g JOIN s USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
