"""DuckDB SQL with the rows of the catalogue's queries, written apart from the Spark code."""

from __future__ import annotations

import math

from echofold.operators.evaluate import SUFFIXES
from echofold.operators.scoring import SHIPPED, SHIPPED_INTERCEPT, SHIPPED_THRESHOLD

# Files of documents

_FILES = """
files AS MATERIALIZED (
  SELECT doc_id AS file_id, 'docs/' || doc_id || (['.jpg', '.png', '.jpeg', '.dat', '.txt'])[doc_id % 5 + 1] AS path,
    strlen(coalesce(text, '')) % 3 AS kind, coalesce(text, '') AS text,
    strlen(coalesce(text, '')) + ([3, 8, 0])[strlen(coalesce(text, '')) % 3 + 1] AS size_bytes,
    (['jpeg', 'png', NULL])[strlen(coalesce(text, '')) % 3 + 1] AS format, doc_id % 5 > 2 AS extension_mismatch
  FROM documents)"""
_EXACT = _FILES + """,
groups AS MATERIALIZED (
  SELECT min(file_id) AS group_id, count(*) AS n_members, list(file_id ORDER BY file_id) AS ids, any_value(size_bytes) AS size_bytes,
    ((count(*) - 1) * any_value(size_bytes))::BIGINT AS reclaimable_bytes
  FROM files GROUP BY kind, text HAVING count(*) >= 2)"""

# Images of embeddings: 64 gray levels in a list, hashes as sums of bits

_ENLARGED = [0, 0, 1, 2, 3, 4, 5, 6, 7]


def _upright(x: int, y: int) -> int:
    return y * 8 + _ENLARGED[x]


def _square(x: int, y: int) -> int:
    return _ENLARGED[y] * 8 + _ENLARGED[x]


_POSES = {
    "dhash": _upright,
    "dhash_mirror": lambda x, y: _upright(8 - x, y),
    "dhash_rot90": lambda x, y: _square(y, 8 - x),
    "dhash_rot180": lambda x, y: _square(8 - x, 8 - y),
    "dhash_rot270": lambda x, y: _square(8 - y, x),
}


def _sum_of_bits(tests: list[str]) -> str:
    return " + ".join(f"(CASE WHEN {t} THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i, t in enumerate(tests))


def _dct() -> list[list[float]]:
    """Weights of eight cells of four equal pixels each in the eight lowest terms."""
    def weight(k: int, x: int) -> float:
        return math.sqrt((1 if k == 0 else 2) / 32) * math.cos(math.pi * (2 * x + 1) * k / 64)

    return [[sum(weight(k, 4 * c + j) for j in range(4)) for c in range(8)] for k in range(8)]


_C = _dct()
_COLUMNS = ", ".join("(" + " + ".join(f"({_C[v][y]!r})::DOUBLE * px[{8 * y + x + 1}]" for y in range(8)) + ")" for v in range(8) for x in range(8))
_BLOCK = ", ".join("(" + " + ".join(f"({_C[u][x]!r})::DOUBLE * t[{8 * v + x + 1}]" for x in range(8)) + ")" for v in range(8) for u in range(8))

_PIXELS = """
thumbs AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda v: greatest(0, least(255, floor((v::DOUBLE + 1) * 127.5)))::INTEGER) AS px FROM embeddings)"""
_HASHED = _PIXELS + f""",
waves AS MATERIALIZED (SELECT id, px, [{_COLUMNS}] AS t FROM thumbs),
blocks AS MATERIALIZED (SELECT id, px, [{_BLOCK}] AS f FROM waves),
medians AS MATERIALIZED (SELECT *, list_sort(f[2:64])[32] AS mid FROM blocks),
hashes AS MATERIALIZED (
  SELECT id, {_sum_of_bits([f"px[{i + 1}] > list_sum(px) // 64" for i in range(64)])} AS ahash,
    {_sum_of_bits(["false"] + [f"f[{i + 1}] > mid" for i in range(1, 64)])} AS phash,
    {", ".join(_sum_of_bits([f"px[{g(x, y) + 1}] > px[{g(x + 1, y) + 1}]" for y in range(8) for x in range(8)]) + f" AS {n}" for n, g in _POSES.items())}
  FROM medians)"""


def _hex(name: str) -> str:
    return f"lpad(lower(to_hex({name}::UBIGINT)), 16, '0') AS {name}"


def _apart(a: str, b: str) -> str:
    return f"bit_count(xor(a.{a}, b.{b}))::INTEGER"


_ORIENTED = "least(" + ", ".join(_apart(p, "dhash") for p in _POSES) + ")"


def _candidates(radius: int = 16, name: str = "pairs") -> str:
    return f"""
all_pairs AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, {_apart("ahash", "ahash")} AS d_ahash, {_apart("dhash", "dhash")} AS d_dhash, {_apart("phash", "phash")} AS d_phash, {_ORIENTED} AS d_dhash_oriented
  FROM hashes a JOIN hashes b ON a.id < b.id),
{name} AS MATERIALIZED (
  SELECT *, least(d_ahash, d_dhash, d_phash) AS best FROM all_pairs
  WHERE d_ahash <= {radius} OR d_dhash <= {radius} OR d_phash <= {radius} OR d_dhash_oriented <= {radius})"""


_PAIRS = _HASHED + "," + _candidates()
_IMAGES = """
colours AS MATERIALIZED (
  SELECT id, i, px[i + 1] AS r, px[(i + 21) % 64 + 1] AS g, px[(i + 42) % 64 + 1] AS b FROM thumbs, range(64) t(i)),
lights AS MATERIALIZED (
  SELECT id, avg(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::FLOAT AS mean_brightness,
    stddev_pop(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::FLOAT AS contrast,
    list((r >> 6) * 16 + (g >> 6) * 4 + (b >> 6)) AS bins FROM colours GROUP BY id),
images AS MATERIALIZED (
  SELECT id, (200 + id * 37 % 800)::INTEGER AS width, (150 + id * 53 % 600)::INTEGER AS height, (1000 + id * 7919 % 90000)::BIGINT AS file_size,
    mean_brightness, contrast, list_transform(range(64), lambda k: len(list_filter(bins, lambda x: x = k))) AS hist
  FROM lights)"""
_FEATURED = _PAIRS + "," + _IMAGES + """,
featured AS MATERIALIZED (
  SELECT p.*, (least(a.width * a.height, b.width * b.height)::DOUBLE / greatest(a.width * a.height, b.width * b.height))::FLOAT AS dim_ratio,
    abs(ln((a.width::DOUBLE / a.height) / (b.width::DOUBLE / b.height)))::FLOAT AS aspect_delta,
    (least(a.file_size, b.file_size)::DOUBLE / greatest(a.file_size, b.file_size))::FLOAT AS size_ratio,
    (1 - list_sum(list_transform(range(64), lambda k: least(a.hist[k + 1], b.hist[k + 1]))) / 64.0::DOUBLE)::FLOAT AS hist_distance,
    (abs(a.mean_brightness::DOUBLE - b.mean_brightness::DOUBLE) / 255)::FLOAT AS brightness_delta,
    least(1, abs(a.contrast::DOUBLE - b.contrast::DOUBLE) / 128)::FLOAT AS contrast_delta
  FROM pairs p JOIN images a ON a.id = p.a JOIN images b ON b.id = p.b)"""
_Z = " + ".join([f"({SHIPPED_INTERCEPT!r})::DOUBLE"] + [f"({c!r})::DOUBLE * ({k}::DOUBLE - ({m!r})::DOUBLE) / ({s!r})::DOUBLE" for k, (m, s, c) in SHIPPED.items()])
_SCORED = _FEATURED + f""",
probable AS MATERIALIZED (SELECT *, (1 / (1 + exp(-({_Z}))))::FLOAT AS probability FROM featured),
scored AS MATERIALIZED (SELECT *, (probability::DOUBLE >= ({SHIPPED_THRESHOLD!r})::DOUBLE)::INTEGER AS verdict FROM probable)"""
_LABELLED = _SCORED + """,
labelled AS MATERIALIZED (
  SELECT s.*, x.label AS label_a, (x.label = y.label)::INTEGER AS label FROM scored s JOIN embeddings x ON x.vec_id = s.a JOIN embeddings y ON y.vec_id = s.b)"""
_COMPONENTS = _SCORED + """,
edges AS MATERIALIZED (SELECT a AS u, b AS v FROM scored WHERE verdict = 1 UNION SELECT b, a FROM scored WHERE verdict = 1),
reach(u, v) AS (SELECT DISTINCT u, u FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v),
parts AS MATERIALIZED (SELECT u AS id, min(v) AS component FROM reach GROUP BY u)"""
_KEPT = _COMPONENTS + """,
kept AS MATERIALIZED (
  SELECT component, arg_max(p.id, (i.width::BIGINT * i.height, i.file_size, -p.id)) AS keep, sum(i.file_size) AS bytes, count(*) AS size
  FROM parts p JOIN images i ON i.id = p.id GROUP BY component),
near AS MATERIALIZED (SELECT k.component, k.keep, k.size, (k.bytes - i.file_size)::BIGINT AS reclaimable_bytes FROM kept k JOIN images i ON i.id = k.keep)"""
_SPLIT = "CASE WHEN {0} % 20 < 14 THEN 'train' WHEN {0} % 20 < 17 THEN 'val' ELSE 'test' END"
_MINED = _PAIRS + f""",
mined AS MATERIALIZED (
  SELECT a, b, {_SPLIT.format("a")} AS split, best AS d_min, 0 AS label, 'hard_negative' AS transform FROM pairs
  WHERE {_SPLIT.format("a")} = {_SPLIT.format("b")} AND best >= 4
  QUALIFY row_number() OVER (PARTITION BY {_SPLIT.format("a")} ORDER BY a, b) <= 100)"""
_TRUE = """
truth AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id % 9 = y.vec_id % 9 AND x.vec_id < y.vec_id)"""
_GRID = _LABELLED + """,
wide AS (SELECT 'd_ahash' AS feature, d_ahash AS d, label FROM labelled UNION ALL SELECT 'd_dhash', d_dhash, label FROM labelled UNION ALL SELECT 'd_phash', d_phash, label FROM labelled),
cells AS (
  SELECT feature, t::INTEGER AS threshold, coalesce(sum(label) FILTER (d <= t), 0) AS tp, count(*) FILTER (d <= t) AS n, sum(label) AS total
  FROM wide, range(33) r(t) GROUP BY feature, t),
rates AS (SELECT *, CASE WHEN n > 0 THEN tp::DOUBLE / n ELSE 0 END AS p, CASE WHEN total > 0 THEN tp::DOUBLE / total ELSE 0 END AS r FROM cells),
grid AS MATERIALIZED (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM rates)"""
_CURVE = _LABELLED + """,
steps AS (SELECT probability, sum(label) AS hits, count(*) AS n FROM labelled GROUP BY probability),
curve AS MATERIALIZED (
  SELECT probability, sum(hits) OVER w / sum(n) OVER w AS p, sum(hits) OVER w / (SELECT sum(label) FROM labelled) AS r
  FROM steps WINDOW w AS (ORDER BY probability DESC ROWS UNBOUNDED PRECEDING))"""


def _with(parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts.strip()}\n{select}"


def _greedy(core: str, cap: int, select: str) -> str:
    """Edges one at a time by falling probability: the state is each node's label, and each label's weakest edge."""
    return _with(
        _SCORED + f""",
    good AS MATERIALIZED (SELECT a, b, probability AS p FROM scored WHERE verdict = 1),
    nodes AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT a AS id FROM good UNION SELECT b FROM good)),
    queue AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p DESC, a, b) AS k, x.i AS i, y.i AS j, p FROM good JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b),
    state(k, label, weakest, weak, capped) AS (
      SELECT 0::BIGINT, (SELECT coalesce(list(i ORDER BY i), []) FROM nodes), (SELECT coalesce(list(1::FLOAT ORDER BY i), []) FROM nodes), 0::BIGINT, 0::BIGINT
      UNION ALL SELECT k,
        CASE WHEN act = 'join' THEN list_transform(label, lambda x: CASE WHEN x = hi THEN lo ELSE x END) ELSE label END,
        CASE WHEN act = 'join' THEN list_transform(weakest, lambda w, n: CASE WHEN n = lo THEN least(w, weakest[hi], p) ELSE w END) ELSE weakest END,
        weak + (act = 'weak')::BIGINT, capped + (act = 'capped')::BIGINT
      FROM (SELECT q.k, s.label, s.weakest, s.weak, s.capped, q.p, least(s.label[q.i], s.label[q.j]) AS lo, greatest(s.label[q.i], s.label[q.j]) AS hi,
          len(list_filter(s.label, lambda x: x = s.label[q.i])) AS m, len(list_filter(s.label, lambda x: x = s.label[q.j])) AS n,
          CASE WHEN s.label[q.i] = s.label[q.j] THEN 'same' WHEN {cap} > 0 AND m + n > {cap} THEN 'capped'
            WHEN q.p < ({core})::FLOAT AND m > 1 AND n > 1 THEN 'weak' ELSE 'join' END AS act
        FROM state s JOIN queue q ON q.k = s.k + 1)),
    last AS MATERIALIZED (SELECT * FROM state ORDER BY k DESC LIMIT 1),
    made AS (
      SELECT min(n.id) AS cluster_id, count(*)::INTEGER AS size, string_agg(n.id::VARCHAR, ',' ORDER BY n.id) AS members, round(any_value(l.weakest[l.label[n.i]])::DOUBLE, 6) AS weakest_link
      FROM nodes n, last l GROUP BY l.label[n.i] HAVING count(*) > 1)""",
        select,
        True,
    )


_NAMES = "(['', " + ", ".join(f"'_{s}'" for s in SUFFIXES) + "])"
_TRANSFORMS = "(['original', " + ", ".join(f"'{s}'" for s in SUFFIXES) + "])"

ORACLE_SQL = {
    "scan_inventory": _with(_FILES, "SELECT format, extension_mismatch, count(*) AS files, sum(size_bytes)::BIGINT AS total_bytes FROM files WHERE format IS NOT NULL AND size_bytes >= 1 GROUP BY ALL"),
    "scan_files": _with(_FILES, "SELECT file_id, path, size_bytes, format, extension_mismatch FROM files WHERE format IS NOT NULL"),
    "scan_skipped_nonimage": _with(_FILES, "SELECT count(*) AS skipped, sum(size_bytes)::BIGINT AS skipped_bytes FROM files WHERE format IS NULL AND size_bytes >= 1"),
    "scan_min_size": _with(_FILES, "SELECT count(*) AS files, min(size_bytes) AS smallest FROM files WHERE format IS NOT NULL AND size_bytes >= 2000"),
    "size_buckets": _with(_FILES, "SELECT size_bytes, count(*) AS files FROM files GROUP BY size_bytes HAVING count(*) >= 2"),
    "exact_groups": _with(_EXACT, "SELECT group_id, n_members, array_to_string(ids, ',') AS members, size_bytes, reclaimable_bytes FROM groups"),
    "exact_members": _with(_EXACT, "SELECT group_id, unnest(ids) AS file_id FROM groups"),
    "exact_summary": _with(
        _EXACT,
        """SELECT h.*, g.* FROM (SELECT count(*) AS files_hashed, coalesce(sum(size_bytes), 0)::BIGINT AS bytes_hashed FROM files
          WHERE size_bytes IN (SELECT size_bytes FROM files GROUP BY size_bytes HAVING count(*) >= 2)) h,
        (SELECT count(*) AS groups, coalesce(sum(n_members), 0)::BIGINT AS members, coalesce(sum(reclaimable_bytes), 0)::BIGINT AS reclaimable_bytes FROM groups) g""",
    ),
    "exact_hash_fnv1a": _with(
        _FILES,
        """, bytes AS (SELECT file_id, regexp_extract_all((['FFD8FF', '89504E470D0A1A0A', ''])[kind + 1] || hex(encode(text)), '..') AS d FROM files)
        SELECT file_id, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(d, lambda x: ('0x' || x)::UHUGEINT)),
          lambda a, x: (xor(a, x) * 1099511628211) % 18446744073709551616)::UBIGINT)), 16, '0') AS hash FROM bytes""",
    ),
    "ahash": _with(_HASHED, f"SELECT id, {_hex('ahash')} FROM hashes"),
    "dhash": _with(_HASHED, f"SELECT id, {_hex('dhash')} FROM hashes"),
    "phash": _with(_HASHED, f"SELECT id, {_hex('phash')} FROM hashes"),
    "dhash_orientations": _with(_HASHED, "SELECT id, " + ", ".join(_hex(p) for p in _POSES if p != "dhash") + " FROM hashes"),
    "hamming_pairs": _with(_HASHED + "," + _candidates(12), "SELECT a, b, d_ahash, d_dhash, d_phash FROM pairs"),
    "oriented_pairs": _with(_PAIRS, "SELECT a, b, d_dhash, d_dhash_oriented FROM pairs WHERE d_dhash_oriented <= 16"),
    "candidates_union": _with(_PAIRS, "SELECT * FROM pairs"),
    "candidates_topk": _with(
        _PAIRS,
        """SELECT DISTINCT a, b, d_ahash, d_dhash, d_phash, d_dhash_oriented, best FROM (
          SELECT *, row_number() OVER (PARTITION BY image ORDER BY best, a, b) AS n FROM (SELECT *, unnest([a, b]) AS image FROM pairs)) WHERE n <= 5""",
    ),
    "match_metrics": _with(
        _PAIRS,
        """, ends AS (SELECT *, unnest([a, b]) AS image FROM pairs), ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY best, a, b) AS n FROM ends)
        SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM hashes)::BIGINT AS comparisons, (SELECT count(*) FROM pairs) AS pairs_before_cap,
          (SELECT count(*) FROM (SELECT image FROM ends GROUP BY image HAVING count(*) >= 5)) AS images_capped,
          (SELECT count(*) FROM (SELECT DISTINCT a, b FROM ranked WHERE n <= 5)) AS pairs_kept""",
    ),
    "candidate_distance_histogram": _with(_PAIRS, "SELECT best, count(*) AS pairs FROM pairs GROUP BY best"),
    "image_features": _with(_PIXELS + "," + _IMAGES, "SELECT id, width, height, file_size, round(mean_brightness::DOUBLE, 3) AS mean_brightness, round(contrast::DOUBLE, 3) AS contrast, array_to_string(hist, ',') AS histogram FROM images"),
    "pair_features": _with(_FEATURED, "SELECT a, b, " + ", ".join(k if k[:2] == "d_" else f"round({k}::DOUBLE, 6) AS {k}" for k in SHIPPED) + " FROM featured"),
    "pair_scores": _with(_SCORED, "SELECT a, b, round(probability::DOUBLE, 5) AS probability, verdict FROM scored"),
    "verdict_summary": _with(_SCORED, "SELECT count(*) FILTER (verdict = 1) AS accepted, count(*) FILTER (verdict = 0) AS rejected, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (verdict = 0) * 100.0::DOUBLE / count(*) ELSE 0 END, 6) AS rejected_percent FROM scored"),
    "prob_histogram": _with(_SCORED, "SELECT k::INTEGER AS bucket, count(probability) AS pairs FROM range(10) t(k) LEFT JOIN scored ON least(9, floor((probability * 10::FLOAT)::FLOAT)) = k GROUP BY k"),
    "top_confident": _with(_SCORED, "SELECT a, b, round(probability::DOUBLE, 5) AS probability FROM scored ORDER BY scored.probability DESC, a, b LIMIT 1"),
    "fallback_verdicts": _with(_PAIRS, "SELECT a, b, d_phash, (d_phash <= 8)::INTEGER AS verdict, 0::DOUBLE AS probability FROM pairs"),
    "feature_export": _with(_LABELLED, "SELECT a, b, label, " + ", ".join(f"round({k}::DOUBLE, 5) AS {k}" for k in SHIPPED) + " FROM labelled"),
    "components": _with(_COMPONENTS, "SELECT id, component FROM parts", True),
    "clusters_strong": _with(_COMPONENTS, "SELECT component AS cluster_id, id AS member FROM parts", True),
    "cluster_keep": _with(_KEPT, "SELECT component AS cluster_id, keep FROM kept", True),
    "near_reclaimable": _with(_KEPT, "SELECT component AS cluster_id, keep, reclaimable_bytes FROM near", True),
    "report_groups": _with(
        _KEPT + "," + _EXACT,
        """, listed AS (SELECT 'exact' AS type, group_id AS rank, n_members::INTEGER AS size, reclaimable_bytes, 0 AS place FROM groups
          UNION ALL SELECT 'near', component, size::INTEGER, reclaimable_bytes, -size FROM near)
        SELECT type, rank, size, reclaimable_bytes, (row_number() OVER (ORDER BY type, place, rank) - 1)::INTEGER AS id FROM listed""",
        True,
    ),
    "report_summary": _with(
        _KEPT + "," + _EXACT,
        """SELECT e.n + r.n AS total_groups, e.n AS exact_groups, r.n AS near_groups, (e.bytes + r.bytes)::BIGINT AS reclaimable_bytes, 0::BIGINT AS weak_merges_blocked
        FROM (SELECT count(*) AS n, coalesce(sum(reclaimable_bytes), 0) AS bytes FROM groups) e, (SELECT count(*) AS n, coalesce(sum(reclaimable_bytes), 0) AS bytes FROM near) r""",
        True,
    ),
    "groups_at_threshold": _with(
        _KEPT,
        """SELECT n.component AS rank, any_value(n.size)::INTEGER AS members, count(*)::INTEGER AS pairs, any_value(n.reclaimable_bytes) AS reclaimable_bytes
        FROM near n JOIN parts p ON p.component = n.component JOIN scored s ON s.a = p.id AND s.verdict = 1 AND s.probability >= 0.5 GROUP BY n.component""",
        True,
    ),
    "split_by_base": f"SELECT {_SPLIT.format('vec_id')} AS split, label, count(*) AS bases FROM embeddings GROUP BY ALL",
    "positives": f"""SELECT vec_id AS base_a, vec_id AS base_b, variant, {_SPLIT.format('vec_id')} AS split, 1 AS label
        FROM (SELECT vec_id, unnest([{', '.join(f"'{s}'" for s in SUFFIXES)}]) AS variant FROM embeddings)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY md5('42:' || vec_id || ':' || variant), variant) <= 3""",
    "negatives": f"""WITH r AS (SELECT vec_id, {_SPLIT.format('vec_id')} AS split, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY {_SPLIT.format('vec_id')}) AS n
        FROM embeddings WINDOW w AS (PARTITION BY {_SPLIT.format('vec_id')} ORDER BY md5('42:' || vec_id)))
        SELECT DISTINCT least(x.vec_id, y.vec_id) AS base_a, greatest(x.vec_id, y.vec_id) AS base_b, x.split, 0 AS label
        FROM r x JOIN r y ON x.split = y.split AND y.k = (x.k + 1) % x.n WHERE x.vec_id <> y.vec_id""",
    "hashed_split": """SELECT CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split, count(*) AS bases
        FROM (SELECT ('0x' || md5('42:' || doc_id)[1:8])::BIGINT % 100 AS h FROM documents) GROUP BY 1""",
    "base_sizes": "SELECT files, count(*) AS bases, files = 1 AS singletons FROM (SELECT count(*) AS files FROM embeddings GROUP BY label) GROUP BY files",
    "worst_false_positives": _with(_LABELLED, "SELECT a, b, round(probability::DOUBLE, 5) AS probability FROM labelled WHERE label = 0 AND verdict = 1 ORDER BY labelled.probability DESC, a, b LIMIT 15"),
    "worst_false_negatives": _with(_LABELLED, "SELECT a, b, round(probability::DOUBLE, 5) AS probability FROM labelled WHERE label = 1 AND verdict = 0 ORDER BY labelled.probability, a, b LIMIT 15"),
    "largest_groups": _with(_EXACT, "SELECT group_id, n_members AS copies, reclaimable_bytes, printf('%.2f MB', reclaimable_bytes / 1048576.0::DOUBLE) AS reclaimable FROM groups ORDER BY reclaimable_bytes DESC, group_id LIMIT 5"),
    "sql_functions": _with(
        _HASHED + "," + _IMAGES,
        """SELECT a.id AS a, b.id AS b, bit_count(xor(a.dhash, b.dhash))::INTEGER AS d_dhash,
          round((1 - list_sum(list_transform(range(64), lambda k: least(x.hist[k + 1], y.hist[k + 1]))) / 64.0::DOUBLE)::FLOAT::DOUBLE, 5) AS hist_distance
        FROM hashes a JOIN thumbs t ON t.id = a.id JOIN thumbs u ON u.label = t.label AND u.id > t.id JOIN hashes b ON b.id = u.id JOIN images x ON x.id = a.id JOIN images y ON y.id = b.id""",
    ),
    "scan_images": _with(
        _FILES,
        """SELECT CASE WHEN format IS NULL THEN 'skipped' ELSE 'image' END AS kind, format, CASE WHEN format IS NOT NULL THEN extension_mismatch END AS extension_mismatch,
          count(*) AS files, sum(size_bytes)::BIGINT AS total_bytes FROM files WHERE size_bytes >= 1 GROUP BY ALL""",
    ),
    "decode_images": _with(
        _PIXELS,
        f""", gray AS MATERIALIZED (SELECT id, list_transform(range(64), lambda i: round_even(0.2126::DOUBLE * px[i + 1] + 0.7152::DOUBLE * px[(i + 21) % 64 + 1] + 0.0722::DOUBLE * px[(i + 42) % 64 + 1], 0)::INTEGER) AS g FROM thumbs),
        wide AS MATERIALIZED (SELECT id, g, list_transform(range(72), lambda i: list_sum(list_transform(range(8), lambda c: g[i // 9 * 8 + (8 * (i % 9) + c) // 9 + 1]))::INTEGER // 8) AS w FROM gray)
        SELECT id, 'png' AS format, 72 AS width, 72 AS height, lpad(lower(to_hex(({_sum_of_bits([f"g[{i + 1}] > list_sum(g)::INTEGER // 64" for i in range(64)])})::UBIGINT)), 16, '0') AS ahash,
          lpad(lower(to_hex(({_sum_of_bits([f"w[{9 * (i // 8) + i % 8 + 1}] > w[{9 * (i // 8) + i % 8 + 2}]" for i in range(64)])})::UBIGINT)), 16, '0') AS dhash FROM wide""",
    ),
    "clusters": _greedy("0.9", 0, "SELECT cluster_id, size, members, weakest_link FROM made"),
    "clusters_core_half": _greedy("0.5", 8, "SELECT cluster_id, size, members, weakest_link FROM made"),
    "cluster_blocked": _greedy("0.9", 0, "SELECT weak AS weak_blocked, capped AS size_blocked FROM last"),
    "mine_negatives": _with(_MINED, "SELECT * FROM mined"),
    "mined_unknown_bases": _with(_PAIRS, "SELECT count(*) AS pairs FROM pairs WHERE a % 7 = 0 OR b % 7 = 0"),
    "mined_distance_hist": _with(_MINED, "SELECT (d_min // 4 * 4)::INTEGER AS d_from, count(*) AS pairs FROM mined GROUP BY ALL"),
    "merge_hard_negatives": _with(
        _MINED,
        """SELECT transform, label, count(*) AS pairs FROM (SELECT transform, label FROM mined UNION ALL
          SELECT 'candidate', (x.label = y.label)::INTEGER FROM pairs JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b) GROUP BY ALL""",
    ),
    "baseline_grid": _with(_GRID, "SELECT feature, threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM grid"),
    "best_baseline": _with(_GRID, "SELECT feature, threshold, round(f1, 6) AS f1 FROM grid ORDER BY grid.f1 DESC, feature, threshold LIMIT 1"),
    "pr_threshold": _with(_CURVE, "SELECT round(probability::DOUBLE, 5) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM curve WHERE p >= 0.05 ORDER BY r DESC, probability LIMIT 1"),
    "eval_metrics": _with(
        _LABELLED,
        """, n AS (SELECT count(*) FILTER (label = 1 AND verdict = 1) AS tp, count(*) FILTER (label = 0 AND verdict = 1) AS fp, count(*) FILTER (label = 1 AND verdict = 0) AS fn,
          count(*) FILTER (label = 0 AND verdict = 0) AS tn, avg((probability::DOUBLE - label) ** 2) AS brier FROM labelled),
        m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM n)
        SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(brier, 5) AS brier FROM m""",
    ),
    "average_precision": _with(_CURVE, "SELECT round(sum((r - before) * p), 6) AS average_precision FROM (SELECT *, lag(r, 1, 0) OVER (ORDER BY probability DESC) AS before FROM curve)"),
    "recall_by_group": _with(_LABELLED, "SELECT label_a, count(*) AS pairs, round(avg(verdict), 6) AS recall, avg(verdict) < 0.9 AS weak FROM labelled WHERE label = 1 GROUP BY label_a"),
    "distance_quantiles": _with(_LABELLED, "SELECT label_a, round(quantile_cont(best, 0.5), 6) AS median_distance, round(quantile_cont(best, 0.9), 6) AS p90_distance FROM labelled GROUP BY label_a"),
    "truth_pairs": _with(_TRUE, "SELECT count(*) AS pairs, sum(a)::BIGINT AS sum_a, sum(b)::BIGINT AS sum_b FROM truth"),
    "pair_confusion": _with(_PAIRS + "," + _TRUE, "SELECT (SELECT count(*) FROM truth SEMI JOIN pairs USING (a, b)) AS tp, (SELECT count(*) FROM pairs ANTI JOIN truth USING (a, b)) AS fp, (SELECT count(*) FROM truth ANTI JOIN pairs USING (a, b)) AS fn"),
    "tp_pairs": _with(_PAIRS + "," + _TRUE, "SELECT a, b FROM truth INTERSECT SELECT a, b FROM pairs"),
    "fp_pairs": _with(_PAIRS + "," + _TRUE, "SELECT a, b FROM pairs EXCEPT SELECT a, b FROM truth"),
    "fn_pairs": _with(_PAIRS + "," + _TRUE, "SELECT count(*) AS pairs, sum(a)::BIGINT AS sum_a, sum(b)::BIGINT AS sum_b FROM truth ANTI JOIN pairs USING (a, b)"),
    "recall_by_transform": _with(
        _PAIRS + "," + _TRUE,
        f""", ends AS (SELECT unnest([t.a, t.b]) AS image, p.a IS NOT NULL AS hit FROM truth t LEFT JOIN pairs p ON p.a = t.a AND p.b = t.b),
        named AS (SELECT {_TRANSFORMS}[image % 9 + 1] AS transform, hit FROM ends)
        SELECT transform, count(*) AS pairs, count(*) FILTER (hit) AS found, round(count(*) FILTER (hit) / count(*), 6) AS recall, count(*) FILTER (hit) / count(*) < 0.5 AS weak
        FROM named WHERE transform != 'original' GROUP BY transform""",
    ),
    "name_parts": f"SELECT doc_id, 'img_' || doc_id AS base, CASE WHEN doc_id % 9 = 0 THEN 'original' ELSE {_NAMES}[doc_id % 9 + 1][2:] END AS transform FROM documents",
}
