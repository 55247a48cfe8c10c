"""Small cases of the duplicate-detection operators."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import echofold
from echofold.functions import features
from echofold.functions.features import FEATURES
from echofold.functions.signatures import HASHES, as_hex, hamming, phash_values, signatures
from echofold.operators import clustering, evaluate, exact, graph, matching, report, scoring, training


def test_version():
    assert echofold.__version__ == "0.1.0"


# Exact duplicates


@pytest.mark.parametrize("content, want", [(b"", "cbf29ce484222325"), (b"a", "af63dc4c8601ec8c"), (b"foobar", "85944171f73967e8")])
def test_fnv1a_vectors(spark, content, want):
    df = spark.createDataFrame([(bytearray(content),)], "content binary")
    assert df.select(exact.fnv1a_hex(F.col("content")).alias("h")).first()["h"] == want
    assert exact.fnv1a(df).select(as_hex(F.col("hash")).alias("h")).first()["h"] == want


def test_fnv1a_of_many_lengths_equals_the_plain_loop():
    r = random.Random(1)
    values = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 2, 5, 5, 40]))) for _ in range(200)]
    for v, h in zip(values, exact.fnv1a_bytes(values).tolist()):
        want = exact.OFFSET
        for b in v:
            want = (want ^ b) * exact.PRIME % 2**64
        assert h == want


def files(spark, bodies):
    return spark.createDataFrame([(i, bytearray(b"\xff\xd8\xff" + b)) for i, b in enumerate(bodies)], "file_id long, content binary").withColumn("size_bytes", F.octet_length("content").cast("long"))


@pytest.mark.parametrize(
    "bodies, groups, hashed, bytes_back",
    [
        ([b"same-content"] * 3 + [b"other-stuff!"], 1, 4, 30),
        ([b"aaaaaaaa", b"bbbbbbbb"], 0, 2, 0),
        ([b"short", b"much-longer-content-here"], 0, 0, 0),
        ([b"0123456789"] * 2, 1, 2, 13),
        ([], 0, 0, 0),
    ],
)
def test_exact_groups(spark, bodies, groups, hashed, bytes_back):
    rows = files(spark, bodies)
    assert exact.exact_groups(rows).count() == groups
    got = exact.exact_summary(rows).first()
    assert (got["groups"], got["files_hashed"], got["reclaimable_bytes"]) == (groups, hashed, bytes_back)


# Signatures


@pytest.mark.parametrize("a, b, want", [(0, 0, 0), (-1, 0, 64), (0b1011, 0b1101, 2)])
def test_hamming(spark, a, b, want):
    assert spark.range(1).select(hamming(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("d")).first()["d"] == want


def hashes(spark, images):
    return signatures(spark.createDataFrame([(i, x) for i, x in enumerate(images)], "id long, px array<int>")).orderBy("id").collect()


def test_flat_image_has_no_gradient(spark):
    row = hashes(spark, [[128] * 64])[0]
    assert [row[h] for h in HASHES if h.startswith("dhash")] == [0] * 5 and row["ahash"] == 0


def test_poses_of_an_image_are_found():
    from echofold.sources.decode import hashes_of

    base = np.kron(np.random.RandomState(3).randint(0, 256, (9, 9)), np.ones((8, 8))).astype(np.uint8)
    poses = [base, base[:, ::-1], np.rot90(base, -1), np.rot90(base, 2), np.rot90(base, 1)]
    found = [hashes_of(np.ascontiguousarray(p)) for p in poses]
    apart = lambda a, b: bin((a ^ b) % 2**64).count("1")
    for k, pose in enumerate(poses):
        assert min(apart(found[0][h], found[k]["dhash"]) for h in HASHES if h.startswith("dhash")) <= 10


def test_image_expressions_equal_the_array_kernels(spark):
    from echofold.functions.signatures import dhash_variants
    from echofold.sources.decode import ahash_of, dhash_of

    base = np.random.RandomState(6).randint(0, 256, (8, 8))
    row = hashes(spark, [base.ravel().tolist()])[0]
    flat = base.ravel()
    assert row["ahash"] == ahash_of(base)
    for name, grid in dhash_variants().items():
        wide = np.array([[flat[grid(x, y)] for x in range(9)] for y in range(8)])
        assert row[name] == dhash_of(wide)


def test_phash_of_close_images_is_close_and_its_first_bit_is_clear():
    r = np.random.RandomState(5)
    a = np.kron(r.randint(40, 200, (8, 8)), np.ones((4, 4))).astype(int)
    b = np.clip(a + r.randint(-3, 4, a.shape), 0, 255)
    x, y = phash_values(np.stack([a, b])).tolist()
    assert bin(x ^ y).count("1") <= 6 and x % 2 == 0


def test_phash_sums_in_double_precision(spark):
    # Two terms lie within 1e-4 of the median, which single precision does not tell apart; row 413 of sf0.1.
    import duckdb
    from helpers import DATA

    from echofold.plans import adapters
    from echofold.plans.oracle import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/sf0.1/embeddings.parquet'")
    want = con.execute(f"SELECT id, phash FROM ({ORACLE_SQL['phash']}) ORDER BY id").fetchall()
    got = adapters.hashed(spark, f"{DATA}/sf0.1").select("id", as_hex(F.col("phash")).alias("h")).orderBy("id").collect()
    assert [tuple(r) for r in got] == want


# Matching


def rows(spark, hashes_by_id, poses=None):
    made = [(i, a, d, p, *(poses or [0] * 4)) for i, (a, d, p) in enumerate(hashes_by_id)]
    return spark.createDataFrame(made, "id long, ahash long, dhash long, phash long, dhash_mirror long, dhash_rot90 long, dhash_rot180 long, dhash_rot270 long")


FAR = 0x0F0F0F0F0F0F0F0F


def test_equal_hashes_make_a_pair(spark):
    got = matching.candidates(rows(spark, [(255, 255, 255)] * 2)).collect()
    assert len(got) == 1 and got[0]["d_dhash"] == 0 and (got[0]["a"], got[0]["b"]) == (0, 1)


def test_one_close_hash_is_enough(spark):
    got = matching.candidates(rows(spark, [(0, -1, -1), (3, 0, 0)], [FAR] * 4)).collect()
    assert len(got) == 1 and (got[0]["d_ahash"], got[0]["d_dhash"]) == (2, 64)


def test_opposite_hashes_make_none(spark):
    assert matching.candidates(rows(spark, [(0, 0, 0), (-1, -1, -1)])).count() == 0


@pytest.mark.parametrize("k", [0, 5])
def test_cap_per_image(spark, k):
    all_rows = rows(spark, [(0, 0, 0)] * 20)
    pairs = matching.candidates(all_rows)
    got = matching.match_metrics(all_rows, pairs, k).first()
    assert got["comparisons"] == 190 and got["pairs_before_cap"] == 190
    assert got["pairs_kept"] == 190 and got["images_capped"] == 0 if k == 0 else got["pairs_kept"] <= 100 and got["images_capped"] > 0


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_pairs_do_not_depend_on_blocks_or_order(spark, blocks):
    r = random.Random(2)
    data = rows(spark, [tuple(r.getrandbits(63) for _ in range(3)) for _ in range(40)])
    got = {(x["a"]["id"], x["b"]["id"]) for x in matching.self_pairs(data.orderBy(F.rand(1)), blocks).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40)} and matching.self_pairs(data, blocks).count() == 780


# Features and scores


def one_hot(*bins):
    return [1.0 / len(bins) if i in bins else 0.0 for i in range(64)]


@pytest.mark.parametrize("a, b, want", [((5,), (5,), 0.0), ((0,), (63,), 1.0), ((0, 1), (1, 2), 0.5)])
def test_histogram_distance(spark, a, b, want):
    df = spark.createDataFrame([(one_hot(*a), one_hot(*b))], "a array<float>, b array<float>")
    assert df.select(features.hist_distance(F.col("a"), F.col("b")).alias("d")).first()["d"] == pytest.approx(want)


def image_rows(spark, n=2, **change):
    base = {"width": 800, "height": 600, "file_size": 1000, "mean_brightness": 100.0, "contrast": 20.0, "histogram": one_hot(3)} | change
    return spark.createDataFrame([(i, *base.values()) for i in range(n)], "id long, width int, height int, file_size long, mean_brightness float, contrast float, histogram array<float>")


def test_neutral_pair_and_skipped_pairs(spark):
    pairs = spark.createDataFrame([(0, 1, 0, 0, 0, 0), (0, 9, 0, 0, 0, 0)], "a long, b long, d_ahash int, d_dhash int, d_phash int, d_dhash_oriented int")
    got = scoring.pair_features(pairs, image_rows(spark)).collect()
    assert len(got) == 1 and [got[0][k] for k in FEATURES] == [0, 0, 0, 1, 0, 1, 0, 0, 0, 0]
    assert [(r["a"], r["b"]) for r in scoring.skipped_pairs(pairs, image_rows(spark)).collect()] == [(0, 9)]


def model(coef=None, intercept=0.0):
    return scoring.Classifier((0.0,) * 10, (1.0,) * 10, tuple(coef or [0.0] * 10), intercept, 0.5, True)


def probability(spark, m, **values):
    df = spark.createDataFrame([tuple(float(values.get(k, 0)) for k in FEATURES)], ", ".join(f"{k} double" for k in FEATURES))
    return scoring.score(df, m).first()


def test_logistic_scores(spark):
    assert probability(spark, model())["probability"] == pytest.approx(0.5)
    assert probability(spark, model(intercept=2.0))["probability"] == pytest.approx(0.880797, abs=1e-6)
    falling = model([0, -1] + [0] * 8)
    near, far = probability(spark, falling), probability(spark, falling, d_dhash=30)
    assert near["probability"] > far["probability"] and (near["verdict"], far["verdict"]) == (1, 0)


def test_without_a_model_the_dct_hash_decides(spark):
    none = scoring.Classifier()
    assert [probability(spark, none, d_phash=d)["verdict"] for d in (8, 9)] == [1, 0] and probability(spark, none)["probability"] == 0


@pytest.mark.parametrize("change, message", [({"schema_version": 2}, "schema_version"), ({"model": "tree"}, "model"), ({"feature_names": list(FEATURES[::-1])}, "feature mismatch"), ({"coef": [1.0]}, "entries")])
def test_model_files_are_checked(change, message, tmp_path):
    good = json.loads(scoring.model_json(scoring.Classifier.shipped()))
    assert scoring.parse_model(json.dumps(good)) == scoring.Classifier.shipped()
    with pytest.raises(scoring.ModelError, match=message):
        scoring.parse_model(json.dumps(good | change))
    with pytest.raises(scoring.ModelError, match="malformed"):
        scoring.parse_model("{ this is not json")
    with pytest.raises(scoring.ModelError, match="cannot open"):
        scoring.load_model(str(tmp_path / "none.json"))


def test_probability_one_falls_into_the_last_bucket(spark):
    df = spark.createDataFrame([(1.0,), (0.7,), (0.0,)], "probability float")
    got = {r["bucket"]: r["pairs"] for r in scoring.probability_histogram(df).collect()}
    assert len(got) == 10 and (got[9], got[7], got[0]) == (1, 1, 1)


# Graph and clusters


def edges(spark, *rows_):
    return spark.createDataFrame(list(rows_), "a long, b long, probability float")


CASES = [
    ([(0, 1, 0.99), (1, 2, 0.98)], {}, [([0, 1, 2], 0.98)], 0, 0),
    ([(0, 1, 0.99), (2, 3, 0.99), (1, 2, 0.55)], {}, [([0, 1], 0.99), ([2, 3], 0.99)], 1, 0),
    ([(0, 1, 0.99), (1, 2, 0.55)], {}, [([0, 1, 2], 0.55)], 0, 0),
    ([(0, 1, 0.99), (1, 2, 0.99), (2, 3, 0.99)], {"max_size": 2}, [([0, 1], 0.99), ([2, 3], 0.99)], 0, 1),
    ([(0, 1, 0.99), (2, 3, 0.99), (3, 4, 0.99), (4, 5, 0.99)], {}, [([2, 3, 4, 5], 0.99), ([0, 1], 0.99)], 0, 0),
]


@pytest.mark.parametrize("given_edges, options, want, weak, capped", CASES)
def test_clusters(spark, given_edges, options, want, weak, capped):
    found = clustering.clustered(edges(spark, *given_edges), **options)
    got = [(r["members"], round(r["weakest_link"], 2)) for r in clustering.clusters(found).collect()]
    assert got == want and tuple(clustering.blocked(found).first()) == (weak, capped)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 99)), max_size=30), st.integers(0, 4))
def test_clusters_by_component_equal_those_of_all_edges(raw, cap):
    e = sorted({(min(a, b), max(a, b)): p / 100 for a, b, p in raw if a != b}.items())
    if not e:
        return
    a, b, p = (np.array(c) for c in zip(*[(x[0], x[1], v) for x, v in e]))
    whole, weak, capped = clustering.greedy(a, b, p, 0.6, cap)
    up = list(range(10))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, y in zip(a, b):
        up[root(x)] = root(y)
    roots = np.array([root(x) for x in a])
    parts = [clustering.greedy(a[roots == k], b[roots == k], p[roots == k], 0.6, cap) for k in set(roots.tolist())]
    merged = {k: v for part in parts for k, v in part[0].items()}
    assert merged == whole and (sum(x[1] for x in parts), sum(x[2] for x in parts)) == (weak, capped)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    df = spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}
    assert graph.connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("images, keep", [([(800, 600, 500000), (1920, 1080, 100), (400, 300, 900000)], 1), ([(800, 600, 100000), (800, 600, 250000)], 1), ([(8, 8, 5), (8, 8, 5)], 0)])
def test_keep_by_pixels_then_bytes_then_order(spark, images, keep):
    members = spark.createDataFrame([(0, i) for i in range(len(images))], "cluster_id long, member long")
    sizes = spark.createDataFrame([(i, *x) for i, x in enumerate(images)], "id long, width int, height int, file_size long")
    assert clustering.keepers(members, sizes).first()["keep"] == keep


def test_pairs_within_a_label(spark):
    rows = spark.range(60).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("label"))
    got = [(r[0], r[1]) for r in matching.self_pairs(rows, 4, by=("label",)).select("a.id", "b.id").collect()]
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 7 and b % 7 and a % 3 == b % 3]
    assert sorted(got) == want


@pytest.mark.parametrize("n", [0, 3, 64, 65])
def test_hist_distance_in_sql_for_arrays_of_any_size(spark, n):
    from echofold.plans import views

    views.register(spark)
    r = random.Random(n)
    a, b = ([r.random() / 99 for _ in range(n)] for _ in "ab")
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    want = 1 - sum(min(x, y) for x, y in zip(a, b))
    assert df.selectExpr("hist_distance(a, b) AS d").first()["d"] == pytest.approx(want, abs=1e-6)


def test_sql_functions_joins_pairs_with_nothing(spark):
    # Each label's pairs are made in tiles by the last join; one more join would shuffle all pairs.
    import re

    from helpers import DATA

    from echofold.plans.catalogue import QUERIES

    plan = QUERIES["sql_functions"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin ", plan)) == 1


# Report


def test_report_file(spark, tmp_path):
    members = spark.createDataFrame([(0, 0, 0.97), (0, 1, 0.97)], "cluster_id long, member long, weakest_link float")
    images = spark.createDataFrame([(0, "big.jpg", 900000, 1920, 1080, "jpeg"), (1, "small.jpg", 100000, 640, 480, "jpeg")], "id long, path string, file_size long, width int, height int, format string")
    values = [0.0, 3.0] + [0.0] * 8
    scored = spark.createDataFrame([(0, 1, 1, 0.97, *values)], "a long, b long, verdict int, probability float, " + ", ".join(f"{k} double" for k in FEATURES))
    near = report.near_rows(members, images, scored)
    none = report.exact_rows(exact.exact_groups(files(spark, [])), spark.createDataFrame([], "file_id long, path string"))
    report.write_report(str(tmp_path / "r.json"), none, near, {"roots": []}, [], {"total_groups": 1})
    got = json.loads((tmp_path / "r.json").read_text())
    group = got["groups"][0]
    assert got["schema_version"] == 1 and group["type"] == "near" and group["keep"] == "big.jpg" and group["reclaimable_bytes"] == 100000
    assert len(group["pairs"]) == 1 and group["pairs"][0]["features"]["d_dhash"] == 3 and sum(m["keep"] for m in group["members"]) == 1
    with pytest.raises(ValueError):
        report.write_report(str(tmp_path / "x.json"), None, near, {}, [], {})


def near_case(spark):
    members = spark.createDataFrame([(0, 0, 0.3), (0, 1, 0.3), (0, 2, 0.3), (5, 5, 0.4), (5, 6, 0.4)], "cluster_id long, member long, weakest_link float")
    images = spark.createDataFrame([(i, f"{i}.png", 10 + i, 8, 8, "png") for i in range(7)], "id long, path string, file_size long, width int, height int, format string")
    edges = [(0, 1, 1, 0.9), (1, 2, 1, 0.3), (0, 2, 0, 0.01), (5, 6, 1, 0.4), (2, 5, 1, 0.8)]
    scored = spark.createDataFrame([(*e, *[float(k) for k in range(10)]) for e in edges], "a long, b long, verdict int, probability float, " + ", ".join(f"{k} double" for k in FEATURES))
    return members, images, scored


def test_near_groups_as_lines_hold_what_the_rows_hold(spark):
    case = near_case(spark)
    lines = [(r["rank"], r["part"], json.loads(r["json"])) for r in report.near_lines(*case).collect()]
    of = lambda rank, part: [x for k, p, x in lines if (k, p) == (rank, part)]
    for row in report.near_rows(*case).collect():
        group = row.asDict(recursive=True)
        head = of(group["rank"], "group")
        assert [(h["type"], h["size"], h["keep"], h["reclaimable_bytes"], h["weakest_link"]) for h in head] == [("near", len(group["members"]), group["keep"], group["reclaimable_bytes"], pytest.approx(group["weakest_link"]))]
        assert sorted(of(group["rank"], "member"), key=lambda m: m["member"]) == group["members"]
        pairs = sorted(of(group["rank"], "pair"), key=lambda p: (p["a"], p["b"]))
        assert [(p["a"], p["b"], p["features"]) for p in pairs] == [(p["a"], p["b"], p["features"]) for p in group["pairs"]]
    assert len(lines) == 2 + 5 + 3


def test_groups_at_a_threshold_are_counted_and_not_gathered(spark):
    case = near_case(spark)
    for threshold in (0.35, 0.5):
        shown = report.groups_at(report.near_rows(*case), threshold).select("rank", F.size("members"), F.size("pairs"), "reclaimable_bytes")
        counted = report.counted_at(*case, threshold)
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, shown.collect()))
        assert "collect_list" not in counted._jdf.queryExecution().executedPlan().toString()


# Training and evaluation


def test_training_reads_what_stands_behind_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    values = [(k % 2, *[float((k * (j + 3)) % 7) for j in range(10)]) for k in range(40)]
    rows = spark.createDataFrame(values, "label int, " + ", ".join(f"{k} double" for k in FEATURES))
    assert training.train(rows.mapInArrow(run, rows.schema)).loaded and seen.value == 40


def test_negatives_stay_in_their_split(spark):
    bases = spark.range(200).select(F.col("id").alias("base"), F.when(F.col("id") % 3 == 0, "train").otherwise("test").alias("split"))
    got = training.random_negatives(bases, per_base=2).collect()
    assert len(got) == len({(r["base_a"], r["base_b"]) for r in got}) >= 390
    assert all((r["base_a"] % 3 == 0) == (r["base_b"] % 3 == 0) == (r["split"] == "train") and r["base_a"] < r["base_b"] for r in got)


def test_mined_negatives_pass_all_filters(spark):
    pairs = spark.createDataFrame([(0, 1, 5, 9, 9), (0, 2, 3, 9, 9), (0, 3, 9, 9, 9), (1, 4, 9, 9, 9), (0, 4, 9, 9, 9), (0, 99, 9, 9, 9)], "a long, b long, d_ahash int, d_dhash int, d_phash int")
    splits = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x"), (3, "y"), (4, "x")], "base long, split string")
    assert [(r["a"], r["b"]) for r in training.mined(pairs, splits, 2).orderBy("a", "b").collect()] == [(0, 1), (0, 4)]
    assert [(r["a"], r["b"]) for r in training.unknown_pairs(pairs, splits).collect()] == [(0, 99)]


def test_threshold_and_average_precision(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0)], "probability float, label int")
    got = training.best_threshold(scored).first()
    assert got["threshold"] == pytest.approx(0.8) and got["recall"] == pytest.approx(2 / 3)
    assert evaluate.average_precision(scored).first()[0] == pytest.approx((1 + 1 + 0.75) / 3)
    assert training.best_threshold(scored.where("label = 0")).first()["threshold"] == 0.5


def test_training_separates(spark):
    r = random.Random(4)
    rows_ = [(y, *[r.gauss(2 * y if k == 2 else 0, 1) for k in range(10)]) for y in (0, 1) for _ in range(150)]
    df = spark.createDataFrame(rows_, "label int, " + ", ".join(f"{k} double" for k in FEATURES))
    fitted = training.train(df)
    assert training.coefficients(fitted, spark).first()["feature"] == FEATURES[2]
    got = evaluate.classification_metrics(scoring.score(df, fitted)).first()
    assert got["f1"] > 0.75


def test_truth_from_names(spark):
    names = ["cat.jpg", "cat_win_resize.jpg", "cat_exact_dup.png", "my_dog_rotated.jpeg", "plain_name.png"]
    df = spark.createDataFrame([(n,) for n in names], "file string").select("file", evaluate.base_and_transform(F.col("file")).alias("p")).select("file", "p.*")
    got = {r["file"]: (r["base"], r["transform"]) for r in df.collect()}
    assert got == {"cat.jpg": ("cat", "original"), "cat_win_resize.jpg": ("cat", "win_resize"), "cat_exact_dup.png": ("cat", "exact_dup"), "my_dog_rotated.jpeg": ("my_dog", "rotated"), "plain_name.png": ("plain_name", "original")}
    true = evaluate.truth_pairs(df)
    assert true.count() == 3
    found = true.limit(2).unionByName(spark.createDataFrame([("a", "b")], "a string, b string"))
    assert tuple(evaluate.confusion(true, found).first()) == (2, 1, 1)
    assert evaluate.false_positives(true, found).count() == 1 and evaluate.true_positives(true, found).count() == 2 and evaluate.false_negatives(true, found).count() == 1


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_numbers_and_sums(spark, n):
    from echofold.operators.running import numbered, running_sums

    df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(1009)).alias("x"))
    got = [(r["x"], r["id"]) for r in numbered(df, [F.col("x").desc()]).collect()]
    assert sorted(got) == sorted((x, k) for k, x in enumerate(sorted((i * 7919 % 1009 for i in range(n)), reverse=True)))
    sums = {r["x"]: r["s"] for r in running_sums(df, [F.col("x")], {"s": F.col("x")}).collect()}
    total = 0
    for x in sorted(sums):
        total += x
        assert sums[x] == total


def test_transforms_keep_what_they_should():
    from echofold.operators import transforms as t

    image = np.kron(np.random.RandomState(1).randint(0, 256, (6, 8, 3)), np.ones((10, 10, 1))).astype(np.uint8)
    for name, (kernel, strengths) in (t.TRANSFORMS | t.CROPS).items():
        for s in strengths:
            made = kernel(image, s)
            assert made.dtype == np.uint8 and made.ndim == 3, name
    assert t.scaled(image, 0.5).shape == (30, 40, 3) and t.cropped(image, 0.25).shape == (30, 40, 3)
    assert (t.flipped(t.flipped(image, 0), 0) == image).all() and (t.lossless(image, 0) == image).all() and (t.brighter(image, 1.0) == image).all()
    assert np.abs(t.quantised(image, 95).astype(int) - image).mean() < np.abs(t.quantised(image, 10).astype(int) - image).mean() < 40
    flat = np.full((20, 20, 3), 77, np.uint8)
    assert (t.blurred(flat, 2.0) == flat).all() and (t.more_colour(flat, 1.6) == flat).all() and (t.tilted(flat, 6)[5:15, 5:15] == 77).all()
    assert (t.top_banner(flat, 240)[:6] == 240).all() and (t.corner_bar(flat, 20)[-8:, :11] == 20).all()
    assert t.chosen("x", 3) == t.chosen("x", 3) and len({n for n, _ in t.chosen("x", 3)}) == 3
