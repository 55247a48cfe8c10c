"""Command line: scan ROOT..., export-features MANIFEST OUT [limit], train FEATURES OUT, mine-negatives DIR OUT [radius].

Paths stay rows: what a scan or a manifest names is joined to what Spark's
readers find below the roots, and groups are written by Spark. One report file
is written as well where the groups are few (--rows leaves it out).
"""

from __future__ import annotations

import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions.features import FEATURES
from echofold.functions.signatures import HASHES
from echofold.operators import clustering, exact, matching, report, running, scoring, training
from echofold.plans import views
from echofold.session import local_session, written
from echofold.sources import decode, files

USAGE = "usage: python -m echofold scan [--rows] ROOT... | export-features MANIFEST OUT [limit] | train FEATURES OUT | mine-negatives DIR OUT [radius]"
#: Groups up to which a scan writes its report as one file.
ONE_FILE = 100_000


def _plain(path: str):
    """A path without the scheme, which Spark's readers write in different ways."""
    return F.regexp_replace(path, "^file:/+", "/")


def _images(spark: SparkSession, roots: list[str], wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Decoded images below the roots with ids in the order of their paths, and the failures; wanted: only these paths."""
    read = decode.decode(spark, roots).withColumn("path", _plain("path"))
    if wanted is not None:
        read = read.join(wanted.select("path").distinct(), "path", "left_semi")
    read = written(read, "decoded")
    sized = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select(_plain("path").alias("_path"), F.col("length").alias("file_size"))
    good = decode.decoded(read).join(sized, F.col("path") == F.col("_path")).drop("_path", "error").dropDuplicates(["path"])
    return written(running.numbered(good, [F.col("path")]), "images"), decode.failed(read)


def run_scan(spark: SparkSession, roots: list[str], model: scoring.Classifier, out: str = "duplicate-report.json", classified: str = "classified_csv", one_file: int = ONE_FILE) -> dict:
    """The whole pipeline over folders; writes the report and the judged candidates, returns the totals.

    Groups go to out + ".rows", by Spark; up to one_file of them to `out` too.
    Stages are temporary views afterwards: scan, images, scored, clusters.
    """
    began = time.time()
    scanned = written(files.scan(spark, roots), "scan")
    metrics = files.scan_metrics(scanned).first().asDict()
    found = scanned.where("kind = 'image'").withColumn("path", _plain("path")).dropDuplicates(["path"])
    took = {"scan": (time.time() - began) * 1000}
    if not metrics["images_found"]:
        return {**metrics, "total_groups": 0}
    began = time.time()
    known = found.select("path", "size_bytes", F.xxhash64("path").alias("file_id"))
    # Of files whose size is shared, contents become digests before anything is shuffled by path.
    content = exact.to_hash(files.read_binary(spark, roots)).select(_plain("path").alias("path"), F.sha2("content", 256).alias("content"))
    keyed = known.join(content, "path")
    groups = written(exact.exact_groups(keyed), "exact")
    images, _ = _images(spark, roots, found)
    took["hash_and_features"] = (time.time() - began) * 1000
    began = time.time()
    pairs = matching.top_candidates(matching.candidates(images.select("id", *HASHES)))
    scored = written(scoring.score(scoring.pair_features(pairs, images), model), "scored")
    names = images.select("id", "path")
    judged = scored.join(names.withColumnsRenamed({"id": "a", "path": "path_a"}), "a").join(names.withColumnsRenamed({"id": "b", "path": "path_b"}), "b")
    files.write_csv(judged.select("probability", "verdict", "path_a", "path_b", *FEATURES), classified, quote_all=True)
    grouped = written(clustering.clustered(scored.where("verdict = 1").select("a", "b", "probability")), "clusters")
    took["match"] = (time.time() - began) * 1000
    first = report.exact_rows(groups, known.select("file_id", "path"))
    near = report.near_rows(grouped.where("member IS NOT NULL"), images, scored)
    totals = report.summary(first, near, clustering.blocked(grouped)).first().asDict()
    info = {"roots": roots, "entries_visited": metrics["entries_visited"], "images_found": metrics["images_found"], "skipped_non_image": metrics["skipped_non_image"], "total_bytes": metrics["total_bytes"], "timings_ms": took, "candidate_pairs": scored.count(), "classifier": {"loaded": model.loaded, "threshold": model.threshold}}
    report.write_rows(out + ".rows", first, near)
    if totals["total_groups"] <= one_file:
        errors = [{"path": r["path"], "message": r["message"]} for r in scanned.where("kind = 'error'").toLocalIterator()]
        report.write_report(out, first, near, info, errors, totals)
    views.register(spark, scan=scanned, images=images, scored=scored, clusters=grouped)
    members = groups.select("group_id", F.explode("members").alias("file_id"))
    top = [r.asDict() for r in report.largest(members, known).collect()]
    return {**metrics, **totals, "candidate_pairs": info["candidate_pairs"], "timings_ms": took, "largest": top}


def lines(totals: dict) -> list[str]:
    """The summary of a scan for the console."""
    mb = lambda n: f"{n / (1 << 20):.2f} MB"
    took = totals.get("timings_ms", {})
    out = [f"Entries visited: {totals['entries_visited']}", f"Images found: {totals['images_found']} ({mb(totals['total_bytes'])}; {totals['jpeg']} JPEG, {totals['png']} PNG, {totals['mismatches']} with another extension)"]
    out += [f"Skipped: {totals['skipped_non_image']}, errors: {totals['errors']}", f"Duplicate groups: {totals['total_groups']}"]
    if "exact_groups" in totals:
        out += [f"  exact {totals['exact_groups']}, near {totals['near_groups']}; {mb(totals['reclaimable_bytes'])} to reclaim", f"Candidate pairs: {totals['candidate_pairs']}, merges refused for weak edges: {totals['weak_merges_blocked']}"]
        out += [f"  group {g['group_id']}: {g['copies']} copies, {g['reclaimable']}" for g in totals["largest"]]
        out += [f"{k}: {v / 1000:.2f} s ({totals['images_found'] / max(v / 1000, 1e-9):.1f} images/s)" for k, v in took.items()]
    return out


def run_train(spark: SparkSession, features: str, out: str) -> dict:
    """Weights of a classifier from exported features, in one JSON file; the threshold is chosen on the split `val`."""
    schema = "label int, transform string, split string, base_a string, base_b string, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = spark.read.schema(schema).option("header", True).csv(features)
    held = rows.where("split = 'val'")
    model = training.train(rows.where("split = 'train'") if held.head(1) else rows)
    judged = (held if held.head(1) else rows).withColumn("probability", model.probability())
    best = training.best_threshold(judged).first()
    model = replace(model, threshold=float(best["threshold"]))
    with open(out, "w") as file:
        file.write(scoring.model_json(model))
    return {"rows": rows.count(), "threshold": model.threshold, "precision": best["precision"], "recall": best["recall"]}


def run_export(spark: SparkSession, manifest: str, out: str, limit: int = 0) -> dict:
    """Features of each labelled pair; every image is decoded once."""
    rows = files.read_manifest(spark, manifest, limit)
    wanted = files.manifest_images(rows).withColumn("path", _plain("path"))
    # The driver learns the folders, not the paths.
    folders = [r["folder"] for r in wanted.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().toLocalIterator()]
    images, bad = _images(spark, folders, wanted)
    ids = images.select("path", "id", *HASHES)
    side = lambda s: ids.select(F.col("path").alias(f"path_{s}"), F.struct("id", *HASHES).alias(s))
    met = rows.join(side("a"), "path_a").join(side("b"), "path_b")
    made = met.select(*[c for c in rows.columns if c[:5] != "path_"], F.col("a.id").alias("_a"), F.col("b.id").alias("_b"), *[c.alias(k) for k, c in matching.distances().items()])
    featured = written(scoring.pair_features(made.withColumnsRenamed({"_a": "a", "_b": "b"}), images), "features")
    files.write_csv(featured.select("label", "transform", "split", "base_a", "base_b", *FEATURES), out)
    return {"pairs": featured.count(), "failed_images": bad.count()}


def run_mine(spark: SparkSession, folder: str, out: str, radius: int = 16) -> dict:
    """All candidate pairs of a folder within one radius, without a cap."""
    images, bad = _images(spark, [folder])
    pairs = matching.candidates(images.select("id", *HASHES), {k: radius for k in matching.RADII})
    names = images.select("id", "path")
    named = pairs.join(names.withColumnsRenamed({"id": "a", "path": "path_a"}), "a").join(names.withColumnsRenamed({"id": "b", "path": "path_b"}), "b")
    files.write_csv(named.select("path_a", "path_b", "d_ahash", "d_dhash", "d_phash"), out)
    return {"images": images.count(), "failed_images": bad.count()}


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[0] not in ("scan", "export-features", "train", "mine-negatives") or argv[0] != "scan" and len(argv) < 3:
        print(USAGE, file=sys.stderr)
        return 1
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if argv[0] == "scan":
        rows_only = "--rows" in argv
        print("\n".join(lines(run_scan(spark, [a for a in argv[1:] if a != "--rows"], scoring.Classifier.shipped(), one_file=-1 if rows_only else ONE_FILE))))
    elif argv[0] == "train":
        print(run_train(spark, argv[1], argv[2]))
    elif argv[0] == "export-features":
        print(run_export(spark, argv[1], argv[2], int(argv[3]) if len(argv) > 3 else 0))
    else:
        print(run_mine(spark, argv[1], argv[2], int(argv[3]) if len(argv) > 3 else 16))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
