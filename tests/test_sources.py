"""Scans, decoding, the command line and incremental matching, on generated images."""

import json

import numpy as np
import pytest
from helpers import jpeg, png
from pyspark.sql import functions as F

from echofold import __main__ as cli
from echofold.functions.signatures import HASHES
from echofold.operators import scoring
from echofold.sources import decode, files
from echofold.streaming import incremental


def ramp(w, h, step):
    return [[(min(255, int(x * step)),) * 3 for x in range(w)] for _ in range(h)]


def textured(seed, n=64):
    return [[((x * 7 * seed + y * 3) % 256, (x * y * seed) % 256, (y * 11 + seed * 40) % 256) for x in range(n)] for y in range(n)]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    (top / "sub").mkdir()
    (top / "real.jpg").write_bytes(b"\xff\xd8\xff\xe0junk")
    (top / "sub/real.png").write_bytes(b"\x89PNG\r\n\x1a\nx")
    (top / "notes.txt").write_text("hello")
    (top / "fake.jpg").write_text("not jpg")
    (top / "sneaky.dat").write_bytes(b"\xff\xd8\xff\xe0data")
    return top


def test_scan(spark, tree):
    got = files.scan_metrics(files.scan(spark, [str(tree)])).first()
    assert (got["images_found"], got["jpeg"], got["png"], got["mismatches"], got["skipped_non_image"], got["errors"], got["entries_visited"]) == (3, 2, 1, 1, 2, 0, 6)


def test_scan_of_a_missing_root_is_one_error(spark, tree):
    rows = files.scan(spark, [str(tree / "none")]).collect()
    assert [(r["kind"], r["message"]) for r in rows] == [("error", "not a readable directory")]
    assert files.scan(spark, []).count() == 0


def test_fast_scan_and_formats(spark, tree):
    found = files.read_binary(spark, [str(tree)], 8).select("path", files.format_of(F.col("content")).alias("f")).collect()
    assert sorted(r["f"] or "" for r in found) == ["jpeg", "jpeg", "png"]
    assert files.detect_image_format(str(tree / "sneaky.dat")) == "jpeg"
    with pytest.raises(ValueError, match="not a JPEG or PNG"):
        files.detect_image_format(str(tree / "notes.txt"))


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pictures")
    (top / "tiny.png").write_bytes(png(ramp(16, 16, 17)))
    (top / "tiny.jpg").write_bytes(jpeg(spark, ramp(16, 16, 17)))
    (top / "big.jpg").write_bytes(jpeg(spark, ramp(800, 600, 255 / 799)))
    (top / "bad.jpg").write_bytes(b"\xff\xd8\xffthis is definitely not jpeg data")
    for k in (1, 2, 3):
        (top / f"t{k}.png").write_bytes(png(textured(k)))
    (top / "t1_exact_dup.png").write_bytes(png(textured(1)))
    (top / "t1_whatsapp.jpg").write_bytes(jpeg(spark, textured(1)))
    return top


def test_decode(spark, pictures):
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in decode.decode(spark, str(pictures)).collect()}
    assert rows["bad.jpg"]["error"] and not rows["tiny.png"]["error"]
    assert (rows["big.jpg"]["width"], rows["big.jpg"]["height"]) == (800, 600)
    apart = lambda a, b, h: bin((rows[a][h] ^ rows[b][h]) % 2**64).count("1")
    assert apart("tiny.jpg", "tiny.png", "dhash") <= 4 and apart("big.jpg", "tiny.png", "dhash") <= 8
    assert apart("t1.png", "t1_whatsapp.jpg", "phash") <= 10
    assert sum(rows["big.jpg"]["histogram"]) == pytest.approx(1, abs=1e-4) and rows["big.jpg"]["contrast"] > 20


def test_format_is_told_by_content(spark, tmp_path):
    import numpy as np

    rows = textured(2, 40)
    for name in ("a.png", "b.dat", "c.jpg"):
        (tmp_path / name).write_bytes(png(rows))
    (tmp_path / "d.png").write_bytes(jpeg(spark, rows))
    got = {r["path"][-5:]: r for r in decode.decode(spark, str(tmp_path)).collect()}
    assert [got[k]["format"] for k in ("a.png", "b.dat", "c.jpg", "d.png")] == ["png", "png", "png", "jpeg"]
    assert len({tuple(got[k][h] for h in HASHES) for k in ("a.png", "b.dat", "c.jpg")}) == 1
    gray = np.rint(np.array(rows) @ np.array(decode.GRAY["png"])).astype(np.uint8)
    small = decode.resize(gray, 8, 8)  # once, without a first halving
    assert got["a.png"]["ahash"] == decode.ahash_of(small)


def test_shrink_keeps_the_ramp():
    import numpy as np

    gray = np.array(ramp(800, 600, 255 / 799), np.uint8)[:, :, 0]
    small = decode.shrink(gray, 8, 8)
    assert small[0, 0] < 40 and small[0, 7] > 215 and small.shape == (8, 8)
    assert (decode.resize(np.array([[1, 2], [3, 5]], np.uint8), 1, 1) == 2).all()


def test_command_line(spark, pictures, tmp_path, capsys):
    assert cli.main([]) == 1 and cli.main(["export-features", "x"]) == 1
    out = cli.run_scan(spark, [str(pictures)], scoring.Classifier.shipped(), str(tmp_path / "report.json"), str(tmp_path / "judged"))
    got = json.loads((tmp_path / "report.json").read_text())
    assert out["images_found"] == 9 and got["scan_info"]["images_found"] == 9
    exact = [g for g in got["groups"] if g["type"] == "exact"]
    assert len(exact) == 1 and len(exact[0]["members"]) == 2
    assert any(g["type"] == "near" and sum(m["keep"] for m in g["members"]) == 1 for g in got["groups"])
    mined = cli.run_mine(spark, str(pictures), str(tmp_path / "mined"))
    assert mined["failed_images"] == 1 and spark.read.option("header", True).csv(str(tmp_path / "mined")).count() > 0
    text = "\n".join(cli.lines(out))
    assert "Images found: 9" in text and "1 copies" not in text and " MB to reclaim" in text and "images/s" in text
    groups = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "report.json.rows")).collect()]
    assert len(groups) == len(got["groups"]) == out["total_groups"]
    assert spark.sql("SELECT count(*) AS n FROM images WHERE hamming(dhash, dhash) = 0").first()["n"] == 8
    manifest = tmp_path / "pairs.csv"
    lines = ["path_a,path_b,label,transform,split,base_a,base_b", f"{pictures}/t1.png,{pictures}/t1_whatsapp.jpg,1,whatsapp,train,t1,t1", f"{pictures}/t1.png,{pictures}/t2.png,0,none,train,t1,t2", "short,line", f"{pictures}/t1.png,{pictures}/bad.jpg,0,none,train,t1,bad"]
    manifest.write_text("\r\n".join(lines) + "\r\n")
    assert cli.run_export(spark, str(manifest), str(tmp_path / "features"))["pairs"] == 2
    made = cli.run_train(spark, str(tmp_path / "features"), str(tmp_path / "weights.json"))
    model = scoring.load_model(str(tmp_path / "weights.json"))
    assert made["rows"] == 2 and model.loaded and model.threshold == pytest.approx(made["threshold"])


def test_incremental_matching_equals_one_go(spark, tmp_path):
    from echofold.operators import matching

    schema = "id long, " + ", ".join(f"{h} long" for h in HASHES)
    import random

    r = random.Random(8)
    near = [(i, *[(5 << 40) ^ (1 << r.randrange(60)) for _ in HASHES]) for i in range(12)]
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(near[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        incremental.start(spark, stream, str(tmp_path / "store"), str(tmp_path / "pairs"), str(tmp_path / "check")).awaitTermination()
    got = {(x["a"], x["b"]) for x in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    want = {(x["a"], x["b"]) for x in matching.candidates(spark.createDataFrame(near, schema)).collect()}
    assert got == want and len(want) > 0


def test_gray_that_lies_between_two_levels_is_rounded_to_even():
    # Each of these is a half in the arithmetic of the weights; a matrix product may add in another order.
    from echofold.sources.decode import gray_of

    rgb = np.array([[[0, 178, 252], [2, 71, 198], [3, 45, 231]]], np.uint8)
    plain = [round(0.2126 * r + 0.7152 * g + 0.0722 * b) for r, g, b in rgb[0].tolist()]
    assert gray_of(rgb, "png").tolist() == [plain] == [[146, 66, 50]]
