"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echofold.llm import chat_format, language_id, packing, piece_codec, quartile_digest, shingle_join, suffix_dedup, toxicity, vantage_search, warc
from echofold.llm._common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kind string, digest string, score string, label string"


def documents(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "b", "k", "d", "s", "l") for i, t, lang in rows], SCHEMA)


LONG = " ".join(f"word{k % 977}" for k in range(20_000))
ODD = [(0, None, "en"), (1, "", "en"), (2, "one", None), (3, LONG, "en"), (4, LONG, "de"), (4, LONG, "de"), (None, "a text without id", "en"), (5, "é 中 😀 ▁ \t\n", None), (6, "123 --- 456", "en"), (7, " ".join(f"w{k}" for k in range(30)), "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


# 1 SentencePiece


@pytest.fixture(scope="module")
def lib():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_codec.MODEL))


@pytest.fixture(scope="module")
def own():
    import public_tokenizers

    return piece_codec.Codec(public_tokenizers.path(piece_codec.MODEL))


def odd_texts():
    r = random.Random(3)
    signs = "ab thé▁ \n\t😀中 \x00<s></s>​ﬁ①  Ａ"
    yield from ("".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(400))
    yield from ["a" * 500, " " * 300, "x" * 70 + " " * 20 + "▁▁", "<unk>", "<0x0A>", ""]
    yield from ("".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(200))


def test_ids_spans_and_texts_equal_the_librarys(lib, own):
    for x in odd_texts():
        ids, spans = own.encode_with_spans(x)
        assert ids == lib.encode(x) and own.decode(ids) == lib.decode(ids)
        assert spans.tolist() == [[p.begin, p.end] for p in lib.encode(x, out_type="proto").pieces]


def test_any_ids_decode_like_the_library(lib, own):
    r = random.Random(1)
    for _ in range(300):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randint(0, 10))]
        assert own.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_compiled_character_maps(rule):
    import sentencepiece

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False)
    mine = piece_codec.Normalizer.of(theirs.serialized_model_proto())
    for x in odd_texts():
        made, at = mine(x)
        assert made == theirs.normalize(x)
        assert len(at) == len(made) + 1 and (np.diff(at) >= 0).all() and at[-1] <= len(x.encode())


def test_digests_of_odd_rows(spark, odd, lib):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_codec.digests(odd).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i or -1, len(ids := lib.encode(t or "")), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t, _ in ODD]
    assert got == sorted(want)
    assert piece_codec.digests(odd.limit(0)).count() == 0
    assert sum(len(r["ids"]) for r in piece_codec.encode_documents(odd).collect()) == sum(w[1] for w in want)


# 2 Nearest neighbours


def test_exact_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vantage_search, "LEAF", 16)
    r = np.random.RandomState(2)
    x = r.randn(400, 8).astype(np.float32)
    x[50:200] = x[50]  # one vector a third of the time
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, shard string, n int")
    got = {}
    for row in vantage_search.search(df, df.where("vec_id % 20 = 0"), 20, 1.0).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    for q in range(0, 400, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        best = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert [(a, b) for a, b, _ in sorted(got[q])] == [(k + 1, i) for k, i in enumerate(best)]


@pytest.mark.parametrize("kind", ["orthogonal", "one-hot", "grid"])
def test_ties_go_to_the_smaller_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(vantage_search, "LEAF", 16)
    monkeypatch.setattr(vantage_search, "FEW_ROWS", 100)
    r = np.random.RandomState(8)
    if kind == "orthogonal":  # 400 different vectors, none with anything in common with the query
        x = np.concatenate([np.eye(1, 8), np.concatenate([np.zeros((400, 1)), r.randn(400, 7)], 1)])
    elif kind == "one-hot":
        x = np.eye(60)
    else:
        x = r.randint(-1, 2, (500, 4)).astype(float)
        x[:, 0] = 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in vantage_search.search(df, df.where("vec_id % 20 = 0"), 20, 1.0).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"]))
    for q in range(0, len(x), 20):
        s = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        assert sorted(got[q]) == [(k + 1, i) for k, i in enumerate(best)]


def test_smaller_factors_look_at_less():
    r = np.random.RandomState(4)
    x = r.randn(40, 8)[r.randint(0, 40, 6000)] + 0.2 * r.randn(6000, 8)  # in clusters
    top = float(np.linalg.norm(x, axis=1).max())
    want = [set(row) for row in np.argsort(-(x[:100] @ x.T), axis=1)[:, :20].tolist()]
    looked = []
    for factor in (1.0, 0.6):
        tree = vantage_search.Tree(x, top)
        who, rows = tree.search(x[:100], 20, factor)
        found = [set(rows[who == i].tolist()) for i in range(100)]
        share = np.mean([len(a & b) / 20 for a, b in zip(want, found)])
        assert share == 1 if factor == 1 else share > 0.9
        looked.append(tree.visited)
    assert looked[1] < looked[0] < 100 * len(x)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [math.nan, 1.0]), (6, [0.0, 0.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (8, [2.0, 2.0]), (3, [1.0, 0.0]), (40, [1.0]), (9, [math.inf, 0.0]), (60, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in vantage_search.search(df, df.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8), (0, 2, 3), (0, 3, 20), (20, 1, 8), (20, 2, 0), (20, 3, 3)]
    assert vantage_search.search(df.limit(0), df.limit(0)).count() == 0


# 3 Suffix-array dedup


def brute_removals(rows):
    seen, out = {}, {}
    for d, raw in sorted(rows):
        n = len(raw)
        hit = np.zeros(n, bool)
        for p in range(n - 49):
            if seen.setdefault(raw[p : p + 50], d) < d:
                hit[p : p + 50] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[d] = (n, int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~hit])).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"MANY": 2, "BLOCK": 200, "FLUSH": 500, "PASSAGES": 100}, {"FLUSH": 1}])
def test_removals_equal_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    r = random.Random(4)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(30, 200))) for _ in range(30)]
    rows = []
    for i in range(200):
        t = "".join(r.choice(parts)[r.randint(0, 20) :] for _ in range(r.randint(0, 6)))
        rows.append((3 * i + 1, "a" * r.randint(0, 300) + "é" * r.randint(0, 60) if i % 9 == 0 else t, "en"))
    rows += [(1000 + i, parts[0] + str(i), "en") for i in range(100)]  # one passage in a third of all rows
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.removals(documents(spark, rows)).collect()}
    assert got == brute_removals([(i, t.encode()) for i, t, _ in rows])


def test_a_common_phrase_gathers_little(spark):
    r = random.Random(8)
    phrase = "".join(r.choice("abcdefgh") for _ in range(30))
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = [word(90) for _ in range(5)]
    rows = [(i, word(40) + phrase + word(40) + (phrase + r.choice(shared) + phrase if i % 3 == 0 else ""), "en") for i in range(200)]
    docs = documents(spark, rows)
    hot = suffix_dedup.hot_grams(docs)
    of_phrase = suffix_dedup.grams(np.frombuffer(phrase.encode(), np.uint8))[0]
    inside = []
    for table in (None, hot):
        anchors = []
        for _, text, _ in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            _, more, gram, _ = suffix_dedup.stretches(raw, np.array([len(raw)]), table)
            anchors.append(np.isin(gram, of_phrase).sum())
            assert int((more + 1).sum()) == len(raw) - suffix_dedup.LENGTH + 1
        inside.append(int(sum(anchors)))
    # With hashes above a quarter of all, which are not counted, a gram of the phrase is rarely an anchor.
    assert inside[1] * 5 < inside[0]
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.removals(docs).collect()}
    assert got == brute_removals([(i, t.encode()) for i, t, _ in rows])
    assert suffix_dedup.hot_grams(docs.limit(0)) is None


def test_covered_strings_equal_brute_force():
    r = random.Random(12)
    raw = bytes(r.choice(b"a\0") for _ in range(70)) * 4 + bytes(r.choice(b"a\0b") for _ in range(600))
    at = np.array([r.randrange(len(raw) - suffix_dedup.WIDTH) for _ in range(300)] + list(range(200)))
    sizes = np.array([r.randint(suffix_dedup.LENGTH, suffix_dedup.WIDTH) for _ in at])
    who = np.array([r.randrange(9) for _ in at])
    words = [raw[a : a + n] for a, n in zip(at, sizes)]
    want = [any(who[j] < who[i] and words[j].startswith(words[i]) for j in range(len(at))) for i in range(len(at))]
    assert suffix_dedup.covered(np.frombuffer(raw, np.uint8), at, sizes, who).tolist() == want and 0 < sum(want) < len(at)


def test_equal_hashes_of_different_strings_remove_nothing():
    texts = [b"a" * 30 + b"x" + b"a" * 30, b"a" * 30 + b"y" + b"a" * 30]
    with pytest.raises(RuntimeError):
        suffix_dedup._copied([(2, 0, 1, 0, np.array([11], np.uint8), texts[1])], {1: [texts[0]]}, 4)
    rows = suffix_dedup._copied([(2, 0, 1, 0, np.array([11], np.uint8), texts[0])], {1: texts}, 4)
    assert [tuple(x.tolist() for x in suffix_dedup.unpack(r[2], "<i8", "<u4", "<u4")) for r in rows] == [([2], [0], [61])]


def test_removals_of_odd_rows(spark, odd):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.removals(odd).collect())
    n = len(LONG.encode())
    want = {i: (len((t or "").encode()), 0) for i, t, _ in ODD if i is not None}
    assert [g[1] for g in got if g[0] == 4] == [n, n] and all(g[2] == n for g in got if g[0] == 4) and dict((g[0], g[2]) for g in got)[3] == 0
    assert all(g[1] == want[g[0]][0] for g in got if g[0] != 99) and len(got) == len(ODD)
    assert suffix_dedup.removals(odd.limit(0)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in suffix_dedup.stage(spark, odd, "").collect()}
    assert texts[3] == LONG and texts[4] == "" and texts[2] == "one"


def test_longest_previous_factors_equal_brute_force():
    r = random.Random(9)
    raw = np.array([r.choice(b"ab") for _ in range(300)], np.uint8)
    w = np.lib.stride_tricks.sliding_window_view(raw, 12)
    rank = np.array([r.randrange(6) for _ in range(len(w))])
    order, common = suffix_dedup.suffix_order(w)
    found = np.zeros(len(w), int)
    found[order] = suffix_dedup.longest_previous(rank[order], common)
    for i in range(len(w)):
        shared = [next((k for k in range(12) if w[i][k] != w[j][k]), 12) for j in range(len(w)) if rank[j] < rank[i]]
        assert found[i] == max(shared, default=0)


# 4 Toxicity


def test_gradients_equal_differences():
    net = toxicity.Network()
    r = np.random.RandomState(0)
    x, mask = r.randn(toxicity.WINDOW, 4, toxicity.INPUTS), np.ones((toxicity.WINDOW, 4, 1))
    mask[20:, 1] = 0
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    _, g, d_x = net.gradients(x, mask, y, w)
    for k, p in [*((k, p) for k, p in net.p.items() if k in g), ("x", x)]:
        wanted = d_x if k == "x" else g[k]
        flat, at = p.reshape(-1), p.size // 2
        flat[at] += 1e-3
        up = net.gradients(x, mask, y, w)[0]
        flat[at] -= 2e-3
        down = net.gradients(x, mask, y, w)[0]
        flat[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(wanted.reshape(-1)[at], rel=1e-2, abs=1e-6)


@pytest.fixture(scope="module")
def scorer():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        t = [r.choice(words) for _ in range(r.randint(20, 200))]
        if i % 3 == 0:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["zorg", "zorgen", "quxx"]))
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    return toxicity.fit(texts[:450], labels[:450], epochs=4), texts[450:], np.array(labels[450:])


def test_held_out_accuracy(scorer):
    own, texts, labels = scorer
    assert ((own.score(texts) >= 0.5) == labels).mean() > 0.95


def plain_score(own, text):
    """One window at a time, one word at a time, one number at a time."""
    p, h = own.network.p, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    w = toxicity.split(text.encode())
    x = []
    for k in range(len(w.word)):
        a, b = int(w.cuts[2 * k]), int(w.cuts[2 * k + 1])
        four, five = [own.odds.gram4[g] for g in w.gram4[a:b]], [own.odds.gram5[g] for g in w.gram5[a:b]]
        chars = np.mean([p["chars"][g >> toxicity.FEWER] for g in w.gram4[a:b]], axis=0)
        x.append([own.odds.word[w.word[k]], max(four), max(five), sum(four) / (b - a), min(24, b - a) / 24, 1, *p["words"][w.word[k] >> toxicity.FEWER], *chars])
    best = -math.inf
    for start in range(0, max(1, len(x) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        own_words = x[start : start + toxicity.WINDOW]
        both = [[None] * (2 * h) for _ in own_words]
        for d in (0, 1):
            state = [0.0] * h
            for t in range(len(own_words)) if d == 0 else range(len(own_words) - 1, -1, -1):
                given = [sum(own_words[t][i] * p["W"][d, i, j] for i in range(toxicity.INPUTS)) + p["c"][d, 0, j] for j in range(3 * h)]
                kept = [sum(state[i] * p["U"][d, i, j] for i in range(h)) for j in range(3 * h)]
                z = [sigmoid(given[j] + kept[j]) for j in range(h)]
                r = [sigmoid(given[h + j] + kept[h + j]) for j in range(h)]
                new = [math.tanh(given[2 * h + j] + r[j] * kept[2 * h + j]) for j in range(h)]
                state = [new[j] + z[j] * (state[j] - new[j]) for j in range(h)]
                both[t][d * h : d * h + h] = state
        weight = [math.exp(sum(a * b for a, b in zip(s, p["att"]))) for s in both]
        pooled = [sum(e * s[j] for e, s in zip(weight, both)) / sum(weight) for j in range(2 * h)]
        best = max(best, sum(a * b for a, b in zip(pooled, p["out"])) + p["bias"][0])
    return sigmoid(best)


def test_scores_equal_a_plain_forward_pass(scorer):
    own, texts, _ = scorer
    for text in [texts[0], texts[1] + " zorg " + texts[2], "Quxx", " ".join(texts[3].split()[:40])]:
        assert own.score([text])[0] == pytest.approx(plain_score(own, text), abs=1e-4)


def test_odds_equal_a_plain_count():
    texts, labels = ["aa bb", "aa aa", "cc bb", "bb cc dd"], np.array([1, 1, 0, 0])
    odds = toxicity.Odds.fit((toxicity.split(t.encode()) for t in texts), labels)
    for word, toxic, other in (("aa", 2, 0), ("bb", 1, 2), ("dd", 0, 1)):
        n = toxic + other
        want = (math.log(toxic / 2 + 1) - math.log(other / 2 + 1)) * n / (n + 3)
        assert odds.word[toxicity.split(word.encode()).word[0]] == pytest.approx(min(5, max(-3, want)) / 2, rel=1e-5)


def test_stage_of_odd_rows(spark, odd, monkeypatch, scorer):
    labels = spark.createDataFrame([(7, 0)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "table", lambda *_: labels)
    assert toxicity.stage(spark, odd, "").count() == len(ODD)  # nothing was learned
    monkeypatch.setattr(toxicity, "fit", lambda *_: scorer[0])
    bad = documents(spark, [*ODD, (50, (scorer[1][0] + " zorg quxx zorgen ") * 3, "en"), (50, (scorer[1][0] + " zorg quxx zorgen ") * 3, "en")])
    kept = toxicity.stage(spark, bad, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and toxicity.stage(spark, odd.limit(0), "").count() == 0
    scores = {(r["doc_id"], r["score"] < 0.5) for r in toxicity.score_documents(bad, scorer[0]).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, ok in scores if ok} and (50, False) in scores


def test_windows_cover_whole_texts(scorer):
    own, texts, labels = scorer
    clean = texts[int(np.flatnonzero(labels == 0)[0])]
    late = (clean + " ") * 40 + "zorg quxx zorgen " + clean
    assert own.score([clean])[0] < 0.5 < own.score([late])[0]
    assert own.score([late + " " + " ".join(texts)])[0] >= own.score([late])[0] - 0.2
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        covered = {k for a in toxicity.windows(n) for k in range(a, min(n, a + toxicity.WINDOW))}
        assert covered == set(range(n))


def test_scores_of_odd_rows(spark, odd, scorer):
    rows = toxicity.score_documents(odd, scorer[0]).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in ODD if i is not None}
    nothing = toxicity.fit([], [])
    assert {r["score"] for r in toxicity.score_documents(odd, nothing).collect()} == {0.0}
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    texts, marks = toxicity.sample(odd, labels)
    assert len(texts) == len(marks) <= 3 and toxicity.score_documents(odd.limit(0), nothing).count() == 0


# 5 WARC


def test_records_come_back(spark):
    import base64

    rows = [(1, "u1", "same"), (9, "u9", "same"), (4, "u4", "same"), (2, "u2", None), (3, "u3", ""), (5, None, "other\r\n\r\nWARC/1.1\r\n"), (7, "u7\r\nX: y", "é"), (9, "u9", "same"), (None, "n", "same"), (8, "u8", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = shared_dir(spark, "warc-test")
    names = warc.deduplicate(pages, path)
    read = warc.read_archives(names, path)
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read.collect()), key=repr)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        first = (-1 if i is None else i) == top[h or ""]
        want.append((i is None, i or 0, len((h or "").encode()), digest(h), "response" if first else "revisit", None if first else top[h or ""]))
    assert got == sorted(want, key=repr)
    whole = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]) for r in warc.restore(read).collect()}
    assert all(whole[(i, digest(h))] == (h or "").encode() for i, _, h in rows)
    assert warc.read_archives(warc.deduplicate(pages.limit(0), path + "-none"), path + "-none").count() == 0
    least = warc.plan_records(pages, least=5).where("refers_to IS NOT NULL")
    assert least.count() == 0


# 6 Chat formatting


TRICKY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> <<SYS>> <<\\SYS>>", "<", "[", "<|role:x|> <|/role|>", "", "a<", "\\", "<s", "[/INST", "<<s>>", "😀</s>"]


def test_formatting_is_reversible(spark):
    rows = [(c, k, r, t) for c, (r, t) in enumerate((r, t) for r in ("user", "assistant", "system", "to|ol>%", None, "") for t in TRICKY) for k in range(2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(chat_format.records_of(df.drop("formatted"))).select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for row in out.collect():
        mine = [r for r in rows if r[0] == row["conv_id"]]
        assert [(t["role"], t["text"]) for t in row["t"]] == [(r[2], r[3]) for r in mine]
        assert row["loss"] == "".join(r[3] for r in mine if r[2] == "assistant")
        for role, (a, b) in chat_format.MARKS.items():
            n = sum(r[2] == role for r in mine)
            assert row["formatted"].count(a) == n and row["formatted"].count(b) == n


def test_layouts_select_mappings(spark):
    fields = [f.name for f in chat_format.RECORD]
    cases = [
        ({"messages": [("user", "q"), ("assistant", None)]}, [("user", "q"), ("assistant", None)]),
        ({"conversations": [("human", "q"), ("gpt", "a"), ("tool", "t")]}, [("user", "q"), ("assistant", "a"), ("tool", "t")]),
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"input": "alone"}, None),
        ({}, None),
    ]
    df = spark.createDataFrame([(k, tuple(c.get(f) for f in fields)) for k, (c, _) in enumerate(cases)], "id long, record " + chat_format.RECORD.simpleString())
    got = {r["id"]: r for r in chat_format.canonical_turns(df).collect()}
    for k, (_, want) in enumerate(cases):
        turns = got[k]["turns"]
        assert (None if turns is None else [(t["role"], t["text"]) for t in turns]) == want
    assert len({r["layout"] for r in got.values()}) == len(cases)
    assert {r["formatted"] for r in chat_format.format_chats(df.where("id >= 6")).collect()} == {""}


def test_ties_nulls_and_no_python_in_chats(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, "user", "first"), (None, 1, None, "x")], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chat_format.records_of(df))
    assert {r["conv_id"]: [t["text"] for t in r["t"]] for r in out.select("conv_id", chat_format.parse(F.col("formatted")).alias("t")).collect()} == {1: ["first", "", ""], None: ["x"]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and chat_format.format_chats(chat_format.records_of(df.limit(0))).count() == 0


# 7 Packing


def test_plan_fills_sequences():
    r = random.Random(1)
    counts = {n: r.randint(1, 50) for n in range(1, 2049) if r.random() < 0.6} | {2048: 100, 700: 3000, 1: 5000}
    slots, total = packing.plan(counts)
    room = {}
    for n, many in counts.items():
        own = [s[1:] for s in slots if s[0] == n]
        firsts = np.array([s[0] for s in own])
        for rank in range(many):
            first, number, each, offset = own[np.searchsorted(firsts, rank, "right") - 1]
            room.setdefault(number + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
    for own in room.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(room) == total <= 1.05 * sum(n * c for n, c in counts.items()) / 2048 + 1
    assert packing.plan({}) == ([], 0)


def test_the_rank_file_gives_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}b  {chr(c)}." for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    texts += ["x <|endoftext|> y<|endoftext|>", "", " ", "it's 'S we'LL\n\n\n  z"]
    for t, e in zip(texts, exact.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == fast(t).tolist()


def test_packed_pieces_of_odd_rows(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(odd).collect()
    want = []
    for i, t, _ in ODD:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, want))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) and sum(n for _, n in v) <= 2048 for v in by.values())
    assert packing.pack(odd.limit(0)).count() == 0


# 8 Language ID


def brute_lengths(samples, order, text):
    out = []
    for name in sorted(samples):
        counts = [{} for _ in range(order + 1)]
        for s in samples[name]:
            x = b"\0" * order + s
            for i in range(order, len(x)):
                for k in range(order + 1):
                    own = counts[k].setdefault(x[i - k : i], {})
                    own[x[i]] = own.get(x[i], 0) + 1
        x, bits = b"\0" * order + text, 0.0
        for i in range(order, len(x)):
            for k in range(order, -1, -1):
                c = counts[k].get(x[i - k : i])
                if c is None:
                    continue
                total, distinct = sum(c.values()), len(c)
                if x[i] in c:
                    bits -= math.log2(c[x[i]] / (total + distinct))
                    break
                bits -= math.log2(distinct / (total + distinct))
            else:
                bits += 8
        out.append(bits)
    return out


SAMPLES = {"en": [b"the cat and the dog of the house", b"with and of this"], "de": ["der hund und die katze für das haus".encode(), b"mit und von"]}


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_code_lengths_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    trees = language_id.ContextTrees(SAMPLES)
    texts = [b"the hund of the katze", b"", b"x", "für\0日本".encode(), b"und und und the the the"]
    assert np.allclose(trees.code_lengths(texts), [brute_lengths(SAMPLES, 4, t) for t in texts], rtol=1e-5, atol=1e-3)


def test_languages_of_odd_rows(spark, odd):
    rows = {r["doc_id"]: r for r in language_id.identify(odd, language_id.ContextTrees(SAMPLES)).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 6)] == ["und"] * 3 and rows[2]["lang_pred"] in SAMPLES and 0 < rows[3]["score"] <= 1
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.ContextTrees({})).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), language_id.ContextTrees(SAMPLES)).count() == 0
    learned = language_id.sample(odd)
    held = {i for i, t, x in ODD if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(map(len, learned.values())) == sum(1 for i, t, x in ODD if i is not None and i not in held and t is not None and x)
    kept = language_id.stage(spark, odd, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


# 9 Quartile digests


def test_digest_round_trip_and_likeness():
    r = random.Random(2)
    raw = bytes(r.randrange(97, 123) for _ in range(3000))
    d = quartile_digest.digest(raw)
    assert (quartile_digest.from_text(quartile_digest.as_text(d)) == d).all() and quartile_digest.likeness(d, d) == 1
    near, far = quartile_digest.digest(raw[:2900] + b"x" * 100), quartile_digest.digest(bytes(r.randrange(65, 91) for _ in range(900)))
    assert quartile_digest.likeness(d, near) > quartile_digest.likeness(d, far)
    count = np.zeros(128, int)
    for i in range(len(raw) - 4):
        w = raw[i : i + 5]
        for (a, b, c), salt in quartile_digest._PLACES:
            t = quartile_digest._TABLES
            count[t[0][w[a]] ^ t[1][w[b]] ^ t[2][w[c]] ^ salt] += 1
    assert (quartile_digest.bucket_counts(raw) == count).all()
    assert quartile_digest.difference(d, far) <= quartile_digest.BOUND


def test_short_texts_are_like_equal_ones_only():
    made = [quartile_digest.digest(x) for x in (b"", b"a", b"ab", b"xyz", b"abcd", b"abcde", b"vwxyz", b"abcdefg", b"abcdefgh", b"12345678", b"a whole sentence of words")]
    for i, a in enumerate(made):
        assert (quartile_digest.from_text(quartile_digest.as_text(a)) == a).all()
        assert [quartile_digest.likeness(a, b) == 1 for b in made] == [i == k for k in range(len(made))]
        assert all(quartile_digest.likeness(a, b) < 0.5 for k, b in enumerate(made) if k != i)


def test_comparison_with_the_next_row(spark, odd):
    got = sorted(tuple(r) for r in quartile_digest.compare_with_next(odd).where("doc_id IS NOT NULL").collect())
    order = sorted(((i, t or "") for i, t, _ in ODD), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        u = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = (quartile_digest.digest(x.encode()) for x in (t, e, u))
        if i is not None:
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), quartile_digest.as_text(a), quartile_digest.as_text(b), quartile_digest.likeness(a, b), quartile_digest.likeness(a, c)))
    assert got == sorted(want)
    assert quartile_digest.compare_with_next(odd).count() == len(ODD) and quartile_digest.compare_with_next(odd.limit(0)).count() == 0
    assert quartile_digest.compare_with_next(odd.where("doc_id = 2")).first()["near_next"] == 1 and quartile_digest.fingerprints(odd).count() == len(ODD)


def test_sql_of_digests_over_odd_texts():
    texts = ["", "a", "ab", "ééé", "abcdefg", "abcdefgh", "x" * 500, "日本語のテキスト" * 40, None, "ab" * 5000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    docs = [(i, t or "") for i, t in enumerate(texts)][::-1]
    prints = {t: quartile_digest.digest(t.encode()) for _, t in docs}
    want = {i: quartile_digest._compare(i, t, prints[t], u, prints[u]) for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1])}
    assert {r[0]: r for r in con.execute(quartile_digest.ORACLE).fetchall()} == want


# 10 Jaccard join


def brute_components(rows):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("limits", [{}, {"GROUP_SETS": 5, "FREQUENT": 3, "FLUSH": 2000}, {"GROUP_HASHES": 50, "BLOCKS": 2}])
def test_components_equal_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(shingle_join, k, v)
    r = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for f in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 9, 40, 120]))]
        for _ in range(12):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t).upper() if r.random() < 0.3 else "\t".join(t)))
    shared = " ".join(r.choice(words) for _ in range(60))
    rows += [(len(rows) + k, shared + " " + " ".join(r.choice(words) for _ in range(r.choice([5, 10, 60])))) for k in range(70)]
    rows += [(900, ""), (901, None), (902, "  \n"), (903, "É é"), (904, "é é"), (905, "one two"), (906, "ONE two")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in shingle_join.components(documents(spark, [(i, t, "en") for i, t in rows])).collect()}
    assert got == brute_components(rows)


def test_join_group_equals_brute_force_on_random_sets():
    r = random.Random(3)
    for _ in range(30):
        sets = []
        for _ in range(r.randint(2, 30)):
            base = set(r.choice(sets)) if sets and r.random() < 0.7 else set()
            sets.append({x for x in base if r.random() < 0.95} | {r.randrange(60) for _ in range(r.randint(1, 6))})
        extra = [r.choice([0, 0, 1]) for _ in sets]  # hashes that no other set holds
        sizes = [len(s) + e for s, e in zip(sets, extra)]
        got = shingle_join.join_group([np.array(sorted(s), np.uint64) for s in sets], sizes)
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                    a, b = root[i], root[j]
                    root = [min(a, b) if x in (a, b) else x for x in root]
        assert got == root


def test_components_of_odd_rows(spark, odd):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_join.components(odd).collect()]
    assert len(got) == len(ODD) and {c for i, _, c in got if i in (3, 4)} == {3}
    assert {i: n for i, n, _ in got if i in (0, 1, 2)} == {0: 0, 1: 0, 2: 1} and shingle_join.components(odd.limit(0)).count() == 0
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in shingle_join.stage(spark, odd, "").collect()) == [-1, 0, 1, 2, 3, 5, 6, 7]


def test_language_holds_little_beside_the_texts():
    import tracemalloc

    trees = language_id.ContextTrees({"x": [b"abcd efgh " * 50], "y": [b"zyxw vuts " * 50]})
    texts = ["abcd zyxw " * 2000] * 100
    trees.predict(texts[:1])
    tracemalloc.start()
    found = trees.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [trees.predict(texts[:1])[0]] * 100 and peak < 32 << 20


def test_a_lean_task_hands_on_every_batch():
    from echofold.llm._common import lean

    batches = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    assert list(lean(lambda found: (b for b in found))(iter(batches))) == batches
