"""Quality, toxicity, line rules, line dedup and the secret scan on small and awkward tables."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointpanel.llm import line_dedup, line_rules, quality_gam, secret_scan, toxicity_kn
from tests.llm.helpers import awkward, docs, prose


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def training(spark, n=240):
    """Good prose and shouted or repeated junk; a few words are toxic in some of both."""
    rows, labels = [], []
    for k in range(n):
        good, toxic = k % 3 != 0, k % 7 == 0
        text = prose(80 + k % 50, k, 300)
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split()) if k % 2 else ("Same " * 90)
        if toxic:
            text += " vilest wretch, foulmouth"
        rows.append((k, text))
        labels.append((k, int(good), int(toxic)))
    return docs(spark, rows), labelled(spark, labels)


def accuracy(frame, labels, name):
    joined = frame.where("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col(name)).cast("int").alias("ok"))
    return joined.agg(F.avg("ok")).first()[0]


def test_quality_held_out_accuracy_and_folds(spark):
    frame, labels = training(spark)
    got = quality_gam.classify(frame, labels)
    assert accuracy(got, labels, "quality") > 0.95
    assert {r["doc_id"] for r in got.where("held_out").collect()} == {k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1}
    # Held-out labels are not learned: turning them round changes no score.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1,
                                                 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda l: {r["doc_id"]: r["score"] for r in quality_gam.classify(frame, l).collect()}
    assert scores(labels) == scores(turned)


def test_quality_awkward_rows_and_labels(spark):
    _, labels = training(spark, 30)
    odd = labels.union(labelled(spark, [(1, 0, 0), (1, None, None), (None, 1, 1)]))
    got = quality_gam.classify(awkward(spark), odd).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got) and all(r["held_out"] for r in got if r["doc_id"] is None)
    none = quality_gam.classify(awkward(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_gam.classify(docs(spark, []), labels).count() == 0
    kept = quality_gam.keep_good(awkward(spark), labels.limit(0))
    assert kept.count() == 13 and kept.columns == awkward(spark).columns


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality_gam.FEATURES)))
    x[:, 0], x[:, 1] = rng.random(4000), rng.random(4000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97 and (1, 0) in model.pairs


def test_toxicity_held_out_accuracy_and_awkward_rows(spark):
    frame, labels = training(spark)
    got = toxicity_kn.classify(frame, labels)
    assert accuracy(got, labels, "toxic") > 0.9
    assert {r["doc_id"] for r in got.where("held_out").collect()} == {k for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0}
    odd = toxicity_kn.classify(awkward(spark), labels).collect()
    assert len(odd) == 13 and all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["words"] == 0 and r["ratio"] == 0 for r in odd if r["doc_id"] in (3, 4, 5))
    assert all(r["score"] < 0.5 for r in toxicity_kn.classify(awkward(spark), labels.limit(0)).collect())
    assert toxicity_kn.classify(docs(spark, []), labels).count() == 0


def test_toxicity_of_a_small_sample_keeps_the_rate_of_the_table(spark):
    # A third of all texts hold the word, one in five of those is toxic: none is more likely toxic than not.
    rows = [(k, prose(20, k, 30) + " darn".join(["", " w1", " w2", " w3", " w4"]) * (k % 3 == 0)) for k in range(1200)]
    labels = labelled(spark, [(k, 1, int(k % 15 == 0)) for k in range(1200)])
    got = {n: {r["doc_id"]: r for r in toxicity_kn.classify(docs(spark, rows), labels, n).collect()} for n in (6000, 60)}
    assert all(sum(r["predicted"] for r in rows.values()) < 24 for rows in got.values())
    assert sum(got[60][k]["predicted"] != got[6000][k]["predicted"] for k in range(1200)) < 24
    assert abs(np.mean([r["score"] for r in got[60].values()]) - 1 / 15) < 0.04


def test_toxicity_of_a_fixed_expression(spark):
    """A word that always follows the same one is as telling as the count of the pair."""
    import pyarrow as pa

    rows = [(k, prose(60, k, 200).lower() + (" wa0 numskull" if k % 2 else " wa0 neighbour")) for k in range(80)]
    frame = docs(spark, rows)
    model = toxicity_kn.learn(frame, frame.select("text", (F.col("doc_id") % 2).cast("int").alias("y")))
    words, bounds = toxicity_kn.plain_words(pa.array(["wa0 numskull", "wa0 neighbour", "wb1 numskull"]))
    ratios = model.ratios(words, toxicity_kn._before(words, bounds))
    assert ratios[1] > 1000 and ratios[3] < 0.001 and 0.1 < ratios[5] < 10


def brute_rules(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: dict = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_counts_match_brute_force(spark):
    frame = awkward(spark).select("doc_id", "text").union(docs(spark, [
        (20, "a b c d e f g h " * 5), (21, "one two three four five six seven eight nine " + prose(60, 8) + " one two three four five six seven eight"),
        (22, "x\n\nx\n x\nx"), (23, "#*$ %&|<> a"), (24, "a " * 7), (25, "a " * 8), (26, "a " * 9)]).select("doc_id", "text"))
    for r in line_rules.clean_lines(frame).collect():
        n, chars, symbols, dup, repeat = want = brute_rules(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)


def test_line_rules_remove_lines_then_reject(spark):
    body = prose(60, 11)
    frame = docs(spark, [
        (1, body + "\nHome | News | Sport | About\nAll rights reserved by nobody at all\nMenu"), (2, " ".join(w + "###" for w in body.split())),
        (3, body.upper()), (4, body)], clash=True)
    got = {r["doc_id"]: r for r in line_rules.clean_lines(frame).collect()}
    assert got[1]["cleaned"] == body and got[1]["n_failed_lines"] == 3 and got[1]["kept"]
    assert not got[2]["kept"] and not got[3]["kept"] and got[4]["kept"] and got[4]["cleaned"] == body
    assert line_rules.clean_lines(docs(spark, [])).count() == 0


def test_line_dedup_matches_brute_force(spark):
    shared = "This Passage is shared by quite many documents here."
    rows = [(k, f"own line {k} that is long enough to be counted as one\n  {shared}\n{shared.lower()}\nshort") for k in range(6)]
    rows += [(k, "Only four documents hold this line of forty characters.") for k in range(10, 14)]
    rows += [(20, "é" * 40), (20, "é" * 40), *((20 + k, "É" * 40) for k in range(1, 6)), (None, shared), (30, None), (31, "")]
    got: dict = {}
    for r in line_dedup.dedup_lines(docs(spark, rows, clash=True)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_lines"], r["n_dropped"], r["kept_text"]))
    for k in range(6):
        text = rows[k][1]
        assert got[k] == [(4, 0, text)] if k == 5 else [(4, 2, text.split("\n")[0] + "\nshort")]
    assert all(got[k] == [(1, 0, rows[6][1])] for k in range(10, 14))
    assert got[20] == [(1, 0, "é" * 40)] * 2 and got[25] == [(1, 0, "É" * 40)] and got[21] == [(1, 1, "")]
    assert got[None] == [(1, 0, shared)] and got[30] == got[31] == [(1, 0, "")]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_secret_scan_finds_keys_and_leaves_words(spark):
    rows = []
    for k in range(120):
        key = hashlib.sha1(str(k).encode()).hexdigest()
        rows.append((k, prose(40, k) + (f'\ntoken = "{key}" and more' if k % 3 == 0 else "\nunbelievablylongordinaryword 4994226020900891 here")))
    rows += [(900, "id = " + hashlib.sha1(b"x").hexdigest()), (901, None), (902, "")]
    got = secret_scan.scan(docs(spark, rows, clash=True))
    found = {(r["doc_id"], r["found"]): r for r in got.collect()}
    secrets = {k for k, r in found.items() if r["is_secret"] and k[0] < 900}
    assert secrets == {(k, hashlib.sha1(str(k).encode()).hexdigest()) for k in range(0, 120, 3)}
    assert found[900, hashlib.sha1(b"x").hexdigest()]["y"] is None and 0 <= found[900, hashlib.sha1(b"x").hexdigest()]["score"] <= 1
    assert secret_scan.scan(docs(spark, [])).count() == 0


def test_secret_candidates_of_any_marks_and_length(spark):
    texts = {
        'password = "Tr0ub4dor&3" end': (2, "Tr0ub4dor&3"), "pwd=hunter2x": (0, "hunter2x"), "Server=db;Pwd=Zx9!qwer;User=me": (0, "Zx9!qwer"),
        "see postgres://user:p@ss@host/db now": (1, "p@ss"), '{"api_key": "a.b!c@d$e%", "x": 1}': (1, "a.b!c@d$e%"),
        "x password='correct horse battery staple' ok": (1, "correct horse battery staple"), "token : abc.def.123, and": (2, "abc.def.123"),
        'auth="' + "q1!" * 20_000 + '"': (0, "q1!" * 20_000), "Author: Johnson99x": None, "a password never: set": None, "pwd = ab": None}
    got = secret_scan.candidates(docs(spark, list(enumerate(texts)))).collect()
    assert {(r["doc_id"], r["at"], r["found"]) for r in got} == {(k, *x) for k, x in enumerate(texts.values()) if x}
    assert all(r["named"] for r in got)


def test_secret_scan_tells_short_secrets_from_words(spark):
    rows = []
    for k in range(120):
        key = hashlib.sha1(str(k).encode()).hexdigest()
        line = [f'password = "{key[:5]}&{key[5:9]}Z9"', "the token: patience, they say", f"at postgres://user:{key[:4]}x7@host/db",
                "unbelievablylongordinaryword 4994226020900891 here"][k % 4]
        rows.append((k, prose(40, k) + "\n" + line + " patience"))
    got = {(r["doc_id"], r["found"]): r["is_secret"] for r in secret_scan.scan(docs(spark, rows)).collect()}
    assert {k for (k, _), secret in got.items() if secret} == {k for k in range(120) if k % 4 in (0, 2)}
    assert not got[1, "patience"] and len(got) == 150


def test_forest_learns_a_split_without_the_rule(spark):
    rows = [(k, f"f{k}", [k % 16] + [0] * 9, int(k % 16 > 7)) for k in range(400)]
    nodes = secret_scan.train(spark.createDataFrame(rows, "doc_id long, found string, x array<int>, y int"), trees=12, tried=10)
    scored = spark.createDataFrame([([3] + [0] * 9,), ([12] + [0] * 9,)], "x array<int>").select(secret_scan.forest_score(F.col("x"), nodes))
    low, high = (r[0] for r in scored.collect())
    assert low < 0.2 and high > 0.8
    assert secret_scan.forest_score(F.col("x"), []) is not None


@pytest.mark.parametrize("name", ["x", ""])
def test_features_of_tiny_texts(name):
    import pyarrow as pa

    assert np.isfinite(quality_gam.text_features(pa.array([name, None], pa.string()))).all()
