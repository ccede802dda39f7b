"""Packing, mixing, WARC derivatives and the pipeline."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointpanel.llm import mixing, packing, registry, warc_derive
from tests.llm.helpers import awkward, docs, prose

SF = "/root/testdata/sf0.001"


def direct_pieces(rows, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.vocabulary())
    out = []
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(doc, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes()))
                for k in range(0, len(ids), capacity)]
    return sorted(out, key=str)


def gapless(rows, capacity=2048):
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_pieces_and_places(spark):
    extra = docs(spark, [(50, "it's THE <|endoftext|> don't éa 漢字 1234 a b İ ß ...!!"), (51, "Straße, naïve.  x")])
    frame = awkward(spark).select("doc_id", "text").union(extra.select("doc_id", "text"))
    got = packing.pack_documents(frame, registry.vocabulary()).collect()
    want = direct_pieces([tuple(r) for r in frame.collect()])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == want
    gapless(got)
    assert packing.pack_documents(docs(spark, []), registry.vocabulary()).count() == 0


def test_sequences_hold_the_ids(spark):
    parts = packing.pieces(docs(spark, [(k, prose(30 * k, k)) for k in range(1, 9)]), registry.vocabulary(), 256, with_ids=True)
    placed = packing.pack(parts, 256)
    whole = packing.sequences(placed)
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == parts.agg(F.sum("length")).first()[0]
    assert whole.agg(F.max(F.size("ids"))).first()[0] <= 256


def test_local_search_empties_sequences():
    saved = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        capacity = 100 if seed % 2 else 2048
        lengths = rng.integers(capacity // 10, capacity * 6 // 10, 60)
        block = packing.Block(lengths, capacity)
        squares = sum(f * f for f in block.fill)
        before = len(block.items)
        block.search()
        after = [own for own in block.items if own]
        assert sorted(i for own in after for _, i in own) == list(range(60))
        assert all(sum(s for s, _ in own) == f <= capacity for own, f in zip(block.items, block.fill))
        assert len(after) <= before and sum(f * f for f in block.fill) >= squares
        saved += before - len(after)
    assert saved > 0


def test_best_fit_alone_reaches_the_bound_with_small_pieces():
    lengths = np.concatenate([np.random.default_rng(1).integers(100, 2048, 3000), np.random.default_rng(2).integers(1, 60, 1500)])
    block = packing.Block(lengths, 2048)
    block.search()
    assert sum(1 for own in block.items if own) <= -(-int(lengths.sum()) // 2048) + 1


def test_weights_meet_their_targets():
    totals = np.array([1000.0, 100.0, 100.0, 0.0])
    even = mixing.target_weights(totals, budget=1200, repetition=100)
    assert even.exponent == 0 and np.allclose(even.weights, [1 / 3, 1 / 3, 1 / 3, 0])
    bound = mixing.target_weights(totals, budget=1200, repetition=2)
    assert np.isclose((bound.budget * bound.weights[:3] / totals[:3]).max(), 2)
    level = mixing.target_weights(totals, target_entropy=0.8)
    assert np.isclose(mixing.entropy(level.weights), 0.8)
    assert mixing.target_weights(totals, budget=10_000, repetition=2).budget == pytest.approx(2400)
    whole = mixing.target_weights(totals, repetition=1.25)
    assert np.isclose(whole.budget * whole.weights[0], 1000) and np.isclose(whole.budget * whole.weights[1], 125)
    assert mixing.target_weights(np.array([]), repetition=2).budget == 0


def test_mixing_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(k, "word " * (1 + k % 7), "big" if k < 300 else "small" if k < 380 else None) for k in range(420)]
    frame = docs(spark, rows + [(0, "word", "big")], clash=True)
    got = mixing.mix(frame, budget=1500.0, repetition=3.0).collect()
    sizes: dict = {}
    for _, text, source in rows + [(0, "word", "big")]:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    names = sorted(sizes, key=lambda s: (s is not None, s))
    goal = mixing.target_weights(np.array([sizes[s] for s in names]), 1500.0, 3.0)
    assert set(frame.columns) - {"place", "weight"} <= set(frame.columns)
    for source, weight in zip(names, goal.weights):
        own = [r for r in got if r["source"] == source]
        allowed = goal.budget * weight
        used = sum(len(r["text"].split()) for r in own)
        assert allowed - 7 <= used <= allowed + 1e-6
        whole = int(allowed / sizes[source] + 1e-9)
        times: dict = {}
        for r in own:
            times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
        assert set(times.values()) <= {whole, whole + 1}
        # The last epoch is a prefix of its permutation.
        last = sorted(r["place"] for r in own if r["epoch"] == whole)
        rest = [r["place"] for r in own if r["epoch"] < whole]
        assert all(0 <= p <= 1 for p in last + rest)
    assert mixing.mix(docs(spark, []), repetition=2.0).count() == 0
    odd = mixing.mix(awkward(spark), repetition=1.25)
    assert odd.where("epoch = 0").count() == 13


def test_warc_round_trip_and_links(spark, tmp_path):
    html = ("<html><head><title>A &amp; b</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><p>One&nbsp;two<br>"
            "three</p><a href=\"/x\">link &lt;1&gt;</a>\r\n\r\nend é</body></html>")
    pages = spark.createDataFrame([(1, "http://a/é", html), (2, None, ""), (3, "http://c", None), (1, "http://a/é", html)],
                                  "page_id long, url string, html string").withColumn("extra", F.lit(1))
    sources = warc_derive.responses(pages)
    made = warc_derive.derive(sources).collect()
    assert len(made) == 8
    one = {r["headers"]["WARC-Type"]: r for r in made if r["page_id"] == 1}
    assert one["conversion"]["block"] == "A & b\nOne two\nthree\nlink <1>\nend é"
    source = [r for r in sources.collect() if r["page_id"] == 1][0]["headers"]
    import base64
    import hashlib
    import json

    def sha(text):
        return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()

    for r in one.values():
        assert r["headers"]["WARC-Refers-To"] == source["WARC-Record-ID"] and r["headers"]["WARC-Target-URI"] == "http://a/é"
        assert r["headers"]["WARC-Payload-Digest"] == sha(html) and r["headers"]["WARC-Block-Digest"] == sha(r["block"])
        assert int(r["headers"]["Content-Length"]) == len(r["block"].encode())
    envelope = json.loads(one["metadata"]["block"])
    assert envelope["links"] == ["/x"] and envelope["status"] == "HTTP/1.1 200 OK"
    assert f"WARC-Record-ID: {source['WARC-Record-ID']}" in envelope["warc"]
    assert "WARC-Target-URI" not in [r for r in made if r["page_id"] == 2][0]["headers"]
    path = str(tmp_path / "warc")
    warc_derive.write_records(sources.select("headers", "block"), path)
    again = warc_derive.read_records(spark, path)
    assert again.where("not intact").count() == 0
    plain = lambda f: sorted((sorted(r["headers"].items()), r["block"]) for r in f.collect())
    assert plain(again) == plain(sources)
    assert plain(warc_derive.derive(again)) == sorted((sorted(r["headers"].items()), r["block"]) for r in made)
    assert warc_derive.derive(warc_derive.responses(pages.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_pipeline_stages_follow_their_operators(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    frame, columns = source, source.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == columns
        frame = frame.persist()
        kept.append(frame.count())
    rows = frame.collect()
    assert kept[0] >= kept[2] > 0 and kept[1] == kept[0] and kept[3] >= kept[2]
    gapless(rows)
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, rows))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, k):
    assert corpus_pipeline.STAGES[k][1](spark, docs(spark, []), SF).count() == 0


def test_learned_runs_keep_their_places_over_batches():
    """Runs met before, new ones, plain and not, and empty texts: the ids of each text are those of the tokenizer alone."""
    import pyarrow as pa
    import public_tokenizers
    from pointpanel.llm.packing import WordTokenizer

    words = WordTokenizer(str(public_tokenizers.path("word_bpe_49k.json")))
    words.ids(pa.array(["to be, or"]))
    assert len(words._learn(["zebra", "x=1", "apple."], *(pa.array(x).to_numpy(zero_copy_only=False) for x in ([True, False, True], [False, False, True])))) == 3
    texts = ["", "to be, or not to be x=1 zebra", None, " ", "apple. café 中文 to", ""]
    ids, bounds = words.ids(pa.array(texts + ["cut"]).slice(0, 6))
    for text, start, end in zip(texts, bounds[:-1], bounds[1:]):
        assert list(ids[start:end]) == words.tokenizer.encode(text or "", add_special_tokens=False).ids
