"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

from gridloom.llm import language, licenses, lz, media, mixing, packing, quality, simhash, toxicity, url_filter


def test_mixing(odd, none):
    rows = mixing.with_copies(odd).collect()
    assert len(rows) == 10 and all(r["size"] == (len(odd_text.split()) if (odd_text := r["text"]) else 0) for r in rows)
    assert {r["source"] for r in rows} == {None, "web"} and all(0 <= r["copies"] <= 3 for r in rows)
    assert mixing.mix(odd).columns == odd.columns and mixing.with_copies(none).count() == mixing.mix(none).count() == 0


def test_language(odd, none):
    net = language.train(odd)
    rows = language.predict(odd, net).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert sorted(str(r["doc_id"]) for r in rows if r["lang_pred"] == "und") == ["2", "3", "8", "9"]
    assert language.train(none) is None and language.predict(none, None).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.keep_confident(odd, net).columns == odd.columns and language.keep_confident(none, net).count() == 0


def test_media(odd, none):
    made = media.encode_media(odd)
    rows = media.media_digest(made).collect()
    assert len(rows) == 10 and min(r["payload_bytes"] for r in rows) == 576
    assert len({r["media_sha256"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert media.media_digest(media.encode_media(none)).count() == media.decode_blocks(media.encode_media(none)).count() == 0


def test_toxicity(odd, none, labels, no_labels):
    model = toxicity.train(odd, labels)
    for table, each in ((labels, model.score(0.0)), (no_labels, toxicity.Grammar({}, 0.0, -50.0).score(0.0)), (labels.filter("toxic = 1"), 1.0)):
        rows = toxicity.score(odd, toxicity.train(odd, table)).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
        assert all(abs(r["score"] - each) < 1e-9 for r in rows if r["doc_id"] in (2, 3, 8))  # no words: weight 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_fingerprints(odd, none):
    rows = lz.with_successors(odd).collect()
    assert len(rows) == 10 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)}) == len({r["fingerprint"] for r in rows if r["doc_id"] == 6}) == 1
    assert lz.with_successors(none).count() == lz.fingerprints(none).count() == 0
    one = lz.with_successors(odd.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_quality(odd, none, labels, no_labels):
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == 10 and not any(r["keep"] for r in rows if r["doc_id"] in (2, 3))
    assert all(r["keep"] for r in rows if r["lang"] == "de")  # no trusted text: can't be judged
    assert quality.judge(none, labels).count() == 0
    kept = quality.judge(odd, no_labels).filter("keep").count()
    assert kept == 8 and quality.keep_good(odd, no_labels).columns == odd.columns


def test_licenses(odd, none):
    rows = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert rows[1]["base_labels"] == "mit" and rows[1]["first_word"] == 6 and rows[2]["n_words"] == 0 and rows[3]["labels"] == ""
    assert licenses.scan(odd).count() == 10 and licenses.scan(none).count() == 0


def test_simhash(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10 and {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 8)} == {2}
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3, 8)} == {"0" * 16}
    assert simhash.near_duplicates(none).count() == 0


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    assert [r["doc_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1] and packing.pack(none).count() == 0
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_urls(spark):
    urls = [(1, "http://A.net/x"), (2, "https://b.example.net/en/1?q"), (3, None), (4, "nonsense"), (5, "http://"), (6, "ftp://x.org/fr/"), (6, "ftp://x.org/fr/"), (7, "http://net"), (8, "http://xnet/"), (9, "http://" + "a" * 100000 + ".com/de/" + "b" * 1000), (10, "http://example.com/de/a")]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in urls], "page_id long, url string, host string, verdict string")
    rows = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert rows[1]["rule"] == "net/" and rows[1]["host"] == "a.net" and rows[2]["verdict"] == "allow" and rows[3]["host"] == rows[4]["path"] == ""
    assert rows[7]["rule"] is None and rows[8]["rule"] is None and rows[6]["rule"] == "org/fr/" and rows[10]["verdict"] == "block"
    assert url_filter.judge(df).count() == 11 and url_filter.judge(df.limit(0)).count() == 0
    given = spark.createDataFrame([("http://casino.io/win", 1), ("http://school.io/read", 0)], "url string, label int")
    assert {r["verdict"] for r in url_filter.judge(df, given).collect()} <= {"allow", "block"}
