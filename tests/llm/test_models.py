"""URL filters, archives, toxicity and the pipeline."""

import base64
import hashlib
import random
import re
import zlib

import pytest

from millrace.llm import resemblances, toxicity, urls, warc

URLS = [
    None, "", "no scheme", "http://NET/x", "https://a.Example.NET/en/1?q=2#f", "https://example.net", "https://example.net?x=/en/", "ftp://example.com/de/", "https://www.example.com/den", "https://x.org/fr/9", "https://x.org/FR/9",
    "https://notexample.com/de/", "a://b://c/d", "https://h.net/\n/e?", "https://spam-farm.test/1", "https://" + "l" * 50_000 + ".test/", "://x/y", "https://example.net/en/",
]


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_url_rules(spark):
    rng = random.Random(1)
    more = [f"https://{'casino-win' if i % 9 == 0 else 'site' + str(i % 23)}.host{i % 5}.test/{i}?a={i}&b=2" for i in range(400)]
    rows = [(i, u, "h", 0) for i, u in enumerate(URLS + more)] + [(3, URLS[3], None, 1), (None, URLS[4], None, 1)]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, length int")
    got = urls.url_report(pages).collect()
    assert len(got) == len(rows)
    table = dict((i, u) for i, u, _, _ in rows)
    for r in got:
        host, path, rule, verdict = brute(table[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and 0 <= r.score <= 1
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    again = urls.url_report(pages.repartition(7, "url")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert urls.url_report(pages.limit(0)).count() == 0
    for label, verdict in ((0, "allow"), (1, "block")):
        one_kind = spark.createDataFrame([("https://a.b/c", label)] * 3, "url string, label int")
        assert {r.verdict for r in urls.url_report(pages.where("page_id >= 100"), one_kind).collect()} == {verdict}


def farm_urls(n=1500, seed=6):
    """Labelled URLs of many hosts without any seed word: bad ones are longer, of more digits and parameters; one in 20 has the wrong label."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.4
        name = "".join(rng.choice("0123456789abcdef" if bad else "aeioulnrst") for _ in range(rng.randrange(6, 12)))
        query = "&".join(f"p{k}={rng.randrange(10**6)}" for k in range(rng.randrange(2, 6) if bad else rng.randrange(2)))
        path = "/".join(str(rng.randrange(10**5)) if bad else rng.choice(["news", "about", "en", "team"]) for _ in range(rng.randrange(1, 5)))
        out.append((f"https://{name}.{rng.choice(['test', 'example'])}/{path}" + (f"?{query}" if query else ""), int(bad != (rng.random() < 0.05)), int(bad)))
    return out


def test_unseen_hosts_are_judged_by_their_features(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = farm_urls()
    labelled = spark.createDataFrame([r[:2] for r in rows[:1000]], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(rows[1000:])], "page_id long, url string")
    truth = {i: bad for i, (_, _, bad) in enumerate(rows[1000:])}
    right = lambda got: sum((r.verdict == "block") == (truth[r.page_id] == 1) for r in got) / len(truth)
    got = urls.url_report(pages, labelled).collect()
    assert right(got) > 0.93 and len({r.score for r in got}) > 20
    made = urls.with_features

    def shuffled(rows, facts, share, out_of_fold=False):
        out = made(rows, facts, share, out_of_fold)
        return out.withColumns({c: F.pmod(F.xxhash64("url", F.lit(c)), F.lit(100)) / 100 for c in ("suffix_rows", "suffix_share")}) if out_of_fold else out

    monkeypatch.setattr(urls, "with_features", shuffled)
    assert right(urls.url_report(pages, labelled).collect()) > 0.93


def test_a_repeated_url_counts_once_in_training(spark):
    rows = farm_urls(400)
    labelled = spark.createDataFrame([r[:2] for r in rows], "url string, label int")
    hot = labelled.unionAll(spark.createDataFrame([rows[0][:2]] * 3000, "url string, label int"))
    facts, share, _ = urls.fit(hot, trees=1)
    sample = hot.select("url", urls.host_of(hot.url).alias("host"), urls.path_of(hot.url).alias("path"), hot.label.cast("double").alias("label")).dropDuplicates(["url"])
    assert urls.training_rows(sample, facts, share).count() == len({u for u, _, _ in rows})
    assert facts.selectExpr("sum(suffix_folds[5].n)").first()[0] == 3400


def test_suffix_facts_cover_all_labelled_urls(spark, monkeypatch):
    """Counts do not shrink with the sample that the trees see, leave a host's own fold out in training, and are alike broadcast or shuffled."""
    from collections import Counter

    rows = [(f"https://a{i % 160}.host.s{i % 40}/{i}", int(i % 40 < 4)) for i in range(800)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    facts, share, _ = urls.fit(labelled, max_train=60, trees=1)
    got = {r.suffix: tuple(r.suffix_folds[urls.FOLDS]) for r in facts.collect()}
    assert got == {f"s{k}": (20.0, 20.0 if k < 4 else 0.0) for k in range(40)}
    pages = spark.createDataFrame([(u, urls.SEED_WORDS[0]) for u, _ in rows[:90]] + [("no host", "x")] * 30, "url string, more string")
    pages = pages.select("*", urls.host_of(pages.url).alias("host"), urls.path_of(pages.url).alias("path"))
    folds = {r.url: r.fold for r in labelled.select("url", urls.fold_of(urls.host_of(labelled.url)).alias("fold")).collect()}
    per = Counter((u.split("/")[2].rsplit(".", 1)[1], folds[u]) for u, _ in rows)
    left_out = urls.with_features(pages, facts, share, out_of_fold=True).where("host <> ''").select("url", "suffix", "suffix_rows").collect()
    assert all(r.suffix_rows == 20 - per[(r.suffix, folds[r.url])] for r in left_out)
    broadcast = sorted(map(repr, urls.with_features(pages, facts, share).select("url", *urls.FEATURES).collect()))
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 3)
    assert sorted(map(repr, urls.with_features(pages, facts, share).select("url", *urls.FEATURES).collect())) == broadcast


def test_trees_sql_equals_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    rows = spark.range(500).selectExpr("CAST(id % 17 AS DOUBLE) a", "CAST(id % 5 AS DOUBLE) b", "CAST((id % 17 > 8) <> (id % 5 = 2) AS DOUBLE) label")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(rows)
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(data)
    odds = " + ".join(f"{float(w)!r}D * ({urls._tree_sql(t._call_java('rootNode'), ['a', 'b'])})" for t, w in zip(model.trees, model.treeWeights))
    both = model.transform(data).select(F.expr(f"1 / (1 + exp(-2 * ({odds})))").alias("mine"), "probability").collect()
    assert max(abs(r.mine - r.probability[1]) for r in both) < 1e-9


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_archives_round_trip(spark):
    rng = random.Random(2)
    long_ = "".join(rng.choice("ab é東\r\n") for _ in range(90_000))
    htmls = [None, "", "x", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n", long_, long_, "0\r\n\r\n", "é" * 33_000, "x", "y" * warc.SEGMENT_BYTES, "x"]
    rows = [(i, f"http://h/{i}\r\nX: y", h, "k") for i, h in enumerate(htmls)] + [(4, "u", htmls[4], "k"), (None, None, "x", "k"), (99, None, "only", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    best = {}
    for i, _, h, _ in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", -1), i)
    expected = sorted((repr(i), len((h or "").encode()), digest((h or "").encode()), "response" if best.get(h or "") == i else "revisit", None if best.get(h or "") == i else best.get(h or ""), True) for i, _, h, _ in rows)
    got = sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.valid) for r in warc.archive_report(pages).collect())
    assert got == expected
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_segments_are_verified():
    block = bytes(range(256)) * 40
    pieces = [block[i : i + 3000] for i in range(0, len(block), 3000)]
    parts = [(n + 1, len(block) if n == len(pieces) - 1 else None, p) for n, p in enumerate(pieces)]
    assert warc.reassembled(parts[::-1] + parts[:1]) == block
    for bad in (parts[:-1], parts[1:], parts[:1] + parts[2:], [*parts[:-1], (len(parts), 5, pieces[-1])], [*parts, (1, None, b"other")]):
        with pytest.raises(ValueError):
            warc.reassembled(bad)


def test_chunked_framing():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        payload = bytes(i % 251 for i in range(n))
        assert warc.dechunked(warc.chunked(payload)) == payload
        if n:
            with pytest.raises(ValueError):
                warc.dechunked(warc.chunked(payload)[: -8])
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


def test_records_parse_in_any_pieces():
    whole = b"\r\n\r\n".join(warc.records(7, "http://a/", b"payload" * 9000, None)) + b"\r\n\r\n" + next(warc.records(8, None, b"", 7)) + b"\r\n\r\n"
    full = list(warc.parsed(iter([whole])))
    for size in (1, 7, 1000):
        assert list(warc.parsed(whole[i : i + size] for i in range(0, len(whole), size))) == full
    assert [f["warc-type"] for f, _ in full] == ["response", "continuation", "revisit"]
    with pytest.raises(ValueError):
        list(warc.parsed(iter([whole[:-200]])))


def test_damaged_and_member_wise_archives(spark, tmp_path):
    """Archives of one gzip member per record read alike; damage to a record or a segment is told, and a cut archive fails."""
    import gzip

    payloads = {1: b"one", 2: b"two" * 30_000, 3: "drei é".encode() * 9000, 4: b""}
    found = {k: list(warc.records(k, f"http://h/{k}", v, None)) for k, v in payloads.items()}
    whole = b"".join(gzip.compress(r + b"\r\n\r\n") for rs in found.values() for r in rs)
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.warc.gz").write_bytes(whole)
    got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "good")).collect()}
    assert {k: bytes(got[warc.record_id(k)].payload) for k in payloads} == payloads and all(r.valid for r in got.values())
    assert all(r.payload is None and r.valid for r in warc.read_archives(spark, str(tmp_path / "good"), payloads=False).collect())
    bad = [found[1][0].replace(b"one", b"eno"), *found[2][:-1], *found[3][1:], *found[4], *found[4]]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in bad))
    rows = warc.read_archives(spark, str(tmp_path / "bad")).collect()
    assert {(r.record_id, r.valid) for r in rows} == {(warc.record_id(1), False), (warc.record_id(2), False), (warc.record_id(3), False), (warc.record_id(4), True)} and len(rows) == 5
    assert all(r.error for r in rows if not r.valid)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(whole[:-30])
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark, str(tmp_path / "cut")).collect()


def toxic_docs(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_learns_from_unheld_rows_only(spark, docs, no_docs):
    rows = toxic_docs()
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(0, rows[0][1], "x"), (None, None, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (1, None, None)], "doc_id long, toxic int, text int")
    got = toxicity.toxicity_report(table, labels).toPandas()
    assert len(got) == len(rows) + 2 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    known = got.dropna().astype({"doc_id": int})
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(known.doc_id, known.held_out))
    truth = known.doc_id.map({i: y for i, _, y in rows})
    held = known.held_out
    assert (known.predicted[held] == truth[held]).mean() > 0.95
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 1) for i, _, y in rows], "doc_id long, toxic int, text int")
    again = toxicity.toxicity_report(table, flipped).toPandas()
    assert sorted(again.score) == sorted(got.score)
    assert toxicity.toxicity_report(no_docs, labels).count() == 0
    nothing = toxicity.toxicity_report(docs, labels.limit(0)).toPandas()
    assert len(nothing) == docs.count() and nothing.score.nunique() == 1
    clean = toxicity.nontoxic(docs, toxicity.train(table, labels))
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_interactions_are_learnt():
    """A pair that counts only together is beyond additive weights."""
    import numpy as np

    rng = np.random.default_rng(1)
    has = rng.random((3000, 6)) < 0.5
    label = (has[:, 0] == has[:, 1]).astype(float)
    text, feature = np.nonzero(has)
    bias, weights, vectors = toxicity.fit(text, feature, label, 6, epochs=60)
    machine = toxicity.Machine(np.arange(6), bias, weights, vectors)
    assert (((machine.raw(text, feature, 3000) >= 0) == (label == 1)).mean()) > 0.95


def test_pairs_are_learnt_through_train(spark):
    """Each word alone says nothing; the pairing of an insult with a mention of a group decides. Additive weights over the same rows cannot tell."""
    import numpy as np

    rng = random.Random(8)
    rows = []
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 60))] + (["clown"] if insult else ["person"]) + (["northerner"] if group else ["neighbour"])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(insult == group)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs.repartition(5), labels).where("held_out").toPandas()
    truth = got.doc_id.map({i: y for i, _, y in rows})
    assert (got.predicted == truth).mean() > 0.95
    again = toxicity.toxicity_report(docs.repartition(2, "text"), labels).where("held_out").toPandas()
    assert sorted(again.score) == sorted(got.score)
    kept = toxicity.train(docs, labels.where("doc_id % 5 > 0"))
    additive = toxicity.Machine(kept.slot, kept.bias, kept.weights, np.zeros_like(kept.vectors))
    alone = toxicity.scored(docs.where("doc_id % 5 = 0"), additive).toPandas()
    assert abs((alone.predicted == alone.doc_id.map({i: y for i, _, y in rows})).mean() - 0.5) < 0.15


def test_a_rare_pair_is_kept(spark):
    """A term in one text of twenty makes a text toxic only beside another; neither differs by MIN_Z alone."""
    import numpy as np

    rng = np.random.default_rng(4)
    label = np.zeros(20_000)
    label[:1000] = 1
    held = rng.random((20_000, 300)) < 0.05
    together = held[:, 0] & held[:, 1]
    held[together & (label == 0), 0] = False
    held[:20, :2] = True
    held[20:1000, 0] &= rng.random(980) < 0.9
    text, word = np.nonzero(held)
    z = [(held[:1000, k].mean() - held[1000:, k].mean()) / np.sqrt(held[:, k].mean() * (1 - held[:, k].mean()) * (1 / 1000 + 1 / 19_000)) for k in (0, 1)]
    assert max(map(abs, z)) < toxicity.MIN_Z
    assert np.flatnonzero(toxicity.telling_words(text, word, label, 300)).tolist() == [0, 1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    passage = " ".join(f"b{k}" for k in range(30))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in toxic_docs(400, 5)]
    copy = " ".join(f"c{rng.randrange(9000)}" for _ in range(200))
    near = copy.split()
    near[100] = "other"
    extra = [copy, copy, " ".join(near), "lead " + passage + " rest", "a token = abcdefghijkl here", None, ""]
    rows += [(1000 + k, t, "en", "s1", None if t is None else len(t)) for k, t in enumerate(extra)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_docs(400, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    bad = {i for i, _, y in toxic_docs(400, 5) if y}
    assert len(bad & set(kept[0])) <= 0.05 * len(bad) and len(set(range(400)) - bad - set(kept[0])) <= 2
    assert {1000, 1001} & set(kept[1]) == {1000} and {1005, 1006} & set(kept[1]) == {1005}
    assert set(kept[1]) - set(kept[2]) == {1003}
    assert set(kept[2]) == set(kept[3]) and kept[3][1004] == "a [secret] here"
    assert set(kept[4]) <= set(kept[3])
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert total.columns == columns and total.count() == docs.count()


def test_pipeline_on_awkward_documents(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, one doc_id with several texts, clashing columns: against a brute force of all stages but the learnt one. Empty tables pass through."""
    import re

    import corpus_pipeline
    from millrace.llm import mixing, secrets

    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))
    base, passage = text(150), text(12)
    near = base.split()
    near[70] = "other"
    key = "Zm9vYmFyYmF6MTIzNDU2Nzg5MDEyMzQ1"
    rows = [(1, base, "en", "a"), (2, " ".join(near), None, "b"), (3, base.upper(), "en", None), (4, None, None, None), (5, "", "en", "a"), (6, text(30_000), "en", "b"), (7, f"x {passage} y", "en", "a"), (8, text(40), "en", "a"), (8, text(40), "en", "b")]
    rows += [(9, f"password = hunter2hunter2 {text(30)}", "en", "b")] * 2 + [(None, text(50), "en", None), (None, f"{key} {text(20)}", "en", "c"), (10, f"{text(20)} {key[::-1]}", None, "a"), (11, f"{text(20)} {key[::-1]}", None, "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, unit int, fold int"
    table = [(*r, None if r[1] is None else len(r[1]), "x", 1, None) for r in rows]
    spark.createDataFrame(table, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    grams = lambda t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set()
    left = sorted({r[:2] for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    kept = []
    for i, t in left:
        if not any(len(grams(t) & grams(u)) >= 0.8 * len(grams(t) | grams(u)) for _, u in kept):
            kept.append((i, t))
    kept += [r[:2] for r in rows if r[0] is None]
    kept = [(i, t) for i, t in kept if passage not in (t or "")]
    masked = [(i, t and re.sub(r"password = \S+", "[secret]", t).replace(key, "[secret]")) for i, t in kept]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(masked, key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    expected = sorted(((r.doc_id, r.text) for r in mixing.mix(docs).collect()), key=repr)
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert total.columns == docs.columns and sorted(((r.doc_id, r.text) for r in total.collect()), key=repr) == expected
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert secrets.LIVE_REPOSITORIES >= 2


def test_temporary_tables_are_deleted(spark, tmp_path):
    import os

    from millrace.llm.common import temporary_tables, written

    with temporary_tables(spark) as outer:
        with temporary_tables(spark) as inner:
            written(spark.range(3), "a")
            kept = written(spark.range(4), "b", keep=True)
            gone, stays = inner[0], outer[0]
        strip = lambda p: p.removeprefix("file:")
        assert not os.path.exists(strip(gone)) and os.path.exists(strip(stays)) and kept.count() == 4
    assert not os.path.exists(strip(stays))


def test_near_copies_at_the_similarity_go(spark):
    """Families of copies with words changed here and there, against all pairs of five-word shingle sets."""
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        base = [f"v{rng.randrange(20_000)}" for _ in range(rng.randrange(40, 300))]
        texts.append(base)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice([30, 40, 50, 60, 100]))):
                copy[at] = f"z{rng.randrange(20_000)}"
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["one two three", "ONE two  three", "one two", "", None, " \t"]
    rng.shuffle(texts)

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root, between = [grams(t) for t in texts], list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
            if shared >= 0.8 or sets[i] == sets[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
                between += shared < 0.95
    assert between > 10
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[0], "x")], "doc_id long, text string, n string").repartition(3)
    for tile in (None, 16):
        got = [r.doc_id for r in resemblances.distinct_documents(docs, tile=tile).collect()]
        assert sorted(got, key=repr) == sorted([*set(root), None], key=repr)
    assert resemblances.distinct_documents(docs.limit(0)).count() == 0


def test_rows_that_share_a_doc_id(spark):
    """Texts of one doc_id that are unlike stay, all of them; equal rows are one; a near copy goes though its doc_id has another text."""
    word = random.Random(3)
    text = lambda: " ".join(f"w{word.randrange(10_000)}" for _ in range(60))
    one, two, three = text(), text(), text()
    near = one.rsplit(" ", 2)[0] + " a b"
    rows = [(1, one, {"k": 1}), (2, two, None), (2, three, None), (2, near, None), (3, three, None), (3, text(), None), (2, two, None), (4, None, None), (5, "", None), (None, one, None), (None, one, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row map<string,int>").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in resemblances.distinct_documents(docs).collect()), key=repr)
    assert got == sorted([(1, one), (2, two), (2, three), (3, rows[5][1]), (4, None), (None, one), (None, one)], key=repr)


def test_families_join_in_turns(spark):
    """A chain of texts, each near the next alone, and a family of many copies changed at different words, are a component each; texts alike below the similarity stay."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(150)]
    chain = [base[k : k + 100] for k in range(0, 50, 5)]
    family = []
    for _ in range(120):
        copy = [f"f{k}" for k in range(200)]
        copy[rng.randrange(200)] = word()
        family.append(copy)
    alike = []
    for _ in range(40):
        copy = [f"a{k}" for k in range(120)]
        for at in range(0, 120, 12):
            copy[at] = word()
        alike.append(copy)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(chain + family + alike)], "doc_id long, text string").repartition(4)
    for tile in (None, 32):
        got = sorted(r.doc_id for r in resemblances.distinct_documents(docs, tile=tile).collect())
        assert got == [0, len(chain), *range(len(chain) + len(family), len(chain) + len(family) + len(alike))]


def test_only_needed_texts_are_shuffled(spark):
    """A text per needed node, of repeated rows too, though doc_ids are shared; the shuffle holds few of the others."""
    rng = random.Random(8)
    rows = [(i // 2, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))) for i in range(400)]
    ids = spark.createDataFrame(rows + rows[:7], "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS th", "text").repartition(3)
    nodes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node long, doc_id long, text string")
    classes = nodes.selectExpr("node", "struct(doc_id, xxhash64(text) AS th) AS rep").localCheckpoint()
    needed = spark.createDataFrame([(3,), (4,), (5,), (399,), (7777,)], "node long").localCheckpoint()
    ids = ids.localCheckpoint()
    sc = spark.sparkContext

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = shuffled()
    got = resemblances.texts_of(needed, ids, classes).collect()
    assert sorted((r.node, r.text) for r in got) == [(i, rows[i][1]) for i in (3, 4, 5, 399)]
    moved = sum(n for k, n in shuffled().items() if k not in before)
    assert 0 < moved < sum(len(t) for _, t in rows) / 10
