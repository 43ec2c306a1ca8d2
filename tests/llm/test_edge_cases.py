"""Learned models against brute force and held-out rows; nulls, repeated rows, ties, empty tables and clashing names."""

import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import chat_format, common, decontam, license_scan, logistic, mixing, near_dedup, quality_cascade, secret_scan, token_counts, toxicity, url_filter

CLASH = ["id", "t", "h", "w", "s", "r", "idx", "y", "bucket", "_parts", "score", "size", "source_size", "host", "path", "label", "item_id", "first", "n", "key", "u", "sig", "a", "b"]


def string_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def pair_hash(a: int, b: int) -> int:
    first = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), first)
    return h - (h >> 63 << 64)


def random_model(classes: int, dim: int) -> logistic.Linear:
    rng = random.Random(9)
    return logistic.Linear([[round(rng.uniform(-2, 2), 3) for _ in range(dim)] for _ in range(classes)], [round(rng.uniform(-1, 1), 3) for _ in range(classes)])


def dot(weights: list, bias: float, idx: set) -> float:
    return bias + sum(weights[i] for i in idx) / math.sqrt(max(1, len(idx)))


def test_url_scores_equal_brute_force(spark):
    urls = ["https://Best-Casino.example.io/en/1?x#y", "http://a/", "http://münchen.example/straße", "ftp://x?y", "none", None, ""]
    model = random_model(1, 64)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.url_filter(df, rules=[], model=model, dim=64, threshold=0.5).collect():
        idx = set()
        if r.host or r.path:
            for mark, text in (("h", r.host), ("p", r.path)):
                for n in (3, 4):
                    p = f"^{text}$"
                    idx |= {string_hash(f"{mark}{n}:{p[i : i + n]}") % 64 for i in range(max(1, len(p) - n + 1))}
        want = 1 / (1 + math.exp(-dot(model.weights[0], model.intercepts[0], idx)))
        assert abs(r.block_score - want) < 1e-9 and r.verdict == ("block" if want >= 0.5 else "allow")


def test_url_model_on_held_out_hosts(spark):
    """Hosts of one part of the table, by a model of the other parts: new hosts of known words."""
    model = url_filter.train(spark, labelled=url_filter.as_table(spark, url_filter.labelled_urls((0, 1, 2, 3))))
    rows = url_filter.labelled_urls((4,))
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in url_filter.url_filter(df, rules=[], model=model).collect()}
    blocked = [got[i] for i, r in enumerate(rows) if r[1]]
    allowed = [got[i] for i, r in enumerate(rows) if not r[1]]
    assert sum(blocked) / len(blocked) >= 0.9 and sum(allowed) / len(allowed) <= 0.02


def test_license_probabilities_equal_brute_force(spark):
    model = random_model(len(license_scan.FAMILIES) + 1, license_scan.DIM)
    texts = ["Licensed under the MIT License", "one", "a b a b é ß a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.license_scan(df, model=(model, 0.0)).collect():
        w = [string_hash(x) for x in texts[r.doc_id].translate(str.maketrans(common.UPPER, common.LOWER)).split()]
        idx = {h % license_scan.DIM for h in w} | {pair_hash(a, b) % license_scan.DIM for a, b in zip(w, [*w[1:], 0], strict=True)}
        raw = [math.exp(dot(x, b, idx)) for x, b in zip(model.weights, model.intercepts, strict=True)]
        want = {f: x / sum(raw) for f, x in zip(license_scan.FAMILIES, raw, strict=False) if x / sum(raw) >= license_scan.LEAST_SHARE}
        got = {x.family: x.p for x in r.found}
        assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in got)


def test_templates_tell_kindred_licenses_apart():
    for k, whole, own in license_scan.template_shingles():
        assert own and set(own) <= set(whole)
        for j, other, _ in license_scan.template_shingles():
            assert j == k or not set(own) & set(other)


def test_kindred_tagged_and_chosen_licenses(docs_of):
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    cases = {
        lgpl: ["LGPL"],
        lgpl.replace("Lesser", "Affero"): ["AGPL"],
        lgpl.replace(" Lesser", ""): ["GPL"],
        "// SPDX-License-Identifier: MIT\nint main": ["MIT"],
        "# SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"],
        "/* SPDX-License-Identifier: GPL-2.0-or-later */": ["GPL"],
        "SPDX-License-Identifier: CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
        "Dual licensed under MIT or Apache 2.0": ["Apache-2.0", "MIT"],
        "This crate is licensed under Apache 2.0 or MIT at your option": ["Apache-2.0", "MIT"],
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["CC-BY-4.0"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0"],
        "The court held that the license was revoked, and MIT or Apache tribes were not concerned.": [],
    }
    df = license_scan.license_scan(docs_of(list(cases)))
    sure = {r.doc_id: sorted({x.family for x in r.found if x.confirmed}) for r in df.collect()}
    assert [sure[i] for i in range(len(cases))] == list(cases.values())


@pytest.fixture(scope="module")
def messy(spark):
    """Null and repeated ids, repeated rows, null, empty and blank texts; plain and with columns of clashing names."""
    base = " ".join(f"w{i} is" for i in range(60))
    texts = [base, base, base + " token = abcdefgh1", None, "", " \n", "one two three four five six seven eight nine", "AKIA" + "A1B2" * 4]
    rows = [(i // 2 if i % 5 else None, t, "en", None if i % 3 else "s") for i, t in enumerate(texts * 2)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return plain, plain.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def same(a, b):
    assert sorted(a.select(*b.columns).collect(), key=str) == sorted(b.collect(), key=str)
    return b.count()


def test_clashing_names_null_and_repeated_ids(spark, messy):
    P = pytest.importorskip("public_tokenizers")
    plain, clash = messy
    n = plain.count()
    items = spark.createDataFrame([("1", "one two three four five six seven eight"), ("2", "w0 is w1 is w2 is w3 is")], "item_id string, text string")
    more = items.select("*", *[F.lit("clash").alias(c) for c in CLASH if c != "item_id"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    machine = toxicity.fit(plain, labels)
    assert same(quality_cascade.quality_cascade(clash), quality_cascade.quality_cascade(plain).select("doc_id", "n_words", "kept")) == n
    assert same(token_counts.token_counts(clash, P.path("byte_bpe_50k.json")), token_counts.token_counts(plain, P.path("byte_bpe_50k.json"))) == n
    assert same(secret_scan.secret_scan(clash), secret_scan.secret_scan(plain)) == n
    assert same(near_dedup.near_duplicates(clash), near_dedup.near_duplicates(plain)) == n
    assert same(toxicity.score(clash, machine), toxicity.score(plain, machine)) == n
    assert same(decontam.decontaminate(clash, more), decontam.decontaminate(plain, items)) == n
    assert same(license_scan.license_scan(clash), license_scan.license_scan(plain)) == n
    size = mixing.n_words(F.col("text"))
    mixed = mixing.weighted_fair_mix(clash, size)
    assert mixed.count() == n and {r.copies for r in mixed.where("size = 0").collect()} == {0}
    urls = spark.createDataFrame([(1, "http://a.org/fr/"), (1, "http://a.org/fr/"), (None, None)], "page_id long, url string")
    assert same(url_filter.url_filter(urls.select("*", *[F.lit("clash").alias(c) for c in CLASH])), url_filter.url_filter(urls)) == 3
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert same(chat_format.read_back(chat_format.format_chats(turns.select("*", *[F.lit("clash").alias(c) for c in CLASH]))), chat_format.read_back(chat_format.format_chats(turns))) == 2


def test_more_empty_tables(spark, docs_of):
    P = pytest.importorskip("public_tokenizers")
    assert token_counts.token_counts(docs_of([]), P.path("byte_bpe_50k.json")).count() == 0
    assert license_scan.license_scan(docs_of([])).count() == 0
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert chat_format.read_back(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_equal_rules_and_finish_times(docs_of):
    assert quality_cascade.order_rules([(0, 10), (0b111, 10)], [1.0, 1.0, 1.0])[0] == 0
    same_size = docs_of(["w w w"] * 40, ["a"] * 20 + ["b"] * 20)
    runs = [{(r.doc_id, r.taken) for r in mixing.weighted_fair_mix(same_size.repartition(k), mixing.n_words(F.col("text"))).collect()} for k in (1, 3)]
    assert runs[0] == runs[1] and sum(t for _, t in runs[0]) > 0


def test_long_texts_in_one_batch(spark):
    """Texts that together exceed a batch's bytes many times over."""
    df = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), "id", F.lit(" x ")), 20_000).alias("text"))
    got = near_dedup.near_duplicates(df).groupBy("n_shingles").agg(F.count("*"), F.min("component_id"), F.max("component_id")).collect()
    assert sum(r[1] for r in got) == 300
    assert toxicity.score(df, toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 300


def test_pipeline_stages_on_messy_and_empty_documents(spark, messy, tmp_path):
    import corpus_pipeline

    plain, clash = messy
    sf = str(tmp_path)
    spark.createDataFrame([("1", "one two three four five six seven eight")], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    n = plain.count()
    for docs in (plain, clash, clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialize(spark, stage(spark, docs, sf), f"messy-{name}")
            assert out.count() <= n
            if name != "mixing":
                assert out.columns == docs.columns
            if docs.isEmpty():
                assert out.isEmpty()
            elif name == "decontamination":
                assert out.count() == n - 2  # both rows that hold the item, whatever their ids
            elif name == "secret_scan":
                assert out.count() == n and out.where("text LIKE '%AKIA%'").isEmpty()
            elif name == "near_duplicates":
                # repeated texts under ids of their own give way, null ids all stay
                assert out.where("doc_id IS NULL").count() == plain.where("doc_id IS NULL").count() and out.count() < n


def test_bound_skips_no_unit_that_passes(spark):
    """The bound by one sum holds wherever the families' probability passes, for any weights."""
    n, dim = len(license_scan.FAMILIES), license_scan.DIM
    model, rng = random_model(n + 1, dim), random.Random(4)
    df = spark.createDataFrame([(sorted({rng.randrange(dim) for _ in range(rng.randint(0, 60))}),) for _ in range(400)], "idx array<int>")
    for least in (0.5, 0.9, 0.97):
        passes = 1.0 - F.get(license_scan.probabilities(model, F.col("idx")), F.lit(n)) >= least
        got = df.select(passes.alias("p"), license_scan.may_pass(model, least, F.col("idx")).alias("m")).collect()
        assert all(r.m for r in got if r.p) and any(r.p for r in got)
