"""The training-data operators against brute force, and on the defined edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat_format, common, decontam, entries, license_scan, mixing, near_dedup, quality_cascade, secret_scan, token_counts, toxicity, url_filter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_counts(docs_of, odd):
    got = by_id(quality_cascade.quality_cascade(docs_of(odd)))
    for i, t in enumerate(odd):
        w = WORDS.findall(t or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hot = {p + j for p in range(len(w) - 2) if c[tuple(w[p : p + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(hot), len(lines) - len(set(lines)))
    assert not got[0].kept and got[3].kept and not got[6].kept


def test_cascade_order():
    # rule 1 is cheap and rejects most; rule 2 rejects only what rule 1 rejects
    assert quality_cascade.order_rules([(0, 50), (0b110, 40), (0b001, 10)], [10.0, 1.0, 1.0]) == [1, 0, 2]


def test_token_counts_match_the_library(docs_of, odd):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    rng = random.Random(1)
    texts = [*odd, "aaaaaaaaa" * 50, "<|endoftext|> a<|endoftext|><|endoftext|>", "".join(chr(rng.choice([32, 97, 98, 233, 0x4E2D, 0x1F600, 10, 39])) for _ in range(3000)), "I'll we've 123  456\r\n\t x"]
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = by_id(token_counts.token_counts(docs_of(texts), P.path("byte_bpe_50k.json")))
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(lib.encode(t or "", add_special_tokens=False).ids), repr(t)[:60]
        assert got[i].n_bytes == len((t or "").encode())


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s> [\\INST]", "", None, "a\n</s>\n<s>user\nb", "é" * 10]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["user", "assistant", "assistant", "tool\n<s>", "assistant", None], said, strict=True))]
    rows += [(7, 0, "assistant", "same"), (7, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df)
    for r in out.collect():
        want = [(b or "", c or "") for a, t, b, c in rows if a == r["conv_id"]]
        assert chat_format.parse(r["formatted"]) == want
    got = {r["conv_id"]: r for r in chat_format.read_back(out).collect()}
    for c in (1, 2, None, 7):
        own = [(b or "", x or "") for a, t, b, x in rows if a == c]
        loss = "".join(x for b, x in own if b == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{b}\n{x}\n" for b, x in own).encode()).hexdigest()


def test_long_conversations_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK_BYTES", 300)
    df = spark.range(200).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    assert chat_format.read_back(chat_format.format_chats(df)).first()["loss_sha256"] == hashlib.sha256("".join(f"t{i}" for i in range(200)).encode()).hexdigest()


def test_url_rules(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://EXAMPLE.net/de/": ("example.net", "/de/", "net/", "block"),
        "https://x.example.com/de/a?b#c": ("x.example.com", "/de/a", "example.com/de/", "block"),
        "http://foo.org/fr/": ("foo.org", "/fr/", "org/fr/", "allow"),
        "http://foo.net?x=/": ("foo.net", "", None, None),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "https://best-casino-bets.example.com/en/1": ("best-casino-bets.example.com", "/en/1", None, "block"),
        "https://www.the-garden-library.example.com/en/1": ("www.the-garden-library.example.com", "/en/1", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.url_filter(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict


def test_mixing(docs_of, odd):
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.randint(0, 40)) for _ in range(600)]
    sources = [rng.choice(["a", "a", "a", "b", "c", None, "d"]) for _ in texts]
    d = docs_of(texts, sources)
    out = mixing.weighted_fair_mix(d, mixing.n_words(F.col("text"))).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    order = sorted(size, key=lambda s: (s is None, s))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(size.values())
    capped = set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * weight[s] > 3 * size[s]}
        if not new:
            break
        capped |= new
    for s in order:
        assert abs(target[s] - (3 * size[s] if s in capped else level * weight[s])) < 1e-6
        assert abs(taken[s] - target[s]) <= 80
    again = mixing.weighted_fair_mix(d.repartition(7), mixing.n_words(F.col("text"))).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}
    assert all(r.taken == 0 for r in mixing.weighted_fair_mix(docs_of([None, ""]), mixing.n_words(F.col("text"))).collect())


def test_secret_spans(docs_of):
    key = "AKIA" + "A1B2" * 4
    blob = "abcD1" * 8
    texts = [
        f'é token = "{"ab12" * 10}" x', f"{key} and {blob}\n\n{blob}", "password: token: abcdefgh", "Secret=short api-key:123456789 API_KEY:123456789",
        f"user=bob https://h.example/x\n{key}\n{'0f' * 20}", f"user=bob https://h.example/x {blob[:-1]}", None, "", "f" * 31 + " " + "f" * 32,
    ]
    rx = {"assign": r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"()AKIA[A-Z0-9]+", "hex": r"()[0-9a-f]+"}
    least = {"assign": 8, "access": 16, "hex": 32}
    got = by_id(secret_scan.secret_scan(docs_of(texts)).select("doc_id", secret_scan.as_text(F.col("parts")).alias("s")))
    for i, t in enumerate(texts):
        base = []
        for k, (name, p) in enumerate(rx.items()):
            for m in re.finditer(p, t or "", re.IGNORECASE | re.ASCII if name == "assign" else 0):
                if len(m[1] if name == "assign" else m[0]) >= least[name]:
                    base.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
        have = got[i].s.split(",") if got[i].s else []
        assert [x for x in have if x.split(":")[0] in rx] == [x[2] for x in sorted(base)]
    assert "blob:25:65" in got[1].s and got[1].s.count("blob") == 1  # the second one stands in another block
    assert "account" in got[4].s and "endpoint" in got[4].s and got[5].s == ""
    masked = by_id(docs_of(texts).withColumn("p", secret_scan.find_secrets(F.coalesce("text", F.lit("")))).select("doc_id", secret_scan.mask_secrets(F.col("text"), F.col("p")).alias("m")))
    assert key not in masked[1].m and masked[6].m is None and masked[5].m == texts[5]


def test_secret_links_equal_the_sql(docs_of):
    """Overlapping, nested and distant parts in random layouts, and a text of many parts."""
    import duckdb
    import pandas as pd

    rng = random.Random(7)
    pieces = ["token=", "g" * 10, "0af1" * 8, "-" * 120, " " * 50, "user=bob99", "\n\n", "\n", "AKIA" + "A1B2" * 4, "abcD1" * 8, "https://h.example/x", "client_id: abc", " ", "secret: ", "x" * 200, '"', "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 25))) for _ in range(300)]
    texts += ["token=" + "g" * 10 + "0af1" * 8 + "-" * 500 + " " * 50 + "user=bob99", "\n".join(["0af1" * 8, "user=bob99"] * 400), None, ""]
    got = docs_of(texts).select("doc_id", secret_scan.as_text(secret_scan.find_secrets(F.coalesce("text", F.lit("")))).alias("spans"))
    have = {r.doc_id: r.spans for r in got.collect()}
    db = duckdb.connect()
    db.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype=object)}))
    want = dict(db.execute(f"SELECT doc_id, spans FROM ({secret_scan.OP6_SQL})").fetchall())
    assert have == want
    assert "account:598:608" in have[300] and have[301].count("account") == 400


def jaccard_components(texts, k):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        m = min(k, len(w))
        sets.append({tuple(w[j : j + m]) for j in range(len(w) - m + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_match_brute_force(docs_of, odd):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(500)]
    texts = list(odd) + ["one", "ONE", "one two", "one two three four five", "one two three four"]
    for _ in range(12):  # families with ever more edits, so that links chain
        w = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(12):
            texts.append(" ".join(w))
            for _ in range(rng.randint(0, 2)):
                w = list(w)
                w[rng.randrange(len(w))] = rng.choice(vocab)
    want, sizes = jaccard_components(texts, 4)
    got = by_id(near_dedup.near_duplicates(docs_of(texts), shingle=4))
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_a_large_group_around_one_text_loses_no_link(docs_of):
    """Many texts beside the similarity to one centre, some of which are linked only with each other."""
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    centre = [rng.choice(vocab) for _ in range(90)]
    texts = []
    for _ in range(60):
        w = list(centre)
        for _ in range(rng.randint(2, 9)):
            at, kind = rng.randrange(len(w)), rng.randrange(4)
            w[at : at + (kind < 3)] = [] if kind == 2 else [rng.choice(vocab[:20])]
        for _ in range(3):
            texts.append(" ".join(w))
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(vocab)
    texts += [" ".join(centre[20:70] + [rng.choice(vocab) for _ in range(rng.randint(5, 40))]) for _ in range(60)]
    want, _ = jaccard_components(texts, 4)
    got = by_id(near_dedup.near_duplicates(docs_of(texts), shingle=4))
    assert [got[i].component_id for i in range(len(texts))] == want
    assert 1 < len(set(want)) < len(want)


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    edges, least = [], {}
    for first, n in ((0, 1000), (1000, 2), (1002, 300)):
        ids = list(range(first, first + n))
        if n == 1000:
            rng.shuffle(ids)
        edges += [tuple(rng.sample(e, 2)) for e in zip(ids, ids[1:], strict=False)]
        least |= dict.fromkeys(ids, first)
    got = near_dedup.components(spark, spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["comp"] for r in got.collect()} == least
    assert near_dedup.components(spark, spark.createDataFrame([], "a long, b long")) is None
    with pytest.raises(RuntimeError):
        near_dedup.components(spark, spark.createDataFrame(edges, "a long, b long"), most_rounds=1)


def test_a_chain_of_near_copies_is_one_group(docs_of):
    # each text is similar to its neighbours in the chain only: 88 of 104 shingles, then 80 of 112
    texts = [" ".join(f"v{i}" for i in range(8 * k, 8 * k + 100)) for k in range(300)]
    random.Random(5).shuffle(texts)
    got = by_id(near_dedup.near_duplicates(docs_of(texts)))
    assert {r.component_id for r in got.values()} == {0} and [i for i, r in got.items() if r.kept] == [0]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a), (2, b + " more"), (3, a), (None, a), (None, None), (4, None), (5, "c " + b), (5, "d e f")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    have = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
    want = [(1, 57, 1, True)] * 3 + [(2, 58, 1, False), (3, 57, 1, False), (None, 57, None, True), (None, 0, None, True), (4, 0, 4, True), (5, 58, 1, False), (5, 1, 5, True)]
    assert have == sorted(want, key=str)


def test_groups_that_share_an_element_beyond_the_pairwise_bound(docs_of, monkeypatch):
    """Groups larger than the bound become buckets again; the result is that of brute force."""
    monkeypatch.setattr(near_dedup, "MOST", 1)
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(200)]
    core = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for k in range(6):  # six rewritings of one text, each with its own near copies
        own = core[:45] + [f"o{k}_{j}" for j in range(20)]
        for _ in range(12):
            w = list(own)
            w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    want, _ = jaccard_components(texts, 4)
    got = by_id(near_dedup.near_duplicates(docs_of(texts), shingle=4))
    assert [got[i].component_id for i in range(len(texts))] == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.r_[a[:50], rng.integers(0, 2**63, 10).astype(np.uint64) * np.uint64(2)])
    same = [(near_dedup.signature(near_dedup._mix(a + np.uint64(s))[np.argsort(near_dedup._mix(a + np.uint64(s)))]) == near_dedup.signature(np.sort(near_dedup._mix(b + np.uint64(s))))).mean() for s in range(1, 40)]
    assert abs(np.mean(same) - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.05


def test_decontamination_matches_brute_force(spark, docs_of, odd):
    rng = random.Random(4)
    vocab = [f"k{i}" for i in range(40)]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (1, 3, 7, 8, 9, 20, 50)] + [None, "", "...", "É ä Ö one two three four five six"]
    texts = list(odd)
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        src = (rng.choice(items[:7]) or "").upper().split()
        a = rng.randrange(len(src))
        texts.append(", ".join(w[:20] + src[a : a + rng.randint(1, 14)] + w[20:]))
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans(common.UPPER, common.LOWER)
    words = lambda t: rx.findall((t or "").translate(low))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = by_id(decontam.decontaminate(docs_of(texts), bench))
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for k, item in enumerate(items):
            v = words(item)
            n = min(8, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    found.add(str(k))
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(found))


def test_toxicity_learns_pairs(spark, docs_of):
    rng = random.Random(5)
    vocab = [f"n{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(1500):
        w = [rng.choice(vocab) for _ in range(15)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["insult"] * a + ["group"] * b
        texts.append(" ".join(w))
        labels.append((i, int(a and b)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    d = docs_of(texts)
    got = by_id(toxicity.score(d, toxicity.fit(d, lab)))
    held = [i for i in range(1500) if got[i].held_out]
    assert 200 < len(held) < 400
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.85
    empty = by_id(toxicity.score(docs_of([None, ""]), toxicity.fit(d, lab.where("toxic = 0"))))
    assert 0 <= empty[0].score <= 1 and empty[0].score == empty[1].score


def test_toxicity_pairs_learn_what_an_additive_model_cannot():
    """Exclusive or of two terms among others: the sum of term weights says nothing, their product does."""
    rng = np.random.default_rng(1)

    def rows(n):
        idx, y = [], []
        for _ in range(n):
            a, b = rng.random(2) < 0.5
            idx.append(np.unique([*(rng.integers(0, 300, 15) + 10), *[1] * int(a), *[2] * int(b)]))
            y.append(float(a != b))
        return np.concatenate(idx), np.r_[0, np.cumsum([len(x) for x in idx])], np.array(y)

    idx, off, y = rows(3000)
    machine = toxicity.train(idx, off, y, toxicity.Params())
    idx, off, y = rows(1000)
    assert np.mean((machine.margins(idx, off) >= 0) == (y > 0)) > 0.75
    # the second-order term is the sum over pairs
    one, x = idx[: off[1]], 1 / np.sqrt(off[1])
    pairs = sum(machine.factor[i] @ machine.factor[j] for k, i in enumerate(one) for j in one[:k]) * x * x
    assert abs(machine.bias + machine.linear[one].sum() * x + pairs - machine.margins(one, off[:2])[0]) < 1e-4


def test_toxicity_cut_is_the_one_of_greatest_f1():
    rng = np.random.default_rng(2)
    for n, places in [(1, 1), (2, 1), (40, 1), (200, 3), (200, 0), (50, 2)]:
        m, y = rng.normal(0, 2, n).round(places), (rng.random(n) < 0.3).astype(float)
        y[0] = 1
        cut = toxicity.best_cut(m, y)
        f1 = lambda c: 2 * y[m >= c].sum() / (y.sum() + (m >= c).sum())
        halves = [(a + b) / 2 for a, b in zip(sorted(set(m)), sorted(set(m))[1:])]
        assert f1(cut) >= max(map(f1, halves), default=0) - 1e-9
        assert cut in halves or (not halves and cut == 0)


def test_toxicity_is_calibrated_on_rows_kept_aside():
    """Rare label 1 with a mark that a tenth of the others carries as well: the cut moves, and few labels move nothing."""
    rng = np.random.default_rng(3)

    def rows(n):
        y = (rng.random(n) < 0.1).astype(float)
        idx = [np.unique([*(rng.integers(0, 200, 20) + 10), *[1] * int(t or rng.random() < 0.1), *[2] * int(t and rng.random() < 0.8)]) for t in y]
        return np.concatenate(idx), np.r_[0, np.cumsum([len(x) for x in idx])], y

    p = toxicity.Params()
    idx, off, y = rows(4000)
    plain, moved = toxicity.train(idx, off, y, p), toxicity.calibrated(idx, off, y, p)
    assert moved.bias != plain.bias and (moved.linear == plain.linear).all() and (moved.factor == plain.factor).all()
    idx, off, y = rows(4000)

    def f1(machine):
        hit = machine.margins(idx, off) >= 0
        return 2 * y[hit].sum() / (y.sum() + hit.sum())

    assert f1(moved) >= f1(plain) - 0.02 and f1(moved) > 0.8
    idx, off, y = rows(300)
    assert toxicity.calibrated(idx, off, y, p).bias == toxicity.train(idx, off, y, p).bias


def test_license_families(docs_of, odd):
    texts = ["ble thntre.\nLicensed under the Apache License, Version 2.0.\nend", "The fishing license costs 2.0", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "word " * 200 + "This work is licensed under the GNU General Public License, version 3."]
    df = license_scan.license_scan(docs_of([*texts, *odd]))
    sure = {r.doc_id: sorted({x.family for x in r.found if x.confirmed}) for r in df.collect()}
    assert sure[0] == ["Apache-2.0"] and sure[1] == [] and sure[2] == ["CC-BY-NC-4.0", "MIT"] and sure[3] == ["GPL"]
    assert all(sure[i] == [] for i in range(4, 4 + len(odd)))


def test_wrapped_licenses(docs_of):
    import textwrap

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    prose = " ".join(f"Plain sentence number {i} of this story." for i in range(30))
    marks = ["", "# ", " * ", "// ", "dnl ", "REM "]
    texts, want = [], []
    for family, text in (("MIT", mit), ("BSD", bsd), ("GPL", gpl), (None, prose)):
        for k, width in enumerate((60, 66, 70, 72, 76, 80)):
            lines = [marks[k] + x for x in textwrap.wrap(text, width)]
            head = [marks[k] + "Copyright (c) 2019 The Authors", marks[k].rstrip() if k < 4 else ""]
            texts.append("\n".join([*head, *lines, marks[k].rstrip() if k < 4 else "", marks[k] + "int main"]))
            want.append([family] if family else [])
    df = license_scan.license_scan(docs_of(texts))
    sure = {r.doc_id: sorted({x.family for x in r.found if x.confirmed}) for r in df.collect()}
    assert [sure[i] for i in range(len(texts))] == want


def test_empty_tables(spark, docs_of):
    d = docs_of([])
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([(0, "a b c d e f g h i")], "item_id long, text string")
    assert quality_cascade.quality_cascade(d).count() == 0
    assert near_dedup.near_duplicates(d).count() == 0
    assert mixing.weighted_fair_mix(d, mixing.n_words(F.col("text"))).count() == 0
    assert toxicity.score(d, toxicity.fit(d, lab)).count() == 0
    assert decontam.decontaminate(d, items).count() == 0
    assert decontam.decontaminate(docs_of(["a b c d e f g h i"]), items.limit(0)).first()["n_hit"] == 0
    assert secret_scan.secret_scan(d).count() == 0


def test_pipeline_keeps_what_holds_short_items(spark, docs_of, tmp_path):
    import corpus_pipeline

    items = [(0, "the"), (1, "a b c d e f g"), (2, "one two three four five six seven eight nine")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of(["the story", "x a b c d e f g y", "so two three four five six seven eight nine"])
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 1]


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    have = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(spark, stage(spark, docs, sf), f"test-{name}")
        if name != "mixing":
            assert out.columns == docs.columns and 0 < out.count() <= have
            have = out.count()
            docs = out
        else:
            assert out.where("copies < 1").count() == 0 and out.count() > 0
    assert set(entries.ORACLES) <= set(entries.QUERIES)
