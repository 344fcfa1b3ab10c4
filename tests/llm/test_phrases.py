"""Collocations, license scans and fill-in-the-middle against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from orrery.llm import collocations, fim, license_scan, queries
from tests.llm.conftest import sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = ["a", "b", "c", "dé", "New", "york", "times", "of", "the", "end"]
    rows = [(k, " ".join(rng.choices(words, [9, 7, 5, 3, 1, 1, 1, 6, 6, 1], k=40)) + ". New York times, of the end!\n\t one  two\tthree four five", ["en", None, "und", "de x"][k % 4]) for k in range(60)]
    return [*rows, (None, "New York times, of the end", "en"), (7, "", "en"), (7, None, None), (8, " .,\n", "zz")]


def brute(rows, least=10, share=50, top=2000):
    grams, sizes = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    grams[lang, tuple(w[i : i + k])] += 1
    found = []
    frequent = {g: a for g, a in grams.items() if len(g[1]) > 1 and a >= least}
    for (lang, w), a in frequent.items():
        if len(w) == 2 and any(x[0] == lang and len(x[1]) == 3 and w in (x[1][:2], x[1][1:]) and 100 * b >= share * a for x, b in frequent.items()):
            continue
        cuts = [(1000000 * a * a // (grams[lang, w[:k]] * grams[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(w).encode(), grams[lang, w[:k]], grams[lang, w[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def test_collocations_match_counts_of_all_phrases(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, phrase string, part int").repartition(5)
    for share, top in ((50, 2000), (90, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, share=share, top=top).collect())
        assert got == brute(rows, share=share, top=top)
    assert {r[0] for r in got} == {"en", "und", "de x"}


def test_collocations_of_nothing(spark, empty):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(empty.withColumn("text", empty["lang"])).collect() == []


def test_blocks_of_grams_do_not_depend_on_their_size(spark, monkeypatch):
    df = spark.createDataFrame([(k, sentence(k % 9, 30), "en") for k in range(200)], "doc_id long, text string, lang string").repartition(3)
    want = sorted(tuple(r) for r in collocations.collocations(df).collect())
    monkeypatch.setattr(collocations, "BLOCK", 2000)
    monkeypatch.setattr(collocations, "PART", 100)
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == want != []


def test_paths_without_branches_are_maximal(spark):
    texts = ["one two three four five six"] * 3 + ["zero two three four nine ten eleven"] * 2 + ["alone again now"] * 4 + ["p q p q p q p q"]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    edges, nodes, words, sizes = collocations.graph(df, least=1)
    got = {(r["phrase"], r["f"], r["edges"]) for r in collocations.paths(edges, nodes).collect()}
    assert got == {
        ("one two three", 3, 1), ("zero two three", 2, 1), ("two three four", 5, 1), ("three four five six", 3, 2), ("three four nine ten eleven", 2, 3),
        ("alone again now", 4, 1), ("p q p q", 3, 2),
    }
    assert {r["phrase"]: r["f"] for r in nodes.collect()}["three four"] == 5
    assert [r["n"] for r in sizes.collect()] == [3 * 6 + 2 * 7 + 4 * 3 + 8]
    assert {r["phrase"]: r["f"] for r in words.collect()}["p"] == 4


PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def scanned(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(label, i) for label, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for _, i in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for label, _ in at}))


LICENSED = [
    "Released under the MIT License. MIT\nlicense, mit-license; Apache License, Version 2.0",
    "CC BY-NC 4.0 / cc by cc by",
    "the GNU General Public License, version 3, or gnu general public licence; GNU GENERAL  PUBLIC\tLICENSE",
    "mit mit mit license license",
    "xmit license, mit license, apache2 license, ümit license",
    "(c) 2020. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "permission is hereby granted free of charge to any person; associated documentation files",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: all rights reserved",
    "license " * 5000 + "apache license",
]


def test_license_scan_finds_every_phrase(spark, docs):
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(LICENSED)], "doc_id long, text string")
    every = docs.unionByName(more, allowMissingColumns=True).withColumn("words", F.lit(1)).withColumn("matches", F.lit("x"))
    found = license_scan.digest(license_scan.scan(every)).collect()
    texts = [(r["doc_id"], r["text"]) for r in every.collect()]
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found))) == sorted(str((i, *scanned(t))) for i, t in texts)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in found}
    assert labels[100] == ("apache,apache-2.0,mit", 1.0) and labels[101][0] == "cc-by,cc-by-nc" and labels[102][0] == "gpl,gpl-3.0"
    assert labels[104] == ("mit" if scanned(LICENSED[4])[4] else "", labels[104][1]) and labels[105][0] == "mit" and 0.5 < labels[105][1] <= 1
    assert labels[106] == ("", 0.0) and labels[107][0] == "bsd,rights-reserved" and labels[108][0] == "apache"
    assert labels[3] == ("", 0.0) and labels[4] == ("", 0.0)


def test_license_scan_of_nothing(spark, empty):
    assert license_scan.digest(license_scan.scan(empty)).collect() == []


def test_boundary_sets_select_from_every_container():
    rng = np.random.default_rng(3)
    for values in (
        np.arange(200_000), np.arange(0, 400_000, 2), np.sort(rng.choice(300_000, 900, replace=False)), np.array([5]), np.zeros(0, np.int64),
        np.concatenate([np.arange(70_000), np.arange(1_000_000, 1_300_000, 3), np.arange(2_000_000, 2_000_009)]),
    ):
        bounds = fim.Boundaries(values)
        assert len(bounds) == len(values)
        for k in sorted({0, len(values) - 1, *rng.integers(0, max(1, len(values)), 300).tolist()} & set(range(len(values)))):
            assert bounds.select(k) == values[k]
        with pytest.raises(IndexError):
            bounds.select(len(values))
    kinds = {type(c).__name__ for c in fim.Boundaries(np.concatenate([np.arange(70_000), np.arange(131_072, 196_608, 2), np.arange(200_000, 262_144, 97)])).containers}
    assert kinds == {"_Runs", "_Bitmap", "_Array"}


def cut(doc_id, text):
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def test_fill_in_middle(spark, docs):
    odd = [(500 + k, t) for k, t in enumerate(["a<P>b", "x <M", "<S", "\U0001f600é́ ab\tC\r\n" * 9, "z" * 100_000 + "1 " * 70_000, "<", "a"])] + [(k, f"text {k} of several, 'quoted'") for k in range(1000, 1080)]
    every = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"] or "") for r in every.collect()]
    found = fim.transform(every)
    got = found.withColumn("restored", fim.restored(found["output"], found["form"])).collect()
    assert sorted(map(str, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got))) == sorted(str((i, *cut(i, t), t)) for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    placed = fim.in_place(every)
    assert placed.columns == every.columns and placed.schema == every.schema
    assert sorted(str((r["doc_id"], r["text"] or "")) for r in placed.collect()) == sorted(str((i, cut(i, t)[4])) for i, t in rows)


def test_fill_in_middle_of_nothing(empty):
    assert fim.transform(empty).collect() == [] and fim.in_place(empty).collect() == []


def test_queries_give_digests_of_whole_tables(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = queries.op13_fill_in_middle(spark, str(tmp_path)).collect()
    assert sorted(str((r["doc_id"], r["output_sha256"], r["restored_sha256"])) for r in got) == sorted(
        str((i, hashlib.sha256(cut(i, t)[4].encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())) for i, t in rows
    )
    assert queries.op12_license_scan(spark, str(tmp_path)).count() == len(rows)
    texts = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in queries.op11_collocations(spark, str(tmp_path)).collect()) == brute(texts)


def test_a_licence_text_that_every_file_has_is_found(spark):
    from orrery.llm import license_scan

    mit = next(t for t in license_scan.TEMPLATES if t.label == "mit")
    rows = [(k, f"file {k} {mit.text} end") for k in range(60)]  # all of its words are in more than a twentieth of the files
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).collect()
    starts = [[m["start"] for m in r["matches"] if m["label"] == "mit"] for r in found]
    assert len(starts) == 60 and all(s == [2] for s in starts)


def test_word_counts_get_more_tasks_with_more_text(spark, tmp_path, monkeypatch):
    from orrery.plans import model_queries

    rows = [(k % 50, f"one two two {'w' * (k % 7 + 1)}") for k in range(100)] + [(None, "one"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(model_queries, "BAG_BYTES", 100)
    bag = model_queries.bag_of_words(spark, str(tmp_path))
    assert bag.rdd.getNumPartitions() > 10
    want = {}
    for doc, text in rows:
        for w in (text or "").split():
            want[doc, w] = want.get((doc, w), 0) + 1
    assert {(r["doc_id"], r["word"]): r["n"] for r in bag.collect()} == want


def test_a_scan_leaves_no_licence_text_out_unless_told_to(spark):
    mit = next(t for t in license_scan.TEMPLATES if t.label == "mit" and t.keys)
    df = spark.createDataFrame([(k, f"file {k} {mit.text} end") for k in range(60)], "doc_id long, text string")
    for options, want in (({}, [2]), ({"exact": False}, [])):
        found = license_scan.scan(df, **options).collect()
        assert all([m["start"] for m in r["matches"] if m["label"] == "mit"] == want for r in found)
