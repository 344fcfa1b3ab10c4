"""Every operator on a table with nulls, empty and very long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import pathlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from orrery.llm import bpe, common, exact_dedup, fingerprints, graph, hashing, lm_score, mixing, near_dedup, packing, quality, substring_dedup, url_filter, warc

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def rank(doc_id):
    return (doc_id is None, doc_id or 0)


def test_exact_groups(docs, empty):
    rows = exact_dedup.exact_groups(docs).collect()
    groups = collections.defaultdict(list)
    for doc_id, text in table(docs):
        groups[SPACE.sub(" ", text or "")].append(doc_id)
    assert len(rows) == sum(map(len, groups.values()))
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = collections.Counter()
    for r in rows:
        ids = by_digest[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min(ids, key=rank)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_keeps_columns(docs, empty):
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    texts = [SPACE.sub(" ", r["text"] or "") for r in out.collect()]
    assert sorted(texts) == sorted({SPACE.sub(" ", t or "") for _, t in table(docs)})
    assert exact_dedup.exact_dedup(empty).count() == 0


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def components(sets, percent=80):
    n = len(sets)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(docs, width):
    data = table(docs)
    sets = [shingles(t, width) for _, t in data]
    comp = components(sets)
    least = {}
    for (doc_id, _), c in zip(data, comp, strict=True):
        least[c] = min(least.get(c, (True, 0)), rank(doc_id))
    want = sorted(((i is None, i or 0), len(s), None if least[c][0] else least[c][1]) for (i, _), s, c in zip(data, sets, comp, strict=True))
    rows = near_dedup.near_groups(docs, width=width).collect()
    got = sorted((rank(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in rows)
    assert repr(got) == repr(want)
    assert sum(r["first"] for r in rows) == len(set(comp))


def test_near_groups_of_many_copies(spark):
    """A crowd of near copies around one text, a few farther off, against brute force."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(150):
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 9), replace=False):
            w[at] = f"x{rng.integers(40)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 2) for t in texts]
    comp = components(sets)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df, width=2).collect()}
    assert [got[k] for k in range(150)] == comp


def test_near_dedup_keeps_one(docs, empty):
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    sets = [shingles(t, 5) for _, t in table(docs)]
    assert out.count() == len(set(components(sets)))
    assert near_dedup.near_dedup(empty).count() == 0


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    pool = hashing.mix(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = pool[:2000], pool[400:2400]
    x, y = near_dedup.sketch(a), near_dedup.sketch(b)
    j = near_dedup.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 1600 / 2400) < 0.08
    assert (np.maximum(x, y) == near_dedup.sketch(pool[:2400])).all()


def test_components(spark):
    links = [(1, 2), (3, 2), (7, 8), (8, 9), (9, 10), (10, 11), (5, 5)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a int, b int")).collect()))
    assert all(got.get(k, k) == 1 for k in (1, 2, 3)) and all(got.get(k, k) == 7 for k in (7, 8, 9, 10, 11))
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_bpe(docs, empty):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect())
    assert got == collections.Counter((i, tuple(coder.encode_ordinary(t or ""))) for i, t in table(docs))
    back = collections.Counter((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(encoded, RANKS).collect())
    assert back == collections.Counter((i, (t or "").encode()) for i, t in table(docs))
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_blocks_do_not_depend_on_order(spark, monkeypatch):
    """What a task makes of its rows when it is run again is the same, in whatever order they come."""
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    rows = [(i % 17 if i % 5 else None, f"some words {i % 7} and more" if i % 3 else None) for i in range(60)]
    turned = [spark.createDataFrame(r, "doc_id long, text string").coalesce(1) for r in (rows, rows[::-1], rows[30:] + rows[:30])]
    encoded = [sorted(map(repr, bpe.encode(d, RANKS, public_tokenizers.PATTERN, parts=3).collect())) for d in turned]
    assert encoded[0] == encoded[1] == encoded[2]
    blocks = bpe._blocks(public_tokenizers.PATTERN, 3, 50)
    made = []
    for d in turned:
        found = bpe.in_one_order(d).mapInArrow(blocks, "k binary, block binary, data binary").collect()
        made.append(sorted((bytes(r["k"]), bytes(r["block"]), bytes(r["data"])) for r in found))
    assert made[0] == made[1] == made[2] and len({b for _, b, _ in made[0]}) > 3


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_splitting_agrees_with_the_library(text):
    coder = _coder()
    pieces = _split()(text)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


def _coder(cache=[]):  # noqa: B006
    if not cache:
        cache.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}))
    return cache[0]


def _split(cache=[]):  # noqa: B006
    if not cache:
        cache.append(bpe.Splitter(public_tokenizers.PATTERN))
    return cache[0]


@given(st.lists(st.integers(0, 2**40)), st.lists(st.binary(max_size=9)))
def test_packing(codes, strings):
    assert packing.unpack_codes(packing.pack_codes(np.array(codes, dtype=np.int64))).tolist() == codes
    assert packing.unpack_strings(*packing.pack_strings(strings)) == strings
    assert packing.unsqueeze(packing.squeeze(*strings)) == strings


def test_word_hashes_depend_on_words_alone(monkeypatch):
    texts = ["Ab  cd\tef", "", None, "xab", "AB cd EF " * 50]
    h, at = hashing.word_hashes(texts)
    assert np.diff(at).tolist() == [3, 0, 0, 1, 150]
    assert (h[:3] == h[4:7]).all() and h[3] != h[0]
    monkeypatch.setattr(hashing, "STEP", 16)
    g, to = hashing.word_hashes(texts)
    assert (g == h).all() and (to == at).all()


def test_lm_base_score_and_counts(docs, empty):
    data = table(docs)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in data}
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), ""]) for i, t in data]
    c = collections.Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((rank(i), len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens)
    rows = lm_score.score(docs, common.crc_mod("doc_id", 7) == 2).collect()
    got = sorted((rank(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"]) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert {r["train_tokens"] for r in rows} == {n}
    assert all(r["score"] < 0 for r in rows)
    assert lm_score.score(empty, F.lit(False)).count() == 0


def test_lm_is_context_tree_weighting(spark):
    """Scores against the recursive definition, and probabilities that sum to one."""
    depth, train, ask = 3, ["abracadabra", "abba", "ba"], ["abra", "x", "", "bab"]
    df = spark.createDataFrame([(k, t, k >= len(train)) for k, t in enumerate(train + ask)], "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, F.col("held"), depth=depth).collect()}
    count, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def decisions(text):
        b = b"\xff" * depth + text.encode() + b"\xff"
        for k in range(depth, len(b)):
            for q in range(8):
                yield b[k - depth : k], (1 << q) | (b[k] >> (8 - q)), (b[k] >> (7 - q)) & 1

    for t in train:
        for context, node, bit in decisions(t):
            for d in range(depth + 1):
                s = context[depth - d :]
                count[s, node][bit] += 1
                if d:
                    kids[s[1:], node].add(s)

    def kt(s):
        a, b = count.get(s, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(s):
        if len(s[0]) == depth:
            return kt(s)
        return np.logaddexp(kt(s), sum(weighted((z, s[1])) for z in kids.get(s, ()))) - math.log(2)

    def one(context, node):
        p = None
        for d in range(depth, -1, -1):
            s = context[depth - d :], node
            a, b = count.get(s, (0, 0))
            q = (b + 0.5) / (a + b + 1)
            stay = 1 if d == depth else math.exp(kt(s) - math.log(2) - weighted(s))
            p = q if p is None else stay * q + (1 - stay) * p
        return p

    for k, t in enumerate(train + ask):
        want = sum(math.log10(one(c, n) if bit else 1 - one(c, n)) for c, n, bit in decisions(t))
        assert got[k] == pytest.approx(want, rel=1e-5)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10.5, 1e3, 1e9])
    assert np.allclose(lm_score.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_mix(docs, empty):
    rows = mixing.Mix(docs, block=4).documents().collect()
    data = [(i, len(WORD.findall(t or ""))) for i, t in table(docs)]
    assert sorted((rank(r["doc_id"]), r["size"]) for r in rows) == sorted((rank(i), n) for i, n in data)
    sums = collections.defaultdict(int)
    for r in rows:
        sums[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = {r["source"]: r["target"] for r in rows}
    assert sum(target.values()) == pytest.approx(sum(n for _, n in data))
    for s, t in target.items():
        assert abs(sums[s] - t) <= 8
    key = lambda r: (rank(r["doc_id"]), r["size"], r["taken"])
    again = mixing.Mix(docs.repartition(5), block=4).documents().collect()
    assert sorted(map(key, again)) == sorted(map(key, rows))
    out = mixing.mixed_documents(docs, block=4)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == sum(sums.values())
    assert mixing.Mix(empty).documents().count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_targets():
    t = mixing.targets(np.array([10.0, 100, 100, 0]), np.array([5.0, 2, 1, 5]), 210, 3)
    assert t[0] == 30 and t[3] == 0 and t[1:3].tolist() == pytest.approx([120, 60])


@given(st.integers(1, 3000), st.integers(0, 2**31))
@settings(max_examples=40, deadline=None)
def test_permutation(size, key):
    x = np.arange(size)
    assert sorted(mixing.permute(x, np.full(size, size), np.full(size, key)).tolist()) == x.tolist()


def pages(spark):
    big = "<p>" + "x" * 2000 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a/", big), (5, "http://b/ü x\n", big), (3, None, big), (4, "u", "small"), (6, "u", "small"), (7, "v", None), (8, "v", ""), (None, "w", big), (9, "é", "é" * 600), (10, "é", "é" * 600), (10, "é", "é" * 600)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, value string")


def test_warc(spark, tmp_path):
    df = pages(spark)
    warc.write(df, str(tmp_path / "z"))
    assert warc.read(spark, str(tmp_path / "z")).count() == df.count()
    warc.write(df, str(tmp_path / "w"), records_per_file=3, compression="none")
    archive = warc.read(spark, str(tmp_path / "w"))
    full = warc.reconstruct(warc.headers(archive), warc.payloads(archive)).collect()
    data = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    key = lambda i, p: (rank(i), p)
    assert sorted(key(r["page_id"], bytes(r["payload"])) for r in full) == sorted(key(*d) for d in data)
    holder = {}
    for i, p in data:
        if len(p) >= 1000:
            holder[p] = max(holder.get(p, -1), i if i is not None else -1)
    for r in full:
        p = bytes(r["payload"])
        assert r["valid"] and r["sha1"] == hashlib.sha1(p).hexdigest()
        revisit = len(p) >= 1000 and r["page_id"] != holder[p]
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert (r["refers_to"].split(":")[2] == str(holder[p])) if revisit else r["refers_to"] is None
        assert bytes(r["header"]).startswith(b"WARC/1.1\r\n") and bytes(r["header"]).endswith(b"\r\n\r\n")
    assert warc.payloads(archive).count() == len({p for _, p in data})
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*")))
    assert len(list(warc.parse(raw))) == len(data)
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Long payloads share their files with fewer others, and all come back, copies as revisits too."""
    monkeypatch.setattr(warc, "SHORT", 1000)
    sizes = [10] * 40 + [1000, 1001, 7000, 7000, 8001] + [60_000] * 3 + [70_000]
    rows = [(i, f"http://a/{i}", ("ab"[i % 2] if n == 7000 else "c") * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"), records_per_file=16, compression="none")
    files = [[len(x[2]) for x in warc.parse(f.read_bytes())] for f in (tmp_path / "w").glob("part-*")]
    assert sum(map(len, files)) == len(rows)
    for f in files:
        assert len({sum(n > b for b in (1000, 8000, 64_000)) for n in f if n}) <= 1
        assert len(f) <= (16 if max(f) <= 1000 else 2 if max(f) <= 8000 else 1) or not max(f)
    archive = warc.read(spark, str(tmp_path / "w"))
    full = warc.reconstruct(warc.headers(archive), warc.payloads(archive)).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in full) == sorted((i, t) for i, _, t in rows)
    assert {r["page_id"] for r in full if r["record_type"] == "revisit"} == {45, 46}
    with pytest.raises(AnalysisException):
        warc.write(df, str(tmp_path / "w"))


def test_fingerprints(docs, empty):
    data = sorted(table(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    rows = fingerprints.compare_with_edits(docs).collect()
    want = []
    for k, (i, t) in enumerate(data):
        t, n = t or "", data[(k + 1) % len(data)][1] or ""
        want.append((rank(i), len(t), hashlib.sha256(fingerprints.edit(t, n).encode()).hexdigest()))
    assert sorted((rank(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    prints = dict(zip((t or "" for _, t in data), fingerprints.of_texts([t for _, t in data]), strict=True))
    assert prints[""] == prints[" \t\n "] == 0
    for r in rows:
        assert int(r["fingerprint"], 16) in prints.values()
        assert r["near_edited"] == 1 - (int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).bit_count() / 64
    assert fingerprints.compare_with_edits(empty).count() == 0
    assert fingerprints.compare_with_edits(docs.filter("doc_id = 13")).first()["near_next"] == 1.0


def test_fingerprint_search(spark):
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    for v in values[:20]:
        for n in (1, 2, 3, 4):
            w = v
            for b in rng.choice(64, n, replace=False):
                w ^= 1 << int(b)
            values.append(w)
    df = spark.createDataFrame([(f"{v:016x}",) for v in values] + [(None,)], "fingerprint string")
    queries = df.limit(30)
    asked = {int(r[0], 16) for r in queries.collect() if r[0]}
    got = {(int(r["query"], 16), int(r["match"], 16), r["distance"]) for r in fingerprints.search(queries, df, 3).collect()}
    assert got == {(q, v, (q ^ v).bit_count()) for q in asked for v in set(values) if (q ^ v).bit_count() <= 3}


def test_substring_dedup(docs, empty):
    """Against a walk through all units in rank order (repeats of one id are all held by document 8)."""
    data = sorted(((i, t or "") for i, t in table(docs)), key=lambda r: rank(r[0]))
    first, count = {}, collections.Counter()
    for n, (_, t) in enumerate(data):
        for s, _, d in substring_dedup.units(t):
            first.setdefault(d, (n, s))
            count[d] += 1
    want = collections.Counter()
    for n, (i, t) in enumerate(data):
        spans = [(s, e, first[d] == (n, s)) for s, e, d in substring_dedup.units(t) if count[d] > 1]
        gone = {k for s, e, stays in spans if not stays for k in range(s, e)} - {k for s, e, stays in spans if stays for k in range(s, e)}
        want[i, "".join(c for k, c in enumerate(t) if k not in gone)] += 1
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == [*docs.columns, "removed"]
    assert collections.Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == want
    found = substring_dedup.repeats(docs).collect()
    assert {r["doc_id"] for r in found} == {i for (i, t) in data if (i, t) not in want}
    assert all(r["kept_in"] and None not in r["kept_in"] for r in found)
    assert substring_dedup.repeats(empty).count() == 0 and substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_removes_whole_lines(spark):
    """Of each line, counted by str.split alone, only the first occurrence keeps any text, whatever its length."""
    from tests.llm.conftest import sentence

    tail, long = sentence(1) + " " + sentence(2) + " The end.", sentence(3)
    texts = [
        "Licensed under the MIT license.\n" + tail + "\n\nOne.\nown line of text 1",
        "own line of text 2\nlicensed  under the mit LICENSE.\n" + tail,
        tail + "\n}\n" + long + " Short.\n}",
        "One.\none two.\n" + long + " Short.\n" + long + " Other.",
        "One.\n" + "\n".join(f"short line {k}" for k in range(30)),
        "\n".join(f"short line {k}" for k in range(30)) + "\nThe end.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    seen = set()
    for k, text in enumerate(texts):
        gone = {p for s in got[k]["removed"] or [] for p in range(s["start"], s["end"])}
        at = 0
        for line in text.split("\n"):
            here, words = set(range(at, at + len(line))), " ".join(line.lower().split())
            if words in seen:
                assert here <= gone, (k, line)
            elif words not in ("", (long + " Other.").lower()):
                assert not here & gone, (k, line)
            seen.add(words)
            at += len(line) + 1
    assert got[3]["text"].split("\n") == ["", "one two.", "", " Other."]


def test_units_and_cover():
    a = "one two three. four five six seven eight nine. ten"
    assert [(s, e) for s, e, _ in substring_dedup.units(a, 5)] == [(0, 46), (15, 46)]
    assert [d for *_, d in substring_dedup.units("x y. " + a, 5)][-1] == substring_dedup.units(a, 5)[-1][2]
    assert substring_dedup.cover([(0, 10, 1), (5, 20, 2)], [(8, 12)]) == [(0, 8, [1, 1, 2]), (12, 20, [2])]
    assert substring_dedup.cover([(0, 5, 1)], [(0, 9)]) == []


def test_quality(spark, docs, empty):
    good = [(k, " ".join(f"word{(k * 3 + j) % 50}" for j in range(40)) + ".", 1) for k in range(80)]
    bad = [(100 + k, "$$$ ### %%% " * 20 + str(k), 0) for k in range(80)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad if i % 2] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(df, labels).collect()}
    assert all(got[i] == y for i, _, y in good + bad)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.classify(docs, none).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.5}
    ones = spark.createDataFrame([(1, 1), (8, 1)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.classify(docs, ones).collect()} == {1}
    kept = quality.keep_good(df, labels)
    assert kept.count() == 80 and kept.columns == df.columns
    assert quality.classify(empty, ones).count() == 0


def test_isotonic():
    y = quality.isotonic(np.array([1.0, 3, 2, 2, 5, 4]), np.ones(6))
    assert y.tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5])


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_urls(spark):
    urls = {
        1: ("http://WWW.Example.COM/en/x?y", "www.example.com", "/en/x", "www.example.com/en/"),
        2: ("https://a.example.com/en/#f", "a.example.com", "/en/", "example.com/en/"),
        3: ("https://notexample.com/en/", "notexample.com", "/en/", "com/"),
        4: ("https://x.net/es/1", "x.net", "/es/1", "net/es/"),
        5: ("https://x.net/de/1", "x.net", "/de/1", None),
        6: ("example.com/en/", "", "", None),
        7: (None, "", "", None),
        8: ("", "", "", None),
        9: ("http://com", "com", "", None),
        10: ("http://ÄB.com?q=/a/b", "Äb.com", "", None),
        11: ("a://b://c/d\ne", "b:", "//c/d\ne", None),
    }
    df = spark.createDataFrame([(i, u[0], "x") for i, u in urls.items()] + [(None, "http://q.com/", "x")], "page_id long, url string, verdict string")
    rows = {r["page_id"]: r for r in url_filter.judge(df, RULES).collect()}
    for i, (_, host, path, rule) in urls.items():
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] == next((k for k, r in RULES if r == rule), rows[i]["verdict"]) and rows[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "mixing sources", "byte-level bpe"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    coder = _coder()
    for r in out.collect():
        assert r["n_tokens"] == len(r["ids"])
        assert hashlib.sha256(coder.decode_bytes(list(r["ids"]))).hexdigest() == r["decoded_sha256"]


def test_url_statistics_are_of_all_rows(spark, monkeypatch):
    """The draw bounds what the trees are fitted on, not what a suffix is counted over."""
    seen = []
    learn = url_filter.GBTClassifier.fit
    monkeypatch.setattr(url_filter.GBTClassifier, "fit", lambda self, df: (seen.append(df), learn(self, df))[1])
    urls = [f"http://h{k}.com/a" for k in range(60)] + [f"http://h{k}.net/es/{k}" for k in range(40)] + [f"http://h{k}.net/de/{k}" for k in range(30)] + ["http://h.org/"] * 20
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge(df, RULES, max_rows=20).collect()
    assert len(rows) == len(urls)
    (fitted,) = seen
    found = {tuple(round(x, 9) for x in r["features"].toArray()[-2:]) for r in fitted.collect()}
    prior = 0.4
    assert found == {(round(math.log1p(60), 9), round(10 * prior / 70, 9)), (round(math.log1p(70), 9), round((40 + 10 * prior) / 50, 9))}
    assert fitted.count() <= 20


def test_url_draw_is_by_label(spark):
    """One url repeated more often than the draw has rows, and labels as rare as one row, are both learnt from."""
    hot = [("http://hot.com/a",)] * 300
    df = spark.createDataFrame(hot + [("http://x.net/es/1",), ("http://y.net/es/2",), ("http://z.net/de/3",)], "url string").selectExpr("row_number() OVER (ORDER BY url) AS page_id", "url")
    rows = url_filter.judge(df, RULES, max_rows=10).collect()
    assert len(rows) == 303
    (score,) = [r["score"] for r in rows if r["rule"] is None]
    assert 0.0 < score < 1.0
    labelled = spark.createDataFrame([("a", 0.0, 300), ("b", 1.0, 1), ("c", 1.0, 2), ("d", 1.0, 3)], "url string, label double, copies long")
    drawn = url_filter.draw(labelled, {0.0: 1, 1.0: 3}, {0.0: 300, 1.0: 6}, 2)
    sums = {r["label"]: (r["n"], r["w"]) for r in drawn.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert sums == {0.0: (1, 300.0), 1.0: (1, pytest.approx(6.0))}


def test_warc_query_rebuilds_payloads(spark, tmp_path, monkeypatch):
    """Digests come from the rebuilt bytes, not from a revisit's header, and a page of damaged bytes keeps its row."""
    from orrery.llm import queries

    pages(spark).write.parquet(str(tmp_path / "pages.parquet"))
    write = warc.write

    def damaged(df, path):
        write(df, path, compression="none")
        folder = pathlib.Path(path.removeprefix("file:"))
        for f in folder.glob(".*.crc"):
            f.unlink()
        for f in folder.glob("part-*"):
            data = f.read_bytes().replace(b"\r\n\r\nsmall\r\n", b"\r\n\r\nsmalt\r\n")
            f.write_bytes(re.sub(rb"(WARC-Type: revisit(?:(?!WARC/1.1).)*?WARC-Payload-Digest: sha1:)[0-9a-f]{40}", rb"\g<1>" + b"0" * 40, data, flags=re.S))

    monkeypatch.setattr(warc, "write", damaged)
    got = queries.op8_warc(spark, str(tmp_path)).collect()
    key = lambda i, n, d: (rank(i), n or -1, d or "")
    want = [(r["page_id"], (r["html"] or "").encode()) for r in pages(spark).collect()]
    want = [(i, None, None) if p == b"small" else (i, len(p), hashlib.sha1(p).hexdigest()) for i, p in want]
    assert sorted(key(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(key(*w) for w in want)
    assert "revisit" in {r["record_type"] for r in got}


def test_lengths_of_runs():
    assert substring_dedup.run_lengths([(0, 10, [1]), (11, 30, [2]), (40, 45, [3]), (60, 90, [4])]) == [30, 30, 5, 30]
    assert substring_dedup.run_lengths([]) == []


def test_substring_runs(spark):
    """With min_run a passage of short lines goes and a lone common line stays."""
    passage = "\n".join(f"line number {k} here." for k in range(12))
    df = spark.createDataFrame([(1, "All rights reserved.\n" + passage), (2, "first of its kind\nAll rights reserved.\nother"), (3, "x\n" + passage + "\ny")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in substring_dedup.remove_repeats(df, min_run=160).collect()}
    assert got[1] == ("All rights reserved.\n" + passage).split()
    assert got[2] == "first of its kind All rights reserved. other".split()
    assert got[3] == ["x", "y"]


def test_pieces_of_a_batch():
    import pyarrow as pa

    texts = ["a" * 10, None, "", "b" * 100, "c", "d" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    pieces = list(common.in_pieces(batch, most=12))
    assert [x for p in pieces for x in p.column("text").to_pylist()] == texts
    assert all(len(p) == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 12 for p in pieces)
    assert list(common.in_pieces(batch.slice(0, 0))) == []


def test_decoding_refuses_unknown_ids(monkeypatch):
    table = bpe.TokenBytes({b"a": 0, b"bc": 1, b"d": 3})
    monkeypatch.setattr(bpe, "PIECE_TOKENS", 2)
    data, sizes = table(np.array([1, 0, 3, 1, 1]))
    assert data.tobytes() == b"bcadbcbc" and sizes.tolist() == [2, 1, 1, 2, 2]
    for bad in (2, 4, -1):
        with pytest.raises(ValueError):
            table(np.array([0, bad]))


def test_components_of_a_hub(spark):
    """A hub with thousands of links, and a chain that hangs on it."""
    links = [(0, k) for k in range(1, 3000)] + [(5000, 2999), (5000, 6000), (6000, 7000), (8000, 8001)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a int, b int")).collect()))
    assert got.get(7000) == 0 and got.get(1) == 0 and got[8001] == 8000 and sum(v == 0 for v in got.values()) >= 3002 - 1


def test_components_against_union_find(spark):
    """Hubs beyond the bound that dealt them out, repeated links, links to itself and null ends: one row a node."""
    rng = np.random.default_rng(11)
    links = [(9000, k) for k in range(1500)] + [(9500, k) for k in range(1200, 3000)] + [(k, 4000) for k in range(3500, 4600)]
    links += [(4600, 9500)] * 400 + [(7, 7), (None, 8800), (8801, None)] + [tuple(map(int, rng.integers(5000, 8000, 2))) for _ in range(1500)]
    head = {}

    def root(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            head[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(links, "a int, b int")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert dict(map(tuple, got)) == {x: root(x) for x in head if root(x) != x}


def test_near_groups_of_a_crowd_with_outliers(spark):
    """A crowd around one text with some members that only reach each other, against brute force, in pieces of few."""
    rng = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(40)], []
    for k in range(300):
        w = list(base)
        for at in rng.choice(40, 1 if k % 3 else 5, replace=False):
            w[at] = f"x{rng.integers(6)}"
        texts.append(" ".join(w))
    sets = [shingles(t, 2) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    piece = near_dedup.PIECE
    try:
        near_dedup.PIECE = 20
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df, width=2).collect()}
    finally:
        near_dedup.PIECE = piece
    assert [got[k] for k in range(300)] == components(sets)


def test_mix_offsets(spark):
    rows = [(k, o, (o * 7 + k) % 5) for k in range(3) for o in range(0, 4000, 1 + k)]
    got = {(r["k"], r["o"]): r["at"] for r in mixing.offsets(spark.createDataFrame(rows, "k long, o long, n long"), "k", "o", "n", "at").collect()}
    sums = collections.Counter()
    for k, o, n in rows:
        assert got[k, o] == sums[k]
        sums[k] += n


def test_cluster_has_to_name_a_checkpoint_folder():
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        common.prepare(cluster)


def test_near_copies_hand_on_links_in_proportion_to_their_number(spark, monkeypatch):
    """A crowd of near copies meets many heads: a link for each member goes on, not one for each member and head."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(160):
        words = list(base)
        for at in rng.choice(300, 6, replace=False):
            words[at] = f"x{k}_{at}"
        texts.append((k, " ".join(words)))
    handed = []
    whole = graph.components
    monkeypatch.setattr(graph, "components", lambda links, *names: handed.append(links.count()) or whole(links, *names))
    groups = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), width=2).collect()
    assert {r["component_id"] for r in groups} == {0} and len(groups) == 160
    assert handed[0] < 4 * 160  # 1678 when every member was linked with each of its heads
