"""The registered queries on a small folder, each against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from orrery.llm import queries, url_filter
from tests.llm.conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    more = [(100 + k, sentence(k % 37, 10 + k % 23), "en", "abc"[k % 3], 0, False, 7, "k", 0.5) for k in range(120)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    labels = [(100 + k, int(len(sentence(k % 37, 10 + k % 23)) > 130), 0) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def data(spark, folder):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def test_op3_learns_from_its_rows_alone(spark, folder, tmp_path):
    rows = rows_of(queries.op3_quality(spark, folder))
    for r in rows:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    other = [(r["doc_id"], 1 - r["quality"] if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 else r["quality"], 0) for r in labels]
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(other, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    again = rows_of(queries.op3_quality(spark, str(tmp_path)))
    assert [r["doc_id"] for r in again] == [r["doc_id"] for r in rows]
    assert [r["score"] for r in again] == pytest.approx([r["score"] for r in rows], abs=1e-9)
    quality = {r["doc_id"]: r["quality"] for r in labels}
    held = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert sum(p == q for p, q in held) >= 0.8 * len(held)


def test_op4_counts_near_fingerprints(spark, folder):
    rows = rows_of(queries.op4_fingerprints(spark, folder))
    prints = [int(r["fingerprint"], 16) for r in rows]
    for r, p in zip(rows, prints, strict=True):
        asked = r["doc_id"] is not None and r["doc_id"] % 20 == 0
        assert r["near_docs"] == (sum((p ^ q).bit_count() <= 3 for q in prints) - 1 if asked else None)


def _targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set(order)
    left = float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_op6_mixes_to_the_targets(spark, folder, data):
    rows = rows_of(queries.op6_mixing(spark, folder))
    sizes = Counter()
    for _, text, source in data:
        sizes[source] += len(WORD.findall(text))
    targets = _targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(WORD.findall(t))) for i, t, _ in data)
    pairs = Counter((sizes[s], round(targets[s], 6)) for _, _, s in data)
    assert Counter((r["source_size"], round(r["target"], 6)) for r in rows) == pairs
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for size, target in pairs:
        taken = sum(r["taken"] for r in rows if (r["source_size"], round(r["target"], 6)) == (size, target))
        same = sum(1 for s in sizes if (sizes[s], round(targets[s], 6)) == (size, target))
        assert abs(taken - same * target) <= max(64, 0.1 * same * target)
    assert rows == rows_of(queries.op6_mixing(spark, folder))


def test_op7_is_the_library(spark, folder, data):
    from tiktoken.load import load_tiktoken_bpe

    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, text, _ in data:
        ids = coder.encode_ordinary(text)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in queries.op7_byte_bpe(spark, folder).collect()) == want


def test_op9_base_score(spark, folder, data):
    def tokens(text):
        return [*WORD.findall(text.translate(LOWER)), None]

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    counts = Counter(t for i, text, _ in data if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _ in data)
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in queries.op9_lm_scoring(spark, folder).collect()]
    for a, b in zip(sorted(got), want, strict=True):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6], abs=1e-4)


def test_op10_is_all_pairs(spark, folder, data):
    def shingles(text):
        words = WORD.findall(text.translate(LOWER))
        return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:], strict=False))

    sets = [(i, shingles(t)) for i, t, _ in data]
    of = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and of[a] != of[b]:
                of = [of[b] if k == of[a] else k for k in of]
    least = {}
    for k, (i, _) in zip(of, sets, strict=True):
        least[k] = min(least.get(k, (True, 0)), (i is None, i or 0))
    want = Counter((i, len(s), None if least[k][0] else least[k][1]) for k, (i, s) in zip(of, sets, strict=True))
    got = queries.op10_minhash_near_dedup(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_url_trees_judge_what_no_rule_fits(spark):
    """Urls that no rule fits look like blocked ones or like allowed ones; the trees tell them apart by their form."""

    def url(k, junk, first):
        tail = f"{k * 7919 % 99991}-{k * 31 % 9973}?a={k}&b={k % 7}&c=x{k}" if junk else f"{'about-our-work-and-people'[: 5 + k % 20]}/page"
        return f"http://site{k % 40}.com/{first}/{tail}"

    rows = [(k, url(k, k % 2 == 1, ("ok", "bad")[k % 2] if k % 4 < 2 else "new")) for k in range(800)]
    rows += [(900, None), (901, "http://site1.com/new/" + "x" * 50_000), (2, rows[2][1])]
    judged = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "com/ok/"), ("block", "com/bad/")]).collect()
    assert len(judged) == len(rows)
    open_ = [r for r in judged if r["rule"] is None and r["page_id"] < 800]
    assert len(open_) == 401
    assert sum(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in open_) >= 0.95 * len(open_)


def test_op1_removes_every_later_line(spark, tmp_path):
    """Every occurrence of a line after its first goes, short lines too; long runs are marked; offsets lie in the text."""
    rng = random.Random(2)
    pool = ["All rights reserved.", "ok", "Read  more!", *(sentence(k, 3 + k % 20) + " " + sentence(k + 50, k % 12 + 1) for k in range(30))]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(1, 7)) + [f"own line {k} of this text. " + sentence(k, 9)]) for k in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(200, None), (201, ""), (202, "\n \n"), (203, "Ein ok"), (None, "ok")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    gone: dict = {}
    for r in queries.op1_substring_dedup(spark, str(tmp_path)).collect():
        assert r["start_char"] < r["end_char"] and isinstance(r["long_run"], bool)
        gone.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"], r["long_run"]))
    ids = Counter(r["doc_id"] for r in docs)
    seen: set = set()
    later = 0
    for r in sorted(docs, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        at = 0
        for line in (r["text"] or "").split("\n"):
            words = " ".join(line.lower().split())
            if words and words in seen and ids[r["doc_id"]] == 1 and r["doc_id"] is not None:
                begin, end = at + len(line) - len(line.lstrip()), at + len(line.rstrip())
                assert all(any(s <= k < e for s, e, _ in gone.get(r["doc_id"], [])) for k in range(begin, end) if not r["text"][k].isspace()), (r["doc_id"], words)
                later += 1
            seen.add(words)
            at += len(line) + 1
    assert later > 200 and {long for spans in gone.values() for _, _, long in spans} == {True, False}
    assert 203 not in gone and 200 not in gone


def test_op2_judges_by_the_longest_rule(spark, tmp_path):
    hosts = ["example.com", "www.example.com", "a.b.example.com", "xexample.com", "net", "q.net", "org", "de.org", "com"]
    paths = ["", "/", "/en/", "/en/x/1?q=/fr/", "/es/2", "/fr", "/fr/#/en/", "/EN/"]
    urls = [(k, f"http{'s' * (k % 2)}://{h.upper() if k % 3 == 0 else h}{p}") for k, (h, p) in enumerate([(h, p) for h in hosts for p in paths] * 3)]
    urls += [(900, None), (901, ""), (902, "example.com/en/"), (903, "http://" + "a." * 3000 + "net/es/")]
    spark.createDataFrame([(i, u, "<p>x</p>", "clash") for i, u in urls], "page_id long, url string, html string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r["page_id"]: r for r in queries.op2_url_filter(spark, str(tmp_path)).collect()}
    assert len(rows) == len(urls)
    for i, u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
        fits = [(len(r), k, r) for k, r in queries.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        want = max(fits, default=(0, None, None))
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, want[2])
        assert rows[i]["verdict"] == want[1] if fits else rows[i]["verdict"] in ("allow", "block")


def test_many_rules_and_held_out_urls(spark):
    rules = spark.createDataFrame([("block" if k % 2 else "allow", f"h{k}.com/p{k % 3}") for k in range(20_000)] + [("allow", None), (None, "x.com/"), ("block", "h5.com"), ("block", "H6.com/p0"), ("allow", "h7.com/p1")], "kind string, rule string")
    pages = spark.createDataFrame([(k, f"https://www.h{k}.com/p{k % 3}/{k}") for k in range(0, 20_000, 50)] + [(-1, "http://h5.com/zzz"), (-2, "http://h7.com/p1"), (-3, "http://h19999.org/")], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert all(found[k] == (f"h{k}.com/p{k % 3}", "block" if k % 2 else "allow") for k in range(50, 20_000, 50))
    assert found[-1] == ("h5.com", "block") and found[-2] == ("h7.com/p1", "block") and found[-3][0] is None
    urls = [f"http://h{k}.{'net' if k % 2 else 'com'}/{'es' if k % 2 else 'en'}/{k}" for k in range(400)]
    areas = url_filter.held_out_auc(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.RULES)
    assert areas["all"] > 0.95 and 0.0 <= areas["lexical"] <= 1.0
