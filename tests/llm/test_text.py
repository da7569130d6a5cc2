"""Tokenizing, packing, quality rules, language mixtures, importance and license scans."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewarden.llm import bpe, importance, langid, licenses, packing, quality
from tablewarden.llm.tokens import public_path

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", " ", "\n\n a", "x  y", "don't I'LL we've", "İıΣσς éﬁ́", "a\x1cb\x85c\xa0d", "<|endoftext|> a<|endoftext|>", "中文 🙂٣", "a" * 3000, "=" * 700 + "\t\t\t!"]


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(public_path(bpe.TOKENIZER))


def test_bpe_equals_the_library(docs, edge_docs, no_docs, byte_tokenizer, spark):
    odd = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    df = docs.select("doc_id", "text").limit(60).union(edge_docs.select("doc_id", "text")).union(odd)
    for r in bpe.decode(bpe.encode(df)).collect():
        want = byte_tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == byte_tokenizer.decode(want, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.decode(bpe.encode(no_docs)).count() == 0
    clash = bpe.encode(edge_docs.withColumnRenamed("kept", "ids"))
    assert clash.columns == [*edge_docs.columns[:-1], "ids"]


def test_bpe_decodes_any_ids(spark):
    df = spark.createDataFrame([([255, 0, 999_999],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df).collect()][1:] == [None, ""]


def test_compatible_pairs_are_those_that_merging_leaves_alone():
    vocab = bpe.vocabulary(public_path(bpe.TOKENIZER))
    draw = np.random.default_rng(0)
    tokens = np.array(sorted(vocab.proposable.values()))
    left, right = draw.choice(tokens, 4000), draw.choice(tokens, 4000)
    want = [vocab.merged(vocab.bytes[a] + vocab.bytes[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist())]
    assert vocab.compatible(left, right).tolist() == want
    assert 0 < sum(want) < len(want)


def check_packing(df, capacity=2048):
    tokenizer = Tokenizer.from_file(public_path(packing.TOKENIZER))
    rows = packing.pack_documents(df, capacity=capacity, with_ids=True).collect()
    want = Counter()
    total = 0
    for r in df.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[r["doc_id"], n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), total


def test_packing(docs, edge_docs, no_docs, spark, monkeypatch):
    used, total = check_packing(docs)
    assert used <= -(-total // 2048) + 3
    odd = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    check_packing(edge_docs.select("doc_id", "text").union(odd))
    assert packing.pack_documents(no_docs).count() == 0
    monkeypatch.setattr(packing, "GROUP_ROWS", 60)  # several groups and a second round
    used, total = check_packing(docs, 512)
    assert used <= 1.02 * total / 512 + 3


def test_sum_of_squares_is_near_the_least_number():
    lengths = np.random.default_rng(2).integers(1, 2049, 5000)
    bins, offsets = packing.sum_of_squares(lengths)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 2048 and len(fill) <= 1.01 * lengths.sum() / 2048 + 1 + (lengths > 1024).sum() * 0.02


def plain_counts(text):
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def plain_shares(text):
    left, chars = text, []
    for members in quality.CLASSES.values():
        rest = re.sub(f"[{members}]", "", left)
        chars.append(len(left) - len(rest))
        left = rest
    words = WORD.findall(text)
    common = [words.count(w) for w in quality.VOCABULARY]
    c = np.array([*chars, len(left)]) / len(text) if text else None
    w = np.array([*common, len(words) - sum(common)]) / len(words) if words else None
    return c, w


def plain_distance(p, q):
    m = (p + q) / 2
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
    return np.sqrt(max(0, (part(p) + part(q)) / 2))


def check_quality(df):
    rows = df.select("doc_id", "text", "lang").collect()
    shares = [plain_shares(r["text"] or "") for r in rows]
    refs = {}
    for lang in quality.COMMON_WORDS:
        mine = [s for r, s in zip(rows, shares) if r["lang"] == lang]
        parts = [[s[k] for s in mine if s[k] is not None] for k in (0, 1)]
        if all(parts):
            refs[lang] = [np.mean(p, axis=0) for p in parts]
    got = sorted(map(tuple, quality.judge(df).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept").collect()), key=repr)
    want = []
    for r, s in zip(rows, shares):
        base = plain_counts(r["text"] or "")
        judged = r["lang"] is None or r["lang"] in refs
        near = [min(plain_distance(s[k], v[k]) for v in refs.values()) if judged and s[k] is not None else None for k in (0, 1)]
        far = near[0] is not None and near[0] > quality.MAX_CHAR_DISTANCE and base[1] >= quality.MIN_CHARS_JUDGED
        far |= near[1] is not None and near[1] > quality.MAX_WORD_DISTANCE and base[0] >= quality.MIN_WORDS_JUDGED
        want.append((r["doc_id"], r["text"], *base, *near, not base[-1] and not far))
    want.sort(key=repr)
    for g, w in zip(got, want, strict=True):
        assert g[:8] == w[:8] and g[10] == w[10]
        assert [None if x is None else round(x, 6) for x in g[8:10]] == [None if x is None else round(float(x), 6) for x in w[8:10]]


def test_quality_equals_brute_force(docs, edge_docs, no_docs):
    check_quality(docs)
    check_quality(edge_docs)
    assert quality.judge(no_docs).count() == 0


def test_quality_keeps_clean_and_rejects_junk(docs, spark):
    from tests.conftest import SMALL

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = quality.judge(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, found))
    assert share[1] >= 0.95 and share.get(0, 0) <= 0.4


def test_language_held_out_accuracy_and_edges(docs, edge_docs, no_docs):
    named = docs.withColumn("held_out", langid.held_out())
    langs, model = langid.learn(named.where("not held_out"))
    assert langs == ["de", "en", "es", "fr"]
    out = langid.predict(named, langs, model).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.97
    rows = {r["doc_id"]: r for r in langid.predict(edge_docs, langs, model).collect()}
    for i in (1, 2, 3):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["languages"]) == ("und", 0.0, [])
    assert rows[4]["lang_pred"] == "en" and 0 <= rows[7]["score"] <= 1 and rows[4]["kept"] == "theirs"
    assert langid.learn(no_docs)[0] == [] and langid.predict(no_docs, langs, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge_docs, *langid.learn(no_docs)).collect()} == {"und"}


def test_mixture_finds_both_languages(docs):
    langs, model = langid.learn(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) between 1000 and 4000").collect()}
    parts = langid.mixture(*langid.trigrams(texts["en"][:900] + " " + texts["de"][:600]), model)
    assert {langs[i] for i in parts} == {"en", "de"} and abs(sum(parts.values()) - 1) < 1e-9
    assert parts[langs.index("en")] > parts[langs.index("de")] > 0.2


def test_trigrams_of_long_texts(monkeypatch):
    text = "Straße and other words " * 300
    want = langid.trigrams(text)
    monkeypatch.setattr(langid, "STEP", 100)
    got = langid.trigrams(text)
    assert all((a == b).all() for a, b in zip(want, got))


def test_crc_of_ids(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("h", langid.held_out())
    for r in df.collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_importance_against_a_plain_count(spark, edge_docs, no_docs):
    draw = np.random.default_rng(4)
    good = "alpha beta gamma delta epsilon zeta".split()
    bad = "trash junk spam".split()
    rows = [(i, " ".join([*draw.choice(good, 40), *(draw.choice(bad, 8) if i % 4 == 0 else [])])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0 if i % 4 else 1) for i in range(0, 400, 3)] + [(None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = importance.resample(docs, labels).collect()
    assert not any(r["selected"] for r in out if r["doc_id"] % 4 == 0)
    assert np.mean([r["selected"] for r in out if r["doc_id"] % 4]) > 0.9
    ratio = importance.fit(docs.withColumn("target", F.col("doc_id") % 4 != 0))
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(t.split())
        target.update(t.split() if i % 4 else [])
    scale = sum(target.values()) / sum(raw.values())
    for w in [*good, *bad]:
        want = np.log((target[w] + importance.SMOOTHING) / (raw[w] * scale + importance.SMOOTHING))
        assert abs(ratio[importance.buckets(w.encode())[0]] - want) < 1e-9
    assert sum(r["selected"] for r in importance.resample(docs, labels, k=37).collect()) == 37
    some = importance.resample(edge_docs, labels)
    assert some.count() == 11 and "kept" in some.columns
    assert {r["selected"] for r in importance.resample(edge_docs, labels.limit(0)).collect()} == {True}
    assert importance.resample(no_docs, labels).count() == 0


def test_importance_cuts_long_texts_at_white_space(monkeypatch):
    text = b"some words, that go on; " * 500
    want = importance.buckets(text, 2)
    monkeypatch.setattr(importance, "STEP", 100)
    assert (importance.buckets(text, 2) == want).all()


def plain_runs(text, k=3):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_license_scan_equals_containment(docs, edge_docs, no_docs, spark):
    filler = "the quick brown fox jumps over lazy dogs and runs far away from here today "
    planted = [(1000 + i, filler * (i % 5) + t + " " + filler * (i % 3)) for i, (_, t) in enumerate(licenses.NOTICES)]
    planted += [(2000, "licensed under the"), (2001, "All Rights, reserved!")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string")).union(edge_docs.select("doc_id", "text"))
    want = set()
    for r in df.collect():
        runs = plain_runs(r["text"] or "")
        for name, text in licenses.NOTICES:
            t = plain_runs(text)
            if len(t & runs) >= 0.8 * len(t):
                want.add((r["doc_id"], name))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()}
    assert got == want and {(1000 + i, n) for i, (n, _) in enumerate(licenses.NOTICES)} <= got
    assert licenses.scan(no_docs).count() == 0
    none = spark.createDataFrame([("x", None), ("y", " ")], "license string, template string")
    assert licenses.scan(docs, none).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
