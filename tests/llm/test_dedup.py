"""SimHash classes and repeated byte strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tablewarden.llm import simhash, suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_print(text, k=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, distance=2):
    """Class number of every fingerprint."""
    todo, where = set(prints), {}
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = {y for y in todo if (x ^ y).bit_count() <= distance}
            todo -= near
            front += near
        where |= dict.fromkeys(group, min(group))
    return where


def check_near(df):
    rows = df.select("doc_id", "text").collect()
    prints = [plain_print(r["text"]) for r in rows]
    where = plain_classes(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r["doc_id"] is not None:
            least[where[p]] = min(least.get(where[p], r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{p:016x}", least.get(where[p])) for r, p in zip(rows, prints))
    out = simhash.near_duplicates(df).select("doc_id", simhash.hex_digits(F.col("fingerprint_bits")), "component_id")
    assert Counter(map(tuple, out.collect())) == want


def test_near_duplicates_equal_brute_force(docs, edge_docs, no_docs):
    check_near(docs)
    check_near(edge_docs)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_over_chains_and_distances(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 0b11, base ^ 0b1111, base ^ (7 << 40), base ^ (1 << 63), 0, 1 << 63, 7]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    got = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash.links(df).collect()}
    want = {frozenset((a, b)) for a in prints for b in prints if 0 < (a ^ b).bit_count() <= 2}
    assert got == want
    parts = simhash.components(simhash.links(df), df.withColumn("label", F.col("fp")))
    of = {r["fp"] % 2**64: r["component"] % 2**64 for r in parts.collect()}
    assert of[base] == of[base ^ 0b1111] == of[base ^ (1 << 63)] and of[base] != of[0] and base ^ (7 << 40) not in of


def test_components_of_a_long_chain(spark):
    n = 200
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    labels = spark.createDataFrame([(i, None if i == 0 else i) for i in range(n + 1)], "fp long, label long")
    got = simhash.components(pairs, labels).collect()
    assert len(got) == n + 1 and {r["component"] for r in got} == {1}


def test_keep_one_keeps_one_of_each_class(edge_docs, no_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 4, None, 7, 8, 9])
    assert simhash.keep_one(no_docs).count() == 0


def plain_runs(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def check_similar(df, k=5, t=0.8):
    """One of each class of texts of a similarity of ``t``, by comparing all pairs."""
    rows = df.select("doc_id", "text").distinct().collect()
    sets = sorted({plain_runs(r["text"], k) for r in rows}, key=lambda s: sorted(s))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            small, large = sorted((len(a), len(sets[j])))
            if small >= t * large and len(a & sets[j]) >= t * len(a | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    number, least = {s: i for i, s in enumerate(sets)}, {}
    for r in rows:
        c = find(number[plain_runs(r["text"], k)])
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
        else:
            least.setdefault(c, float("inf"))
    got = Counter(r["doc_id"] for r in simhash.keep_one(df, words=k, similarity=t).collect())
    assert got == Counter(None if i == float("inf") else i for i in least.values())


def test_keep_one_by_similarity_equals_brute_force(spark, docs, edge_docs, no_docs, monkeypatch):
    import random

    from tablewarden.llm import jaccard

    check_similar(docs)
    check_similar(edge_docs)
    assert simhash.keep_one(no_docs, words=5, similarity=0.8).count() == 0
    # Chains of edits whose ends are far apart, a common passage, and sets right at the limit.
    draw = random.Random(5)
    texts, common = [], [f"c{i}" for i in range(90)]
    for start in range(6):
        words = [f"w{start}x{draw.randrange(10**6)}" for _ in range(100)]
        for _ in range(12):
            texts.append(" ".join(words))
            words = list(words)
            words[draw.randrange(100)] = f"e{draw.randrange(10**6)}"
    texts += [" ".join(common + [f"u{draw.randrange(10**6)}" for _ in range(draw.randrange(8, 30))]) for _ in range(30)]
    texts += [" ".join(common[:n]) for n in (84, 70, 68, 67, 54, 4, 3)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    check_similar(df)
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)  # another order of the shingles
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 2)
    check_similar(df)


def test_frequent_shingles_are_known_in_large_tables(spark, monkeypatch):
    from tablewarden.llm import jaccard

    # 60 of 800 texts share a passage; a sample of a fixed number of texts would hardly meet it.
    monkeypatch.setattr(jaccard, "SAMPLE_TEXTS", 4)
    passage = " ".join(f"same{k}" for k in range(30))
    texts = [(" ".join(f"own{i}x{k}" for k in range(20)) + (" " + passage if i < 60 else ""),) for i in range(800)]
    tokens, counts = jaccard._frequent(spark.createDataFrame(texts, "text string"), 5)
    assert set(jaccard.shingles(passage, 5).tolist()) == set(tokens.tolist()) and counts.min() >= jaccard.FREQUENT


def test_places_refuse_no_similar_sets(spark):
    from tablewarden.llm import jaccard

    draw, rows, similar = random.Random(5), [], 0
    for _ in range(300):
        x = set(draw.sample(range(2_000), draw.randint(3, 60)))
        y = set(draw.sample(sorted(x), max(1, len(x) - draw.randint(0, 8)))) | set(draw.sample(range(2_000), draw.randint(0, 6)))
        near = len(x & y) >= 0.8 * len(x | y)
        similar += near
        rows += [(len(x), sorted(x).index(t), len(y), sorted(y).index(t), near) for t in x & y]
    found = spark.createDataFrame(rows, "n long, place long, leader_n long, leader_place long, near boolean")
    allowed = found.withColumn("allowed", jaccard._places_allow("", "leader_", 0.8))
    assert similar > 50 and allowed.where("near and not allowed").isEmpty() and not allowed.where("not near and not allowed").isEmpty()


def test_a_pair_that_one_row_sets_apart_is_not_possible(spark):
    from tablewarden.llm import jaccard

    rows = [(1, 2, 10, 10, 0, 0, False), (1, 2, 10, 10, 1, 1, True), (1, 3, 10, 10, 0, 0, False), (1, 3, 10, 10, 1, 1, False)]
    pairs = spark.createDataFrame(rows, "a long, b long, n_a long, n_b long, place_a long, place_b long, apart boolean")
    assert [tuple(r) for r in jaccard._possible(pairs, 0.8).collect()] == [(1, 3)]


def test_shingles_of_the_same_sets_are_one_token(spark, monkeypatch):
    from tablewarden.llm import jaccard

    passage = " ".join(f"same{k}" for k in range(60))
    texts = [(f"{i}", f"{passage} " + " ".join(f"own{i}x{k}" for k in range(30)), i, i) for i in range(40)]
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    prints = jaccard._prints(spark.createDataFrame(texts, "id string, text string, `key one` long, `key two` long"), 5, 0.3).cache()
    met = jaccard._meetings(prints).cache()
    alike = jaccard._alike(met).cache()
    of = {r["s"]: (r["n"], r["first"]) for r in prints.collect()}
    shared = Counter(x for _, first in of.values() for x in first)
    assert met.count() == sum(c for c in shared.values() if c > 1) and alike.agg(F.sum("shared")).head()[0] == met.count()
    # A shingle that many sets have is one row of each; only one that lies on the border of two ranges stands apart.
    groups = {frozenset(s for s, (_, first) in of.items() if x in first) for x, c in shared.items() if c > 1}
    least = alike.groupBy("token").agg(F.sort_array(F.collect_set("s")).alias("all")).select("all").distinct().collect()
    assert {frozenset(r["all"]) for r in least} == groups and alike.count() <= met.count() / 4
    for r in alike.collect():
        first, ahead = of[r["s"]][1], of[r["leader"]][1]
        assert first[r["start"]] == ahead[r["leader_start"]] and first[r["place"]] == ahead[r["leader_place"]]


def test_marked_rows_are_all_that_a_join_needs(spark):
    from tablewarden.llm.common import may_hold

    rows = spark.range(100_000).select(F.xxhash64("id").alias("k"), "id")
    keys = rows.where("id % 500 = 0").select("k").union(spark.createDataFrame([(-1,), (None,)], "k long"))
    got = may_hold(rows, keys, "k")
    assert got.columns == ["k", "id", "may hold"] and got.count() == 100_000
    marked = got.where("`may hold`")
    assert marked.where("id % 500 = 0").count() == 200 and marked.count() < 250
    assert may_hold(rows, keys.where("false"), "k").where("`may hold`").count() == 0


def plain_cut(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((bytes(c for c, g in zip(t, gone) if not g), spans))
    return out


def check_cut(df, length):
    rows = df.collect()
    want = plain_cut([(r["text"] or "").encode() for r in rows], length)
    got = suffix_dedup.remove_repeats(df, length=length).collect()
    key = lambda text, kept, spans: (text, bytes(kept), tuple(map(tuple, spans)))
    assert Counter(key(r["text"], r["kept_bytes"], r["removed_spans"]) for r in got) == Counter(key(r["text"], *w) for r, w in zip(rows, want))
    for r in got:
        assert r["n_bytes"] == len((r["text"] or "").encode())


def test_repeats_equal_brute_force(docs, edge_docs, no_docs, monkeypatch):
    check_cut(docs, 400)
    check_cut(edge_docs.where("doc_id is null or doc_id != 7"), 400)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    kept = suffix_dedup.remove_repeats(edge_docs)
    assert [c for c in kept.columns if c not in ("n_bytes", "kept_bytes", "removed_spans")] == edge_docs.columns


def test_repeats_over_small_blocks_and_periods(spark, monkeypatch):
    """Short windows over a small alphabet, where everything overlaps."""
    import random

    draw = random.Random(3)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 90))) for _ in range(30)]
    texts += ["ab" * 40, "ab" * 40, "aaaaaaaaaaaaaaaaaaaaaaaa", "é" * 20, "é" * 20 + "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check_cut(df, 10)
    check_cut(df, 3)


def plain_word_cut(texts, length, words):
    """Bytes kept outside repeated strings of ``length`` bytes and repeated runs of ``words`` words."""
    pattern = re.compile(rb"[^\x20\x09-\x0d]+")
    found = [[m.span() for m in pattern.finditer(t)] for t in texts]
    runs = [[tuple(t[a:b] for a, b in s[i : i + words]) for i in range(len(s) - words + 1)] for t, s in zip(texts, found)]
    seen, out = Counter(r for x in runs for r in x), []
    for t, s, x, (_, spans) in zip(texts, found, runs, plain_cut(texts, length)):
        gone = bytearray(len(t))
        for a, b in spans + [(s[i][0], s[i + words - 1][1]) for i, r in enumerate(x) if seen[r] > 1]:
            gone[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(t, gone) if not g))
    return out


def test_repeated_words_equal_brute_force(spark, edge_docs, docs):
    import random

    draw = random.Random(4)
    texts = [" ".join(draw.choice("a b é".split()) + draw.choice(["", "", "\n"]) for _ in range(draw.randint(0, 40))) for _ in range(30)]
    small = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df, length, words in ((docs, 400, 51), (edge_docs.where("doc_id is null or doc_id != 7"), 400, 51), (small, 30, 6), (small, 25, 1)):
        rows = df.collect()
        want = plain_word_cut([(r["text"] or "").encode() for r in rows], length, words)
        got = suffix_dedup.remove_repeats(df, length=length, words=words).collect()
        assert Counter((r["text"], bytes(r["kept_bytes"])) for r in got) == Counter((r["text"], k) for r, k in zip(rows, want))


def test_long_text_in_steps():
    """Blocks of a long text give the anchors and windows of the whole."""
    import numpy as np

    data = np.frombuffer(np.random.default_rng(1).integers(97, 101, 3 * suffix_dedup.STEP // 2, dtype=np.uint8).tobytes(), np.uint8)
    lo, hi, *_ = suffix_dedup.anchors(data, 400)
    assert lo[0] == 0 and hi[-1] == len(data) - 400 and (lo[1:] == hi[:-1] + 1).all()
    at = np.array([0, 5, suffix_dedup.STEP - 1, suffix_dedup.STEP, len(data) - 400])
    same = np.concatenate([data[a : a + 400] for a in at])
    assert (suffix_dedup.windows(data, at, 400)[3] == suffix_dedup.windows(same, np.arange(5) * 400, 400)[3]).all()


def test_query_digests(spark):
    from tablewarden.llm import queries
    from tests.conftest import SMALL

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, (kept, spans) in zip(rows, plain_cut([(r["text"] or "").encode() for r in rows], 400)):
        n = len((r["text"] or "").encode())
        want[r["doc_id"]] = (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in queries.op9(spark, SMALL).collect()} == want
