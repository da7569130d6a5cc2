"""Sharding, Merkle manifest and source audit against brute force and on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import divergence, merkle, ranks, set_queries, sharding

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def as_table(tmp_path_factory):
    """Write a table as ``documents`` and give the folder."""

    def write(df):
        folder = tmp_path_factory.mktemp("sf")
        df.write.parquet(str(folder / "documents.parquet"))
        return str(folder)

    return write


# -- ranks


def test_ranks_of_hot_groups_and_repeated_rows(spark):
    rows = [("a", 1)] * 500 + [("a", i) for i in range(300)] + [(None, None), (None, 3), ("b", None)]
    out = ranks.ranked(spark.createDataFrame(rows, "g string, x int"), ["g"], ["x"]).collect()
    by = defaultdict(list)
    for r in out:
        by[r["g"]].append((r["rank"], r["x"]))
        assert r["group_rows"] == sum(g == r["g"] for g, _ in rows)
    for g, found in by.items():
        assert [k for k, _ in sorted(found)] == list(range(len(found)))
        assert [x for _, x in sorted(found)] == sorted([x for h, x in rows if h == g], key=lambda x: (x is not None, x or 0))


# -- sharding


def plain_shard(key, weights):
    key = "" if key is None else str(key)
    times = []
    for s, w in enumerate(weights):
        x = int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16)
        times.append((-math.log((x + 0.5) / 16**13) / w, s))
    return min(times)[1]


def check_shards(out, rows):
    out = out.collect()
    want = Counter()
    for d, text in rows:
        raw = (text or "").encode()
        want[d, len(raw) + 8, zlib.crc32(raw), "key", plain_shard(d, [1.0] * 24), plain_shard(d, [1.0] * 25)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_equal_brute_force(spark, edge_docs, no_docs, docs, as_table):
    for df in (docs, edge_docs, no_docs):
        check_shards(set_queries.op11(spark, as_table(df)), [(r["doc_id"], r["text"]) for r in df.collect()])


def test_weights_give_shares_and_growth_moves_only_into_the_new_shard(spark):
    rows = spark.range(40_000).withColumn("shard", F.lit("theirs"))
    weights = [1.0, 2.0, 5.0]
    got = {r["shard"]: r["count"] for r in sharding.assign(rows, "id", weights).groupBy("shard").count().collect()}
    for s, w in enumerate(weights):
        share = w / sum(weights)
        assert abs(got[s] - 40_000 * share) < 5 * math.sqrt(40_000 * share * (1 - share))
    moves = sharding.moved(rows, "id", weights, [*weights, 2.0]).collect()
    assert {r["to_shard"] for r in moves} == {3} and abs(sum(r["n_rows"] for r in moves) - 8_000) < 500
    more = sharding.moved(rows, "id", weights, [1.0, 2.0, 6.0]).collect()
    assert {r["to_shard"] for r in more} == {2}
    for bad in ([], [0.0], [-1.0], [math.inf], [math.nan]):
        with pytest.raises(ValueError):
            sharding.assign(rows, "id", bad)


def test_hot_key_keeps_slots_and_written_shards_hold_all_rows(spark, tmp_path):
    rows = spark.range(3_000).select(F.when(F.col("id") < 1_000, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("Slot"))
    placed = sharding.place(rows, "k", [1.0, 1.0])
    sharding.write(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3_000
    for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect():
        assert r["n"] == r["slots"] == r["last"] + 1


def test_sharding_is_native(spark, docs):
    plan = sharding.assign(docs.select("doc_id"), "doc_id", [1.0] * 24, 1.0)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- manifest


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def plain_steps(levels, i):
    """``(digests before, digests after)`` of every run on the way up."""
    steps = []
    for level in levels[:-1]:
        run = level[i // 2 * 2 : i // 2 * 2 + 2]
        steps.append((run[: i % 2], run[i % 2 + 1 :]))
        i //= 2
    return steps


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    key = lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([plain_leaf(r) for r in sorted(groups[g], key=key)]) for g in langs}
    top = plain_levels([trees[g][-1][0] for g in langs])
    root = top[-1][0]
    out = Counter()
    for k, g in enumerate(langs):
        for i, r in enumerate(sorted(groups[g], key=key)):
            steps = plain_steps(trees[g], i) + plain_steps(top, k)
            node = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = plain_leaf((*r[:3], r[3] + 1, r[4]))
            for before, after in steps:
                node = sha(*before, node, *after)
            out[r[0], plain_leaf(r), trees[g][-1][0], root, sha(*[d for s in steps for side in s for d in side]), node, node == root] += 1
    return out


def check_manifest(spark, as_table, df):
    rows = [tuple(r) for r in df.select(*set_queries.CELLS).collect()]
    out = set_queries.op12(spark, as_table(df))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, out.select(columns).collect())) == (plain_manifest(rows) if rows else Counter())


def test_manifest_equals_brute_force(spark, as_table, docs, edge_docs, no_docs):
    for df in (docs, edge_docs, no_docs, docs.limit(1)):
        check_manifest(spark, as_table, df)


def test_manifest_over_many_blocks_and_group_sizes(spark, as_table, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    sizes = [*range(1, 19), 63, 64, 65, 70]
    rows = [(100 * k + i, f"t{i % 5}", f"l{k}" if k else None, "s", (1 << 63) - 1 if i == 3 else i) for k, n in enumerate(sizes) for i in range(n)]
    check_manifest(spark, as_table, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


# -- source audit


def plain_audit(rows, least=divergence.LEAST_DOCS):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    found = [(lang, s, [low(x) for x in TERM.findall(t)]) for t, lang, s in rows]
    out = Counter()
    for lang in {x[0] for x in found}:
        mine = [x for x in found if x[0] == lang]
        seen = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted((t for t in seen if seen[t] >= least), key=str.encode)
        sources = {s: Counter() for _, s, _ in mine}
        for _, s, ts in mine:
            sources[s].update(t for t in ts if seen[t] >= least)
        whole = sum(sources.values(), Counter())

        def probs(c):
            size = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // size for t in kept}

        q = probs(whole)
        for s, c in sources.items():
            p = probs(c)
            pair = [(-sum((p[t] - o[t]) ** 2 // (p[t] + o[t]) for t in kept), b.encode(), b) for b, o in ((b, probs(d)) for b, d in sources.items() if b != s)]
            term = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t.encode(), t) for t in kept if c[t] and p[t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:10])):
                out.update((lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(items))
    return out


def audited(df, **options):
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return Counter(map(tuple, divergence.audit(df.select("text", "lang", "source"), **options).select(columns).collect()))


def test_audit_equals_brute_force(docs, edge_docs, no_docs):
    for df in (docs, edge_docs, no_docs):
        assert audited(df) == plain_audit([tuple(r) for r in df.select("text", "lang", "source").collect()])


def test_audit_over_many_blocks_sets_and_rare_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    words = ["Äpfel", "äpfel", "ÄPFEL", "a", "A", "b2c", "naïve", "x_y", "[z]", "日本", *[f"w{chr(97 + i)}" for i in range(26)]]
    draw = np.random.default_rng(5)
    rows = [(" ".join(draw.choice(words, draw.integers(0, 12))), ["en", "de", None][i % 3], f"s{draw.integers(0, 11)}") for i in range(90)]
    rows += [(None, "xx", "only"), ("alone", "yy", None), ("Q", "yy", "s"), ("\x00\x7f", "zz", "a"), ("", "zz", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audited(df, least_docs=2, block_terms=4, set_groups=3) == plain_audit(rows, least=2)


def test_equal_subtrees_are_one_node_and_equal_pairs_are_priced_once():
    counts = np.zeros((3, 1024), np.int64)
    counts[0, 5] = counts[1, 5] = counts[1, 517] = 9
    trees = divergence.Trees(counts)
    assert trees.roots[0] != trees.roots[1] != trees.roots[2]
    # One path to the place of the 9 and one of zeros, and a root for each row.
    assert [len(c) for c in trees.children] == [2] * 9 + [3]
    asked = []

    def leaf(pair, x, y):
        asked.append(len(pair))
        return x + y

    assert trees.totals(np.array([0, 0, 1]), np.array([1, 2, 2]), leaf).tolist() == [27, 9, 18]
    assert asked == [3 + 2 + 2]


def test_large_counts_stay_exact():
    got = divergence.probability(np.array([20_000_000_000, 0]), np.array([10**12, 10**12]))
    assert got.tolist() == [1 + 10**9 * (20_000_000_000 + 2) // 10**12, 1]
