"""Main text of pages and nearest neighbours."""

import html
import re

import numpy as np

from tablewarden.llm import ann, html_tree
from tests.conftest import SMALL


def test_extract_equals_the_marked_article(spark):
    for r in html_tree.extract(spark.read.parquet(f"{SMALL}/pages.parquet")).collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " " if "br" in b else "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["text"].split() == " ".join(blocks).split() and "\n\n" not in r["text"]


def test_furniture_and_repeats_go(spark, monkeypatch):
    def page(i):
        return (
            f"<html><head><title>t{i}</title></head><body><div class='top'><span>Site of news</span></div><header>Head</header>"
            f"<div class=story><h2>Title {i}</h2><p>One &amp; two&nbsp;{i}<br>three <i>four</i>{'<p>more' * (i % 4)}</div><div id='sidebar-2'>side</div>"
            f"<ul class=comments><li>I agree {i}</ul><form>f</form><script>var a='<p>';</script><div class='foot'>All of it ours</div>"
        )

    rows = [(i, f"http://h.example/{i}", page(i), "x") for i in range(12)]
    rows += [(100, None, None, "x"), (101, "no host", "", "x"), (102, "http://h.example/only", "plain &lt;b&gt; text", "x"), (103, "http://copies/1", page(5), "x"), (103, "http://copies/1", page(5), "x")]
    rows += [(104, "http://deep/", "<div>" * 3000 + "deep" + "</div>" * 3000, "x"), (105, "http://long/", "<article><p>" + "word " * 200_000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_tree.extract(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    for i in range(12):
        assert got[i] == "\n".join([f"Title {i}", f"One & two {i} three four", *["more"] * (i % 4)])
    assert got[100] == "" and got[101] == "" and got[102] == "plain <b> text" and got[104] == "deep"
    assert got[105] == " ".join(["word"] * 200_000)
    assert html_tree.extract(df.limit(0)).count() == 0
    monkeypatch.setattr(html_tree, "BROADCAST_NODES", 0)  # the salted join
    assert {r["page_id"]: r["text"] for r in html_tree.extract(df).collect()} == got


def test_copies_of_one_page_keep_their_article(spark):
    page = "<body><nav>n</nav><article><h1>T</h1><p>Text</p></article><footer>f</footer></body>"
    df = spark.createDataFrame([(i, "http://c.example/", page) for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in html_tree.extract(df).collect()} == {"T\nText"}


def brute(rows, queries, k=10):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q)
        out[q] = d[:k]
    return out


def test_search_recall_and_scores(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    got = ann.search(df, df.where("vec_id % 20 = 0"), least=50).collect()
    where = dict(rows)
    for r in got:
        assert abs(r["score"] - np.sqrt(((np.array(where[r["query_id"]]) - np.array(where[r["vec_id"]])) ** 2).sum())) < 1e-12
    hits = len({(r["query_id"], r["vec_id"]) for r in got} & {(q, i) for q, d in want.items() for _, i in d})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_ties_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(100, [1.0, 2.0, 3.0, 4.0])]
    odd = [(200, None), (300, [0.0] * 4), (400, [1.0, None, 2.0, 3.0]), (500, [float("nan")] * 4), (600, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, score string")
    want = brute(sorted(dict(rows).items()), [(i, v) for i, v in dict(rows).items() if i % 10 == 0])
    got = {}
    for r in ann.search(df, df.where("vec_id % 10 = 0"), least=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert {q: [i for _, i in d] for q, d in got.items()} == {q: [i for _, i in d] for q, d in want.items()}
    assert ann.search(df.limit(0), df).count() == 0
    two = df.where("vec_id in (1, 2)")
    assert [tuple(r)[:3] for r in ann.search(two, two.where("vec_id = 2")).collect()] == [(2, 1, 1)]
    one = spark.createDataFrame([(1, [2.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert ann.search(one, one).count() == 2
