"""JSON documents cut at record borders equal what the json module reads, however the file is split."""

import json
import random

import pytest

from tablewarden.sources.reader import load_dataset

TEXTS = ['', 'plain', '}{', '"quoted"', 'back\\slash', '\\"}', ']}, {"', 'line\nend', 'ü€😀', '\\\\', '{[', 'x' * 700]


def records(n, seed=1):
    draw = random.Random(seed)
    return [
        {"i": i, "t": draw.choice(TEXTS) + draw.choice(TEXTS), "o": {"a": draw.choice(TEXTS), "l": [{"z": draw.choice(TEXTS)}] * draw.randrange(3)}}
        for i in range(n)
    ]


def rows(df):
    found = [json.loads(r["j"]) for r in df.selectExpr("to_json(struct(i, t, o)) as j").collect()]
    return sorted(found, key=lambda r: r["i"])


@pytest.fixture(params=["64", "1000", "128m"])
def split(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False)])
def test_one_array(spark, tmp_path, split, indent, ascii_only):
    expected = records(40)
    text = json.dumps(expected, indent=indent, ensure_ascii=ascii_only)
    (tmp_path / "d.json").write_text(text + "\n", encoding="utf-8")
    schema = "i long, t string, o struct<a: string, l: array<struct<z: string>>>"
    assert rows(load_dataset(spark, str(tmp_path / "d.json"), schema=schema)) == expected


def test_many_files_and_forms(spark, tmp_path, split):
    expected = records(12, 2)
    folder = tmp_path / "many.json"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(expected[:5]))
    (folder / "b.json").write_text("\n".join(json.dumps(r) for r in expected[5:9]))
    (folder / "c.json").write_text(json.dumps(expected[9], indent=1))
    (folder / "d.json").write_text("\ufeff" + json.dumps(expected[10:]))
    (folder / "e.json").write_text("[]")
    (folder / "f.json").write_text("")
    assert rows(load_dataset(spark, str(folder))) == expected


def test_types_are_inferred(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1, "b": 0.5}, {"a": null, "c": true}]')
    df = load_dataset(spark, str(tmp_path / "t.json"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean"}
    assert sorted(map(tuple, df.select("a", "b", "c").collect()), key=str) == [(1, 0.5, None), (None, None, True)]


def test_one_object(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": {"b": 7}}')
    assert load_dataset(spark, str(tmp_path / "o.json")).first()["a"]["b"] == 7


@pytest.mark.parametrize("text", ["[]", " [ ]\n", ""])
def test_no_records(spark, tmp_path, text):
    (tmp_path / "n.json").write_text(text)
    assert load_dataset(spark, str(tmp_path / "n.json")).count() == 0
    assert load_dataset(spark, str(tmp_path / "n.json"), schema="a int").columns == ["a"]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[{"a": 1}, {"a": "x}]', '[{"a": {"b": 1}'])
def test_early_end(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    with pytest.raises(ValueError, match="ends inside"):
        load_dataset(spark, str(tmp_path / "e.json"))


@pytest.mark.parametrize("text", ['[{"a": 1}, 5, {"a": 2}]', '[{"a": 1}, 5]'])
def test_other_elements(spark, tmp_path, text):
    (tmp_path / "o.json").write_text(text)
    with pytest.raises(Exception, match="must consist of objects"):
        load_dataset(spark, str(tmp_path / "o.json")).count()
