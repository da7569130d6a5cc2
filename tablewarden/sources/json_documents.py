"""Reading JSON documents of any size by many tasks, by cutting them at the borders of their records."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.runtime import ensure_checkpoint_dir

COMPRESSED = r"\.(gz|bz2|deflate|zst|lz4|snappy)$"
BETWEEN = " \t\r\n,[]\ufeff"
INCOMPLETE = "A JSON document ends inside a record or has changed while it was read"
NO_OBJECT = "JSON documents must consist of objects, found: "

SUMMARY = "file long, block long, size long, packed boolean, octets long, quotes long, depth0 long, low0 long, depth1 long, low1 long"
STARTS = "file long, block long, inside long, depth long, owner long"
CUTS = "part boolean, file long, owner long, block long, text string"
PARTS = "file long, owner long, block long, text string"
QUOTE, SLASH, OPEN, CLOSE = (ord(c) for c in '"\\{}')
MARKS = np.isin(np.arange(256), [QUOTE, OPEN, CLOSE])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text up to and with each closing brace, which the text source splits by byte ranges (``block``).

    A piece starts behind a brace, hence never inside an escape. ``file`` is a hash of the file's name.
    """
    name = F.col("_metadata.file_path")
    return spark.read.text(path, lineSep="}").select(
        F.xxhash64(name).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.lower(name).rlike(COMPRESSED).alias("packed"),
        F.concat("value", F.lit("}")).alias("text"),
    )


def block_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, dict, np.ndarray]]:
    """Runs of pieces of one block in order: whether a new block starts, its fields, and the bytes."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch["file"].to_numpy(), batch["block"].to_numpy()
        text = batch["text"]
        _, places, data = text.buffers()
        places = np.frombuffer(places, "int32")[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, "uint8")
        new = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for start, end in zip([0, *new], [*new, batch.num_rows]):
            key = (file[start], block[start])
            fields = {c: batch[c][int(start)].as_py() for c in batch.schema.names if c != "text"} if key != last else {}
            yield key != last, fields, data[places[start] : places[end]]
            last = key


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotation marks and braces that no backslash escapes, the change of open braces at each if it is
    outside a string, and whether an odd number of quotation marks comes up to it."""
    place = np.flatnonzero(MARKS[data])
    slash = np.flatnonzero(data == SLASH)
    if len(slash):
        first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        nth = np.arange(len(slash)) - np.repeat(first, np.diff(first, append=len(slash)))
        escaped = np.zeros(len(data) + 1, dtype=bool)
        escaped[slash[nth % 2 == 0] + 1] = True
        place = place[~escaped[place]]
    kind = data[place]
    step = (kind == OPEN).astype("int64") - (kind == CLOSE)
    return place, step, np.cumsum(kind == QUOTE) % 2


def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its size and, for both ways it may start, the change and the least of the open braces."""
    row: dict | None = None
    for new, fields, data in block_runs(batches):
        if new:
            if row:
                yield pa.RecordBatch.from_pylist([row])
            row = fields | {"octets": 0, "quotes": 0, "depth0": 0, "low0": 0, "depth1": 0, "low1": 0}
        _, step, odd = marks(data)
        for h in (0, 1):
            depth = row[f"depth{h}"] + np.cumsum(np.where(odd == (row["quotes"] + h) % 2, step, 0))
            row[f"depth{h}"], row[f"low{h}"] = int(depth[-1]), min(row[f"low{h}"], int(depth.min()))
        row["quotes"] = int(row["quotes"] + odd[-1]) % 2
        row["octets"] += len(data)
    if row:
        yield pa.RecordBatch.from_pylist([row])


def block_starts(summaries: list) -> list[tuple]:
    """``file, block, inside, depth, owner`` of each block; ``owner`` is the block in which the record
    that is open at its start begins.
    """
    starts, files = [], {}
    for r in sorted(summaries, key=lambda r: (r["file"], r["block"])):
        files.setdefault(r["file"], []).append(r)
    for file, blocks in files.items():
        inside, depth, owner = 0, 0, blocks[0]["block"]
        for r in blocks:
            starts.append((file, r["block"], inside, depth, owner))
            closes = depth + r[f"low{inside}"] <= 0
            if closes or depth == 0:
                owner = r["block"]
            depth, inside = depth + r[f"depth{inside}"], (inside + r["quotes"]) % 2
        # A document that does not end in a brace has one piece too many, whose brace is not there.
        # (Three bytes more are the mark of a file in UTF-8.)
        spare = blocks[0]["size"] - sum(r["octets"] for r in blocks)
        ends = (0, -1) if blocks[0]["packed"] else {-1: (-1,), 2: (-1,), 0: (0,), 3: (0,)}.get(spare, ())
        if inside or depth not in ends:
            raise ValueError(INCOMPLETE)
    return starts


def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the parts of records that reach across a block's border."""
    waiting: list[bytes] = []
    state: dict = {}
    schema = pa.schema([("part", pa.bool_()), *[(c, pa.int64()) for c in ("file", "owner", "block")], ("text", pa.string())])

    def batch(texts: pa.Array, part: bool) -> pa.RecordBatch:
        n = len(texts)
        same = [pa.array(np.full(n, state[c], dtype="int64")) for c in ("file", "owner", "block")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), *same, texts], schema=schema)

    def rest() -> Iterator[pa.RecordBatch]:
        """What is left at the end of a block: a part, or what follows the last record."""
        text = b"".join(waiting)
        if text and state["depth"] > 0:
            yield batch(pa.array([text.decode("utf-8", "replace")]), True)
        elif junk := text.decode("utf-8", "replace").rstrip("}").strip(BETWEEN):
            raise ValueError(NO_OBJECT + junk[:100])

    for new, fields, data in block_runs(batches):
        if new:
            yield from rest()
            waiting, state = [], fields | {"begun": fields["depth"] == 0}
            if state["begun"]:
                state["owner"] = state["block"]
        place, step, odd = marks(data)
        depth = state["depth"] + np.cumsum(np.where(odd == state["inside"], step, 0))
        ends = place[(depth == 0) & (step < 0) & (odd == state["inside"])] + 1
        if len(ends):
            waiting.append(data[: ends[0]].tobytes())
            yield batch(pa.array([b"".join(waiting).decode("utf-8", "replace")]), not state["begun"])
            state |= {"begun": True, "owner": state["block"]}
            held = pa.py_buffer(data[: ends[-1]].tobytes())
            yield batch(pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype("int32").tobytes()), held), False)
            waiting = []
        waiting.append(data[ends[-1] if len(ends) else 0 :].tobytes())
        state |= {"inside": int(state["inside"] + odd[-1]) % 2, "depth": int(depth[-1])}
    yield from rest()


def one_line(text: Column) -> Column:
    """A record without what stands before it, and without line ends, which can only stand between its tokens."""
    line = F.ltrim(F.translate(text, "\n\r", "  "), F.lit(BETWEEN))
    return F.when(line.startswith("{"), line).otherwise(F.raise_error(F.concat(F.lit(NO_OBJECT), F.left(line, F.lit(100)))))


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON files that hold an array of objects, one object, or objects one after the other.

    One document of any size is read by many tasks: a first pass finds how many strings and braces each
    byte range opens and closes, whatever state it starts in; the driver adds these up (one row per range,
    as many as the ranges it hands out); a second pass cuts the records, and parts of records that reach
    across a border are put together by record. The records go as lines to the shared folder of
    ``spark.checkpoint.dir``, which the result reads. Elements that are no objects and documents
    that end early raise an error. Files without records give no rows.
    """
    source = pieces(spark, path)
    starts = block_starts(source.mapInArrow(summarise, SUMMARY).collect())
    empty = spark.createDataFrame([], schema or "struct<>")
    if not starts:
        return empty
    # Not larger than the list of byte ranges of the scan.
    known = F.broadcast(spark.createDataFrame(starts, STARTS))
    placed = source.join(known, ["file", "block"]).select("file", "block", "inside", "depth", "owner", "text")
    folder = f"{ensure_checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    found = placed.mapInArrow(cut, CUTS)
    line = F.when(F.col("part"), F.to_json(F.struct("file", "owner", "block", "text"))).otherwise(one_line(F.col("text")))
    kind = F.when(F.col("part"), "part").otherwise("whole")
    found.select(line.alias("value"), kind.alias("kind")).write.partitionBy("kind").text(folder)
    if any(depth > 0 for _, _, _, depth, _ in starts):
        parts = spark.read.text(f"{folder}/kind=part").select(F.from_json("value", PARTS).alias("p")).select("p.*")
        # The group is one record.
        joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("found"))
        joined.select(one_line(F.array_join("found.text", "")).alias("value")).write.text(f"{folder}/kind=joined")
    written = spark.read.text(folder)
    kinds = {r["kind"] for r in written.select("kind").distinct().collect()} if "kind" in written.columns else set()
    lines = [f"{folder}/kind={k}" for k in ("whole", "joined") if k in kinds]
    if not lines:
        return empty
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(lines)
