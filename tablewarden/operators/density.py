"""Density noise: rows that are neither dense themselves nor near a dense row.

A row is core when at least ``min_samples`` rows (itself included) lie within ``eps``;
it is noise when it is not core and no core row lies within ``eps``. Cluster labels are not
needed. Values are standardised beforehand.

Over one column this is a sweep in value order; over several, pairs of boxes of rows are
settled as a whole where their distances allow it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.runtime import materialize, task_buckets

# Cells of up to so many columns shrink by the wide factor (a power of two) from level to level, others by 2.
CELL_COLUMNS = 3
WIDE_FACTOR = 4
# Levels of the box tree at most; values carry nine decimals, so deeper cells hold one row.
MOST_LEVELS = 60
# Row pairs of a pair of boxes, on average, at which boxes are not cut further.
PAIR_WORK = 1 << 28
# Rows of a small box, on average where a row is (boxes of twice its side come first), and halvings of the widest side to its cell at most.
BOX_ROWS, MOST_HALVINGS = 16, 50
# Points and queries up to which all boxes are rows, and open rows up to which boxes of half the side are left out.
FEW_ROWS, MANY_ROWS = 1 << 14, 1 << 17
# Rows or boxes of a cell that are sent in one list, at most.
LIST_ROWS = 512
# Sides of the boxes that rows lie in once cells are cut below the small boxes, as a part (a power of two) of their cell's: of up to
# CELL_COLUMNS columns, and of more.
LIST_PARTS = (8, 2)
# Rows that are compared in one group, at least and at most; between, each core gets GROUPS_PER_CORE groups.
GROUP_ROWS = (512, 16_384)
GROUPS_PER_CORE = 8
# Rows that a group takes from its stream at a time, and rows of it and distances that are worked on at a time.
CHUNK_ROWS, LIST_BLOCK, BLOCK = 1 << 17, 32, 1 << 16


def noise_1d(points: DataFrame, limits: DataFrame, eps: float) -> DataFrame:
    """Noise values per column.

    ``points`` is ``column, value, n`` with distinct standardised values, ``limits`` is
    ``column, min_samples``. Returns ``column, value`` of the noise.
    """
    points = materialize(points)
    edges = _shared_edges(points)
    cell = F.floor(F.col("value") / eps).alias("cell")
    cells = points.groupBy("column", cell).agg(F.sum("n").alias("cell_rows"))
    dense = (
        cells.join(F.broadcast(limits), "column")  # one row per column
        .where(F.col("cell_rows") >= F.col("min_samples"))
        .select("column", "cell", F.lit(True).alias("dense"))
    )
    marked = points.withColumn("cell", cell).join(F.broadcast(dense), ["column", "cell"], "left")
    marked = materialize(marked.select("column", "value", "n", F.coalesce("dense", F.lit(False)).alias("dense")))
    sparse = marked.where("not dense").select("column", "value")
    near = weight_within(marked.select("column", "value", F.col("n").alias("weight")), sparse, eps, edges)
    judged = materialize(
        near.join(F.broadcast(limits), "column").select(
            "column", "value", (F.col("weight") >= F.col("min_samples")).alias("core")
        )
    )
    cores = (
        marked.where("dense").select("column", "value")
        .unionByName(judged.where("core").select("column", "value"))
        .withColumn("weight", F.lit(1).cast("bigint"))
    )
    others = judged.where("not core").select("column", "value")
    return weight_within(cores, others, eps, edges).where("weight = 0").select("column", "value")


def _shared_edges(points: DataFrame) -> list[float]:
    buckets = task_buckets(points.sparkSession)
    probs = [i / buckets for i in range(1, buckets)]
    found = points.agg(F.percentile_approx("value", probs, 10 * buckets).alias("e")).first()["e"]
    return sorted(set(found or []))


def weight_within(points: DataFrame, queries: DataFrame, eps: float, edges: list[float]) -> DataFrame:
    """Total weight of the points within ``eps`` of each query value, per column.

    A sweep in value order: every query asks for the running weight at its two ends. Sums run
    inside value ranges and are moved on by the small table of range totals.
    """
    # At equal positions: lower ends come before the points, upper ends after them.
    marks = points.select(
        "column", F.col("value").alias("position"), F.lit(1).alias("turn"), "weight",
        F.lit(None).cast("double").alias("value"),
    )
    for turn, shift in ((0, -eps), (2, eps)):
        marks = marks.unionByName(
            queries.select(
                "column", (F.col("value") + F.lit(shift)).alias("position"), F.lit(turn).alias("turn"),
                F.lit(0).cast("bigint").alias("weight"), "value",
            )
        )
    ranged = Bucketizer(
        splits=[-float("inf"), *edges, float("inf")], inputCol="position", outputCol="bucket"
    ).transform(marks)
    totals = ranged.groupBy("column", "bucket").agg(F.sum("weight").alias("total"))
    before = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("column", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("column", "bucket").orderBy("position", "turn")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.withColumn("local", F.sum("weight").over(inside))
        .where("value is not null")
        .join(F.broadcast(offsets), ["column", "bucket"])  # columns x ranges rows
        .withColumn("running", F.col("local") + F.col("offset"))
        .groupBy("column", "value")
        .agg(F.sum(F.when(F.col("turn") == 2, F.col("running")).otherwise(-F.col("running"))).alias("weight"))
    )


def noise_nd(points: DataFrame, min_samples: int, eps: float) -> DataFrame:
    """Distinct noise rows of a frame whose columns are all standardised doubles."""
    names = points.columns
    rows = materialize(points.groupBy(*names).agg(F.count(F.lit(1)).alias("weight")))
    core = materialize(rows_near(rows, rows.select(*names), eps, min_samples))
    others = materialize(rows.select(*names).join(core, names, "left_anti"))
    reached = rows_near(core.withColumn("weight", F.lit(1).cast("bigint")), others, eps, 1)
    return others.join(reached, names, "left_anti")


def rows_near(points: DataFrame, queries: DataFrame, eps: float, needed: int, compared: list[int] | None = None) -> DataFrame:
    """The rows of ``queries`` that have ``points (*names, weight)`` of a total weight of ``needed`` within ``eps``.

    Both sides lie in one tree of boxes: the sides of its cells shrink by a fixed factor from level to level, and a box is what
    the rows of a cell span. Pairs of boxes are followed from the root. A pair that lies within ``eps`` as a whole adds the
    weight of the point box to all rows of the query box, one that lies apart ends, any other goes on to its children. A query box ends
    as soon as its sure weight is enough, or all that is still possible is not. The upper levels are made of small boxes,
    which are summed up once. Rows in boxes that are still in question are held against those small boxes, then against those of half
    their side, and only rows that stay in question against rows, so that work follows the border between enough and too few.

    No level, pair or row passes through the driver. ``compared`` gets the number of row pairs in the boxes that were in question last.
    """
    names = queries.columns
    spans = points.select(*names).unionByName(queries).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]).first()
    low = {c: spans[f"min_{c}"] for c in names}
    if any(v is None for v in low.values()):
        return queries.where("false")
    factor = WIDE_FACTOR if len(names) <= CELL_COLUMNS else 2
    side = max(max(spans[f"max_{c}"] - low[c] for c in names) * (1 + 1e-12), eps)
    queries = queries.distinct()
    single, fine = points.count() + queries.count() <= FEW_ROWS, side
    if single:
        held, open_units = materialize(_alone(points, names, low, fine)), _alone(queries, names, low, fine)
    else:
        small, least = _small_boxes(points, names, low, side, eps)
        fine = 2 * least
        held, open_units = materialize(_wider(small, names)), _units(queries, names, _cell(names, low, fine), [])
    open_units = open_units.withColumn("sure", F.lit(0).cast("bigint"))
    open_units = materialize(open_units.withColumn("q", _cell(names, low, side, "min_")))
    held = held.withColumn("p", _cell(names, low, side, "min_"))
    active, enough = None, []
    for _ in range(MOST_LEVELS):
        asked = _boxes(open_units, "q", names, "q", [F.max("sure").alias("sure")])
        boxes = _boxes(held, "p", names, "p", [F.sum("weight").alias("weight")])
        if active is None:
            met = asked.crossJoin(F.broadcast(boxes))  # one cell each
        else:
            met = asked.join(active, asked["q_up"] == active["q_active"]).join(boxes, F.col("p_active") == F.col("p_up"))
        state = F.when(_square(names, True) <= eps * eps, 1).when(_square(names, False) <= eps * eps, 0)
        met = met.select("q", "p", "sure", "q_rows", "p_rows", "weight", state.alias("within")).where("within is not null")
        met = materialize(met)
        known = met.groupBy("q").agg(
            (F.max("sure") + F.sum(F.when(F.col("within") == 1, F.col("weight")).otherwise(0))).alias("now"),
            F.sum(F.when(F.col("within") == 0, F.col("weight")).otherwise(0)).alias("possible"),
        )
        kept = [c for c in open_units.columns if c not in ("sure", "q", "q_up")]
        open_units = materialize(
            open_units.join(known, "q", "left").select(*kept, F.coalesce("now", "sure").alias("sure"), F.coalesce("possible", F.lit(0)).alias("possible"), "q")
        )
        settled = open_units.where(F.col("sure") >= needed)
        enough.append(_rows_of(settled, names) if single else settled.select("fine"))
        in_question = (F.col("sure") < needed) & (F.col("sure") + F.col("possible") >= needed)
        open_units = open_units.where(in_question).drop("possible")
        unsettled = known.where((F.col("now") < needed) & (F.col("now") + F.col("possible") >= needed)).select("q")
        straddling = met.where("within = 0").join(unsettled, "q", "left_semi")
        pairs, work = straddling.agg(F.count(F.lit(1)), F.sum(F.col("q_rows").cast("double") * F.col("p_rows"))).first()
        if not pairs or work <= pairs * PAIR_WORK:
            break
        active = straddling.select(F.col("q").alias("q_active"), F.col("p").alias("p_active"))
        # Halves near the end, so that boxes do not become far smaller than rows can be compared in.
        side /= factor if work > pairs * PAIR_WORK * 4 ** len(names) else 2
        if side < fine and not single:  # from here on a unit is a row
            single, settled_boxes, enough = True, enough, []
            enough.append(_in_boxes(queries, settled_boxes, names, low, fine))
            inside = open_units.select("fine", "sure", "q")
            open_units = materialize(_alone(queries, names, low, fine).join(inside, "fine"))
            held = materialize(_alone(points, names, low, fine).join(held.select("fine", "p"), "fine"))
        cell = _cell(names, low, side, "min_")
        open_units = open_units.withColumn("q_up", F.col("q")).withColumn("q", cell)
        held = held.withColumn("p_up", F.col("p")).withColumn("p", cell)
    if compared is not None:
        compared.append(int(work or 0))
    if not pairs:
        return reduce(DataFrame.unionByName, enough) if single else _in_boxes(queries, enough, names, low, fine)
    both = straddling.select("q", "p")
    if not single:
        part = _cell(names, low, 4 * fine, "min_")
        judged = materialize(_against_boxes(open_units, _ends(names), held, both, names, part, eps, needed))
        judged = judged.withColumn("fine", _cell(names, low, fine, "min_"))
        enough.append(judged.where(F.col("sure") >= needed).select("fine"))
        open_units = open_units.join(judged.where(F.col("sure") < needed).select("fine"), "fine", "left_semi")
    found = reduce(DataFrame.unionByName, enough) if single else _in_boxes(queries, enough, names, low, fine)
    if single:
        open_rows = _rows_of(open_units, names, "sure", "q")
    else:
        open_rows = queries.withColumn("fine", _cell(names, low, fine)).join(open_units.select("fine", "sure", "q"), "fine").drop("fine")
    open_rows = materialize(open_rows)
    part = _cell(names, low, side / LIST_PARTS[len(names) > CELL_COLUMNS] if single else fine)
    judged = materialize(_against_boxes(open_rows, names, held, both, names, part, eps, needed))
    found = found.unionByName(judged.where(F.col("sure") >= needed).select(*names))
    if single:  # boxes of one row leave nothing in question
        return found
    # A small box is held against rows only if the box around it straddles eps, and a row only if its small box does.
    part, rows = _cell(names, low, least), points.withColumn("around", _cell(names, low, least))
    many = judged.where(F.col("sure") < needed).count() > MANY_ROWS
    inner = small.withColumn("around", F.transform("fine", _halved)).withColumn("p", _cell(names, low, side, "min_"))
    ends = _ends(names)
    steps = [(inner, [*ends, "weight"], held), (rows, [*names, "weight"], inner)]
    if not many:
        steps = [(points.withColumn("around", _cell(names, low, fine)), [*names, "weight"], held)]
    for items, values, outer in steps:
        rest = judged.where(F.col("sure") < needed).withColumn("q", _cell(names, low, side))
        if rest.isEmpty():
            break
        around = outer.select("p", F.col("fine").alias("around"), *ends)
        judged = materialize(_narrowed(rest, items, values, around, both, names, part, eps, needed))
        found = found.unionByName(judged.where(F.col("sure") >= needed).select(*names))
    return found


def _halved(place: Column) -> Column:
    return F.shiftright(place, 1)


def _ends(names: list[str]) -> list[str]:
    return [f"{f}_{c}" for f in ("min", "max") for c in names]


def _cell(names: list[str], low: dict[str, float], side: float, mark: str = "") -> Column:
    """The cell of a row. Sides of other levels are this one times a power of two, so cells nest exactly."""
    return F.array(*[F.floor((F.col(f"{mark}{c}") - F.lit(low[c])) / F.lit(side)) for c in names])


def _units(rows: DataFrame, names: list[str], cell: Column, more: list[Column]) -> DataFrame:
    """What the rows of each small cell span, and their number."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]
    return rows.groupBy(cell.alias("fine")).agg(F.count(F.lit(1)).alias("rows"), *ends, *more)


def _wider(boxes: DataFrame, names: list[str], halvings: int = 1) -> DataFrame:
    """The boxes of cells whose sides are so many times doubled."""
    up = F.transform("fine", lambda x: F.shiftright(x, halvings)).alias("fine")
    ends = [f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]
    return boxes.groupBy(up).agg(F.sum("rows").alias("rows"), *ends, F.sum("weight").alias("weight"))


def _small_boxes(points: DataFrame, names: list[str], low: dict[str, float], side: float, eps: float) -> tuple[DataFrame, float]:
    """The points in boxes that hold about ``BOX_ROWS`` rows where a row is, and the side of their cells, a part of ``side``."""
    weight = F.sum("weight").alias("weight")
    depth = min(MOST_HALVINGS, max(1, round(math.log2(side / eps)) + 3))
    boxes = materialize(_units(points, names, _cell(names, low, side / 2**depth), [weight]))
    sums = boxes.agg(F.sum(F.col("rows").cast("double") * F.col("rows")), F.sum("rows")).first()
    deeper = math.floor(math.log2(sums[0] / sums[1] / BOX_ROWS) / len(names) + 0.5) if sums[1] else 0
    better = min(MOST_HALVINGS, max(1, depth + deeper))
    if better < depth:
        boxes = materialize(_wider(boxes, names, depth - better))
    elif better > depth:
        boxes = materialize(_units(points, names, _cell(names, low, side / 2**better), [weight]))
    return boxes, side / 2**better


def _alone(rows: DataFrame, names: list[str], low: dict[str, float], fine: float) -> DataFrame:
    """Each row as a box of its own."""
    ends = [F.col(c).alias(f"{f}_{c}") for c in names for f in ("min", "max")]
    more = [c for c in rows.columns if c not in names]
    return rows.select(_cell(names, low, fine).alias("fine"), F.lit(1).cast("bigint").alias("rows"), *ends, *more)


def _rows_of(units: DataFrame, names: list[str], *more: str) -> DataFrame:
    return units.select(*[F.col(f"min_{c}").alias(c) for c in names], *more)


def _in_boxes(rows: DataFrame, boxes: list[DataFrame], names: list[str], low: dict[str, float], fine: float) -> DataFrame:
    return rows.withColumn("fine", _cell(names, low, fine)).join(reduce(DataFrame.unionByName, boxes), "fine", "left_semi").select(*names)


def _boxes(units: DataFrame, key: str, names: list[str], mark: str, more: list[Column]) -> DataFrame:
    ends = [f(f"{f.__name__}_{c}").alias(f"{mark}_{f.__name__}_{c}") for c in names for f in (F.min, F.max)]
    up = [f"{key}_up"] if f"{key}_up" in units.columns else []
    return units.groupBy(key, *up).agg(F.sum("rows").alias(f"{mark}_rows"), *ends, *more)


def _square(names: list[str], far: bool) -> Column:
    """Squared distance between the farthest or nearest places of two boxes, added up like that of two rows: rounding is monotone, so
    no row pair of the boxes lies beyond it."""
    total = F.lit(0.0)
    for c in names:
        after, before = F.col(f"q_min_{c}") - F.col(f"p_max_{c}"), F.col(f"p_min_{c}") - F.col(f"q_max_{c}")
        gap = F.greatest(F.abs(after), F.abs(before)) if far else F.greatest(after, before, F.lit(0.0))
        total = total + gap * gap
    return total


def _packed(rows: DataFrame, keys: list[str], part: Column, values: list[str]) -> DataFrame:
    """Rows of a part in flat lists of bounded length."""
    rows = rows.select(*keys, part.alias("part"), *[F.col(c).cast("double").alias(c) for c in values])
    lists = rows.groupBy(*keys, "part").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("lists"))
    cut = rows.join(lists, [*keys, "part"]).withColumn("list", F.pmod(F.xxhash64(*values), F.col("lists")))
    return cut.groupBy(*keys, "part", "list").agg(F.flatten(F.collect_list(F.array(*values))).alias("data"))


def _grouped(asked: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    """Lists of ``asked`` dealt to groups, each a bounded share of the rows of a cell, the groups of each cell, and tasks for them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    least, most = GROUP_ROWS
    size = min(most, max(least, rows.count() // (GROUPS_PER_CORE * cores)))
    groups = materialize(rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).alias("groups")))
    asked = asked.join(groups, key).withColumn("group", F.pmod(F.xxhash64("part", "list"), F.col("groups")))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("group")
    tasks = min(GROUPS_PER_CORE * cores, groups.agg(F.sum("groups")).first()[0] or 1)
    return asked, groups.select(key, each), tasks


def _streamed(asked: DataFrame, near: DataFrame, key: str, tasks: int, make: Callable, schema: str) -> DataFrame:
    """What the groups of ``make`` find: each takes its own lists first, then those it meets."""
    group = F.concat_ws(",", F.col(key).cast("array<string>"), F.col("group").cast("string")).alias("group")
    both = asked.select(group, F.lit(0).alias("turn"), "data").unionByName(near.select(group, F.lit(1).alias("turn"), "data"))
    both = both.repartition(tasks, "group").sortWithinPartitions("group", "turn")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held_group = None, None
        for batch in batches:
            turns, data = batch["turn"].to_numpy(), batch["data"]
            for i, name in enumerate(batch["group"].to_pylist()):
                if name != last:
                    if held_group is not None:
                        yield from held_group.found()
                    last, held_group = name, make()
                (held_group.meet if turns[i] else held_group.add)(data[i].values.to_numpy())
        if held_group is not None:
            yield from held_group.found()

    return both.mapInArrow(compare, schema)


def _reach(low: list, high: list, box_low: list[np.ndarray], box_high: list[np.ndarray], limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether the farthest and the nearest places of boxes lie within the limit, added up like in ``_square``."""
    far = near = None
    for a, b, x, y in zip(low, high, box_low, box_high):
        under, over = x - b, a - y
        most = np.minimum(under, over)  # the farthest places, below 0
        np.maximum(under, over, out=under)
        np.maximum(under, 0.0, out=under)
        most *= most
        under *= under
        if far is None:
            far, near = most, under
        else:
            far += most
            near += under
    return far <= limit, near <= limit


def _against_boxes(
    open_rows: DataFrame, values: list[str], held: DataFrame, pairs: DataFrame, names: list[str], part: Column, eps: float, needed: int
) -> DataFrame:
    """The open rows that have enough with the small boxes within ``eps``, or may have with those that straddle it, and both weights.

    Open rows may be boxes as well: ``values`` names the columns of their places, low ones first.
    """
    width, limit, size = len(names), eps * eps, len(values)
    asked, groups, tasks = _grouped(_packed(open_rows, ["q"], part, [*values, "sure"]), open_rows, "q")
    boxes = _packed(held, ["p"], F.lit(0), [*_ends(names), "weight"])
    near = pairs.join(groups, "q").join(boxes, "p")

    class Group:
        def __init__(self) -> None:
            self.lists, self.boxes = [], []

        def add(self, data: np.ndarray) -> None:
            self.lists.append(data.reshape(-1, size + 1))

        def meet(self, data: np.ndarray) -> None:
            if self.lists:  # else no list of the cell fell into this group
                self.boxes.append(data.reshape(-1, 2 * width + 1))

        def found(self) -> Iterator[pa.RecordBatch]:
            if not self.lists or not self.boxes:
                return
            boxes = np.concatenate(self.boxes)
            columns = [np.ascontiguousarray(boxes[:, i]) for i in range(2 * width + 1)]
            done = [x for x in (self.judge(rows, columns) for rows in self.lists) if len(x)]
            if done:
                done = np.concatenate(done)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(done[:, i])) for i in range(size + 2)], [*values, "sure", "possible"])

        def judge(self, rows: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
            lows, highs, weight = columns[:width], columns[width : 2 * width], columns[-1]
            span = [rows[:, d].min() for d in range(width)], [rows[:, d].max() for d in range(size - width, size)]
            far, close = _reach(*span, lows, highs, limit)
            sure = rows[:, size] + weight[far].sum()
            at = np.flatnonzero(close & ~far)
            total = weight[at].sum()
            out = np.column_stack([rows[:, :size], sure, np.zeros(len(rows))])
            out = out[(sure >= needed) | (sure + total >= needed)]
            todo, step = np.flatnonzero(out[:, size] < needed), BLOCK // LIST_BLOCK
            for start in range(0, len(at) if len(todo) else 0, step):
                some = at[start : start + step]
                box_low, box_high, w = [x[some] for x in lows], [x[some] for x in highs], weight[some]
                for first in range(0, len(todo), LIST_BLOCK):
                    of = todo[first : first + LIST_BLOCK]
                    place = [out[of, d, None] for d in range(size)]
                    far, close = _reach(place[:width], place[size - width :], box_low, box_high, limit)
                    inside = far @ w
                    out[of, size] += inside
                    out[of, size + 1] += close @ w - inside
            return out[out[:, size] + out[:, size + 1] >= needed]

    schema = ", ".join(f"`{c}` double" for c in [*values, "sure", "possible"])
    return _streamed(asked, near, "q", tasks, Group, schema)


def _narrowed(
    open_rows: DataFrame, items: DataFrame, values: list[str], outer: DataFrame, pairs: DataFrame, names: list[str], part: Column, eps: float, needed: int
) -> DataFrame:
    """The open rows that have enough, or may have, once ``items`` stand for the boxes ``outer`` around them, and both weights.

    Items are boxes or rows, and ``values`` their columns. A group meets the items of those boxes that straddle for some row of its
    cell, as a stream. A row that has enough, or can not get enough any more, is not compared further.
    """
    width, limit, of_rows = len(names), eps * eps, len(values) == len(names) + 1
    open_rows = materialize(open_rows.withColumn("wide", F.transform("q", _halved)))
    asked, groups, tasks = _grouped(_packed(open_rows, ["wide"], part, [*names, "sure", "possible"]), open_rows, "wide")
    cells = open_rows.groupBy("wide").agg(*[f(c).alias(f"q_{f.__name__}_{c}") for c in names for f in (F.min, F.max)])
    both = pairs.join(open_rows.select("q", "wide").distinct(), "q").select("wide", "p").distinct()
    spans = outer.select("p", "around", *[F.col(c).alias(f"p_{c}") for c in _ends(names)])
    straddles = (_square(names, True) > eps * eps) & (_square(names, False) <= eps * eps)
    met = materialize(both.join(cells, "wide").join(spans, "p").where(straddles).select("wide", "around"))
    lists = _packed(items.join(met.select("around").distinct(), "around", "left_semi"), ["around"], F.lit(0), values)
    lists = lists.join(outer.select("around", F.array(*_ends(names)).alias("span")), "around").select("around", F.concat("span", "data").alias("data"))
    near = met.join(groups, "wide").join(lists, "around")

    class Group:
        def __init__(self) -> None:
            self.lists, self.spans, self.items, self.length = [], [], [], 0

        def add(self, data: np.ndarray) -> None:
            self.lists.append(data.reshape(-1, width + 2).copy())

        def meet(self, data: np.ndarray) -> None:
            if not self.lists:  # no list of the cell fell into this group
                return
            self.spans.append(data[: 2 * width])
            self.items.append(data[2 * width :].reshape(-1, len(values)))
            self.length += len(self.items[-1])
            if self.length >= CHUNK_ROWS:
                self.compare()

        def found(self) -> Iterator[pa.RecordBatch]:
            self.compare()
            done = [x[x[:, width] + x[:, width + 1] >= needed] for x in self.lists]
            if done and len(done := np.concatenate(done)):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(done[:, i])) for i in range(width + 2)], [*names, "sure", "possible"])

        def compare(self) -> None:
            if not self.items:
                return
            spans, rows, self.sizes = np.array(self.spans), np.concatenate(self.items), np.array([len(x) for x in self.items])
            self.spans, self.items, self.length = [], [], 0
            self.outer = [[np.ascontiguousarray(spans[:, d + i]) for d in range(width)] for i in (0, width)]
            columns = [np.ascontiguousarray(rows[:, d]) for d in range(len(values))]
            self.inner, self.weight = [columns[:width], columns[:width] if of_rows else columns[width:-1]], columns[-1]
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.outer_weight = np.add.reduceat(self.weight, self.starts)
            for mine in self.lists:
                self.hold(mine)

        def hold(self, mine: np.ndarray) -> None:
            def alive(some: np.ndarray) -> np.ndarray:
                return some[(mine[some, width] < needed) & (mine[some, width] + mine[some, width + 1] >= needed)]

            rows, step = alive(np.arange(len(mine))), BLOCK // LIST_BLOCK
            if not len(rows):
                return
            span = [[f(mine[rows, d]) for d in range(width)] for f in (np.min, np.max)]
            far, close = _reach(*span, *self.outer, limit)
            at = np.flatnonzero(close & ~far)
            for start in range(0, len(at), step):
                some = at[start : start + step]
                sizes = self.sizes[some]
                taken = np.repeat(self.starts[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                far, close = _reach(*span, *[[x[taken] for x in side] for side in self.inner], limit)
                sure = self.weight[taken[far]].sum()
                taken = taken[close & ~far]
                inner, weight = [[x[taken] for x in side] for side in self.inner], self.weight[taken]
                outer, outer_weight = [[x[some] for x in side] for side in self.outer], self.outer_weight[some]
                for first in range(0, len(rows), LIST_BLOCK):
                    of = rows[first : first + LIST_BLOCK]
                    place = [mine[of, d, None] for d in range(width)]
                    # Boxes within eps of a row are part of its sure weight already.
                    far, close = _reach(place, place, *outer, limit)
                    inside = far @ outer_weight
                    mine[of, width + 1] -= close @ outer_weight - inside
                    mine[of, width] += sure - inside
                    for begin in range(0, len(taken), max(1, BLOCK // len(of))):
                        block = slice(begin, begin + max(1, BLOCK // len(of)))
                        low, high = [[x[block] for x in side] for side in inner]
                        if of_rows:
                            met = _within(place, low, limit)
                            mine[of, width] += met @ weight[block]
                        else:
                            far, close = _reach(place, place, low, high, limit)
                            inside = far @ weight[block]
                            mine[of, width] += inside
                            mine[of, width + 1] += close @ weight[block] - inside
                rows = alive(rows)
                if not len(rows):
                    break

    schema = ", ".join(f"`{c}` double" for c in [*names, "sure", "possible"])
    return _streamed(asked, near, "wide", tasks, Group, schema)


def _within(place: list[np.ndarray], near: list[np.ndarray], limit: float) -> np.ndarray:
    """Whether the squared distance of rows, added up column by column, lies within the limit."""
    total = None
    for x, y in zip(place, near):
        gap = x - y
        gap *= gap
        if total is None:
            total = gap
        else:
            total += gap
    return total <= limit


def standardised(value: Column, mean: float, spread: float) -> Column:
    """Standardise with the population spread; a constant column becomes 0."""
    return F.round((value - F.lit(mean)) / F.lit(spread or 1.0), 9)
