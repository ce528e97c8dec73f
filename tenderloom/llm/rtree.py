"""Hard negatives by a best-first search over a sort-tile-recursively packed R-tree.

* Sort: rows are ordered across the table by label, first coordinate and row number, so that the
  ranges a task gets are equally large whatever vector or label is frequent.
* Tile: the order is cut into tiles of TILE_ROWS, each with its minimum bounding box and range of
  labels.
* Recursive: a tile is packed into a tree: sorted by its widest coordinate, cut into SLABS slabs
  of equal size, and so on down to leaves of LEAF_ROWS; every node has its bounding box.

The inner product of a query q with anything in a box [lo, hi] lies between the sum of
min(q lo, q hi) and the sum of max(q lo, q hi). A search has score windows and keeps the k best
scores in each. Its queue hands out the box with the highest bound first. Boxes outside all
windows, and boxes strictly below the k-th best score of each window they meet, are left out;
equal ones are not, as ties go to the smaller id.

Across tiles a search runs twice: first over one tile (for positives the query's own, for
negatives the one with the highest bound), whose k-th best scores then rule out most other tiles
by their boxes alone. The queries that a tile must answer are dealt to groups, so that a group
holds one tile and a bounded number of queries. All scores are exact integers; a score beyond a
long raises, as does a
hundred times a positive's.

Null labels, null vectors and such with null or non-finite components take no part. A shorter
vector has 0 in the places it lacks. A row with a null id is no anchor and comes last among ties.
Repeated rows are rows of their own. An anchor without another row of its label, or without a
row inside a window, has no rows in the result; nor has an empty table. Only the three columns
named are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderloom.llm.vectors import integer_rows, largest, matrix, number_kind, widened
from tenderloom.session import cut_lineage, parallelism

TILE_ROWS, SLABS, LEAF_ROWS = 4096, 4, 64
#: Tiles whose boxes are looked at together, and queries of a group.
PAGE_TILES, GROUP_QUERIES = 512, 512
#: Ends of a window without ends; scores are smaller.
OPEN = (1 << 63) - 1

TILE = "tile long, lo array<long>, hi array<long>, first_label int, last_label int, vectors binary, ids array<long>, labels array<int>, rows array<long>, nodes binary, boxes binary"
TILE_SCHEMA = pa.schema(
    [("tile", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), ("first_label", pa.int32()), ("last_label", pa.int32()), ("vectors", pa.binary())]
    + [("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("rows", pa.list_(pa.int64())), ("nodes", pa.binary()), ("boxes", pa.binary())]
)


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of x, and the nodes (start, end, first child, last child + 1) over that order.

    Node 0 is the root; children follow their parents; a leaf has no child.
    """
    order, nodes, at = np.arange(len(x)), [[0, len(x), 0, 0]], 0
    while at < len(nodes):
        start, end = nodes[at][:2]
        if end - start > LEAF_ROWS:
            part = x[order[start:end]]
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if x.shape[1] else 0
            if x.shape[1]:
                order[start:end] = order[start:end][np.argsort(part[:, widest], kind="stable")]
            cuts = np.linspace(start, end, SLABS + 1).astype(int)
            nodes[at][2:] = [len(nodes), len(nodes) + SLABS]
            nodes += [[a, b, 0, 0] for a, b in zip(cuts, cuts[1:])]
        at += 1
    return order, np.array(nodes, np.int32)


def tile_row(tile: int, part: pa.Table) -> dict:
    x = matrix(part["x"])
    order, nodes = pack(x)
    x, part = x[order], part.take(order)
    boxes = np.array([[x[a:b].min(axis=0), x[a:b].max(axis=0)] for a, b in nodes[:, :2].tolist()], np.int64)
    labels = part["label"].to_pylist()
    return {
        "tile": tile, "lo": boxes[0, 0].tolist(), "hi": boxes[0, 1].tolist(), "first_label": min(labels), "last_label": max(labels), "vectors": x.tobytes(),
        "ids": part["id"].to_pylist(), "labels": labels, "rows": part["row"].to_pylist(), "nodes": nodes.tobytes(), "boxes": boxes.tobytes(),
    }


def tiles(rows: DataFrame) -> DataFrame:
    """The packed tiles of rows (row, id, label, x), one row each."""

    def work(batches):
        task, made, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in held) >= TILE_ROWS:
                whole = pa.concat_tables(held)
                yield from pa.Table.from_pylist([tile_row(task + made, whole.slice(0, TILE_ROWS))], TILE_SCHEMA).to_batches()
                held, made = [whole.slice(TILE_ROWS)], made + 1
        rest = pa.concat_tables(held) if held else None
        if rest is not None and rest.num_rows:
            yield from pa.Table.from_pylist([tile_row(task + made, rest)], TILE_SCHEMA).to_batches()

    order = ["label", F.get("x", 0), "row"]
    dealt = rows.repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("row", "id", "label", "x").mapInArrow(work, TILE)


class Tree:
    """One tile, ready for searches by queries as large as most."""

    def __init__(self, tile: dict, width: int, most: int):
        rows = len(tile["rows"])
        x = np.frombuffer(tile["vectors"], np.int64).reshape(rows, -1)
        kind = number_kind(max(width, x.shape[1]), largest(x), most)
        self.nodes = np.frombuffer(tile["nodes"], np.int32).reshape(-1, 4).tolist()
        boxes = np.frombuffer(tile["boxes"], np.int64).reshape(len(self.nodes), 2, -1)
        self.x = widened(x, width).astype(kind)
        self.lo, self.hi = (widened(boxes[:, i], width).astype(kind) for i in (0, 1))
        # Ids in order, null ones last; a place stands for an id from here on.
        self.ids, self.rows, self.labels = tile["ids"], np.array(tile["rows"], np.int64), np.array(tile["labels"], np.int32)
        unnamed, named = np.array([i is None for i in self.ids]), np.array([i or 0 for i in self.ids], np.int64)
        self.rank = np.empty(rows, np.int64)
        self.rank[np.lexsort((self.rows, named, unnamed))] = np.arange(rows)

    def search(self, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
        """(window, place, score) of the k best rows of each window (low, high, least score of use), of the same label or of others."""
        q = np.pad(q, (0, self.x.shape[1] - len(q))).astype(self.x.dtype)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        above, below = (a.tolist() for a in (self.hi @ up + self.lo @ down, self.lo @ up + self.hi @ down))
        kept: list[list[tuple[int, int, int]]] = [[] for _ in windows]  # (-score, rank, place), best first

        # The least score that a window takes, and the least of these: one comparison leaves most rows and boxes out.
        bars = [max(low, floor) for low, _, floor in windows]
        lowest, highest = min(bars), max(high for _, high, _ in windows)

        def open_to(node: int) -> bool:
            return above[node] >= lowest and any(above[node] >= bar and below[node] <= high for (_, high, _), bar in zip(windows, bars))

        queue = [(-min(above[0], highest), 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            if not open_to(node):
                continue
            start, end, child, after = self.nodes[node]
            for c in range(child, after):
                if open_to(c):
                    heapq.heappush(queue, (-min(above[c], highest), c))
            if child:
                continue
            scores = self.x[start:end] @ q
            at = np.flatnonzero((scores >= lowest) & (scores <= highest))
            if not len(at):
                continue
            fits = (self.labels[start:end][at] == label) == same
            if same:
                fits &= self.rows[start:end][at] != own
            at = at[fits]
            scores = scores[at].astype(np.int64)
            for w, (_, high, _) in enumerate(windows):
                hit = np.flatnonzero((scores >= bars[w]) & (scores <= high))
                if len(hit):
                    places = at[hit] + start
                    both = kept[w] + list(zip((-scores[hit]).tolist(), self.rank[places].tolist(), places.tolist()))
                    kept[w] = heapq.nsmallest(k, both)
                    if len(kept[w]) == k and -kept[w][-1][0] > bars[w]:
                        bars[w] = -kept[w][-1][0]
                        lowest = min(bars)
        return [(w, p, -s) for w, best in enumerate(kept) for s, _, p in best]


ASKED = "row long, x array<long>, label int, windows array<struct<low:long,high:long,floor:long>>"


def visit(asked: DataFrame, packed: DataFrame, same: bool, k: int) -> DataFrame:
    """row, window, id, found (a row), score: the k best of each window of asked (tile and the columns of ASKED) in its tile."""
    # A group has one tile and about GROUP_QUERIES of its queries.
    groups = asked.groupBy("tile").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("groups"))
    wide = packed.join(groups, "tile").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = asked.join(groups, "tile").withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int"))

    def work(queries, tile):
        out = []
        if queries.num_rows and tile.num_rows:
            x = matrix(queries["x"])
            tree = Tree(tile.to_pylist()[0], x.shape[1], largest(x))
            for i, (row, label, windows) in enumerate(zip(*(queries[c].to_pylist() for c in ("row", "label", "windows")))):
                found = tree.search(x[i], row, label, same, [(w["low"], w["high"], w["floor"]) for w in windows], k)
                out += [(row, w, tree.ids[p], int(tree.rows[p]), s) for w, p, s in found]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], ["row", "window", "id", "found", "score"])

    key = ["tile", "group"]
    dealt = dealt.select(*key, "row", "x", "label", "windows")
    wide = wide.select(*key, "vectors", "ids", "labels", "rows", "nodes", "boxes")
    return dealt.groupBy(*key).cogroup(wide.groupBy(*key)).applyInArrow(work, "row long, window int, id long, found long, score long")


def open_tiles(asked: DataFrame, packed: DataFrame, same: bool) -> DataFrame:
    """asked beside each tile whose box and labels its windows leave open, and the highest score the box lets them have."""
    n, q = packed.count(), asked.count()
    pages, groups = max(1, -(-n // PAGE_TILES)), max(1, -(-q // GROUP_QUERIES))
    boxes = packed.select("tile", "lo", "hi", "first_label", "last_label", F.pmod(F.xxhash64("tile"), F.lit(pages)).cast("int").alias("page"))
    boxes = boxes.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = asked.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    schema = "tile long, bound long, row long"

    def work(queries, page):
        found = []
        if queries.num_rows and page.num_rows:
            x, lo, hi = (matrix(c) for c in (queries["x"], page["lo"], page["hi"]))
            width = max(x.shape[1], lo.shape[1])
            kind = number_kind(width, largest(x), max(largest(lo), largest(hi)))
            x, lo, hi = (widened(m, width).astype(kind) for m in (x, lo, hi))
            up, down = np.maximum(x, 0), np.minimum(x, 0)
            above, below = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
            tile, first, last = (page[c].to_numpy() for c in ("tile", "first_label", "last_label"))
            for i, (row, label, windows) in enumerate(zip(*(queries[c].to_pylist() for c in ("row", "label", "windows")))):
                labels = (first <= label) & (label <= last) if same else (first != label) | (label != last)
                fits = np.zeros(len(tile), bool)
                for w in windows:
                    fits |= (above[i] >= max(w["low"], w["floor"])) & (below[i] <= w["high"])
                at = np.flatnonzero(fits & labels)
                found.append((tile[at], np.minimum(above[i][at], max(w["high"] for w in windows) if windows else 0).astype(np.int64), np.full(len(at), row)))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tile", "bound", "row"])

    key = ["page", "group"]
    return dealt.select(*key, "row", "x", "label", "windows").groupBy(*key).cogroup(boxes.groupBy(*key)).applyInArrow(work, schema)


def _ranked(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "found")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _floors(hits: DataFrame, k: int) -> DataFrame:
    """row, floors: the k-th best score by window, where there are k."""
    each = hits.groupBy("row", "window").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    return each.filter("floor IS NOT NULL").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("floors"))


def _raised(asked: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """asked with the floors that hits give its windows; at most the number of windows is gathered."""
    raised = F.transform("windows", lambda w, i: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.try_element_at("floors", i), w["floor"]).alias("floor")))
    return asked.join(_floors(hits, k), "row", "left").withColumn("windows", F.when(F.col("floors").isNull(), F.col("windows")).otherwise(raised)).drop("floors")


def hard_negatives(
    vectors: DataFrame, id_column: str, vector: str, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the best rows of its label; a positive's negatives are the best rows
    of other labels whose scores are least to most per cent of the positive's.
    """
    named, anchors = F.col(id_column).cast("long"), F.coalesce(is_anchor, F.lit(False))
    rows = integer_rows(vectors.filter(label.isNotNull()), vector, named.alias("id"), label.cast("int").alias("label"), (anchors & named.isNotNull()).alias("asks"))
    packed = cut_lineage(tiles(rows))
    whole = F.array(F.struct(F.lit(-OPEN).alias("low"), F.lit(OPEN).alias("high"), F.lit(-OPEN).alias("floor")))
    asked = rows.filter("asks").select("row", "id", "x", "label", whole.alias("windows"))
    asked = cut_lineage(asked.join(packed.select("tile", F.explode("rows").alias("row")), "row"))

    first = cut_lineage(visit(asked, packed, True, positives))
    raised = cut_lineage(_raised(asked.withColumnRenamed("tile", "home"), first, positives))
    others = raised.join(open_tiles(raised, packed, True), "row").filter("tile <> home")
    best = cut_lineage(_ranked(first.union(visit(others, packed, True, positives)), ["row"], positives).select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive")))

    # A window per score that a positive has; below 0 it is empty.
    window = F.struct(F.col("positive"), F.expr(f"(positive * {least} + 99) div 100").alias("low"), F.expr(f"(positive * {most}) div 100").alias("high"))
    each = best.filter("positive >= 0").withColumn("w", window).filter("w.low <= w.high").groupBy("row").agg(F.sort_array(F.collect_set("w")).alias("w"))
    bare = F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.lit(-OPEN).alias("floor")))
    sought = cut_lineage(asked.select("row", "id", "x", "label").join(each, "row").withColumn("windows", bare))
    pairs = cut_lineage(open_tiles(sought, packed, False))
    seeds = pairs.groupBy("row").agg(F.max(F.struct("bound", "tile"))["tile"].alias("seed"))
    first = cut_lineage(visit(sought.join(seeds.withColumnRenamed("seed", "tile"), "row"), packed, False, negatives))
    raised = cut_lineage(_raised(sought, first, negatives).join(seeds, "row"))
    others = raised.join(pairs, "row").filter(F.col("tile") != F.col("seed"))
    others = others.filter(F.exists("windows", lambda w: F.col("bound") >= F.greatest(w["low"], w["floor"])))
    hits = _ranked(first.union(visit(others, packed, False, negatives)), ["row", "window"], negatives)
    scored = hits.join(sought.select("row", F.col("id").alias("anchor_id"), "w"), "row").withColumn("positive", F.col("w")[F.col("window")]["positive"])
    return (
        scored.select("row", "anchor_id", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(best, ["row", "positive"])
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("positive").alias("positive_score"), "negative_score")
    )
