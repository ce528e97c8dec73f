"""The prefix trie of conversations as burst tries.

A turn has an id of TURN bytes: a digest of role and text, then its number of words. A sequence
of turns is the ids in a row, so that sequences sort as bytes and turns are cut off by position.

* Equal sequences are one, with their number of conversations and least conversation.
* A container holds the suffixes that follow a trie head, at first all under the textless root.
  Containers with more than CONTAINER_TURNS turns in several suffixes burst: the head becomes a
  node of its own, and each suffix moves to the container under the head's child by its next
  turn id. This is repeated until no container bursts.
* The containers left are dealt to tasks, sorted by suffix and swept: neighbours in sorted order
  share the open nodes of their common prefix, a stack that closes as the sweep leaves them.
  Closing a node gives its totals to its parent.
* Totals of the containers then rise through the burst heads, round by round.

A task of the sweep holds one path of open nodes with their closed children, of one container at
a time. Conversations are cut into segments of SEGMENT_TURNS; a longer one lies in the tries
under the heads where its segments end, which are built from the deepest up, so that no row holds
more than a segment. A conversation of a third of all rows is numbered by ranges of its turns.

Rounds of bursting follow the depth up to which more than CONTAINER_TURNS turns in different
suffixes share a prefix; equal suffixes don't count, as they are one.

Turns are ordered by turn (null first), then by the id of role and text, so that repeated rows
are turns of their own next to each other. Null roles and texts are empty. Rows without a
conversation id are left out. Conversations that end nowhere else end at the root; an empty
table has no nodes. Only the four columns named are read.

The ids of the conversations that end at a node are hashed in one pass over their sorted order,
which the contract's digest needs; a task holds one id at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderloom.llm.common import WORD, broadcast_if_few, text_or_empty
from tenderloom.session import cut_lineage, parallelism

#: Bytes of a turn id: a digest, and the number of words.
DIGEST, TURN = 16, 20
#: Turns a container may have, and turns of a segment.
CONTAINER_TURNS, SEGMENT_TURNS = 4096, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: The root's name.
ROOT = bytes(DIGEST)


def turn_id(role: Column, text: Column) -> Column:
    """Digest and number of words of a turn, in hexadecimal."""
    role, text = text_or_empty(role), text_or_empty(text)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lower(F.lpad(F.hex(words), 2 * (TURN - DIGEST), "0")))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, in order) and id of each turn of turns (conv_id, turn, id).

    Rows are sorted across tasks and numbered within each; a conversation that spans tasks goes on
    where it stopped. Only conversations at the edges of a task's range do, at most two a task.
    """

    def work(batches):
        last, count, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            convs = batch["conv_id"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], convs[1:] != convs[:-1]])) if len(convs) else np.zeros(0, int)
            pos = np.arange(1, len(convs) + 1) - np.repeat(starts, np.diff([*starts, len(convs)]))
            if len(convs):
                first = len(convs) if len(starts) == 1 else starts[1]
                if convs[0] == last:
                    pos[:first] += count
                last, count = convs[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(pos, pa.int64()), batch["id"], pa.array(np.full(len(convs), part, np.int32))], ["conv_id", "pos", "id", "part"])

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id"), F.col("n")]
    unique = turns.withColumn("n", F.monotonically_increasing_id())  # equal rows can lie in several ranges
    dealt = unique.repartitionByRange(parallelism(turns.sparkSession), *order).sortWithinPartitions(*order)
    made = cut_lineage(dealt.select("conv_id", "id").mapInArrow(work, "conv_id long, pos long, id string, part int"))
    ends = made.groupBy("conv_id", "part").agg(F.max("pos").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.withColumn("before", F.sum("n").over(before)).filter("before IS NOT NULL").select("conv_id", "part", "before")
    # At most one conversation a range goes on from an earlier one.
    moved = made.join(F.broadcast(shift), ["conv_id", "part"], "left")
    return moved.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "id")


def rebuilt(own: DataFrame, group: int, most: int) -> DataFrame:
    """conv_id, pos and id of the turns of the rebuilt conversations; each has a row more, without id, at its end."""
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    donor = F.col("conv_id") - F.col("conv_id") % group
    # A donor has fewer than `most` turns to give, to fewer than 2 * group conversations.
    given = own.filter((F.col("pos") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("donor"), "pos", "id")
    have = given.groupBy("donor").agg(F.max("pos").alias("have"))
    lengths = own.groupBy("conv_id").agg(F.max("pos").alias("length"))
    convs = lengths.select("conv_id", "length", h.alias("h"), donor.alias("donor")).join(have, "donor", "left")
    convs = cut_lineage(convs.select("conv_id", "donor", "length", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("lent")))
    lent = convs.filter("lent > 0").join(given, "donor").filter("pos <= h").select("conv_id", "pos", "id")
    kept = own.join(convs.select("conv_id", "h", "lent"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "id")
    ends = convs.select("conv_id", (F.col("lent") + F.greatest(F.col("length") - F.col("h"), F.lit(0)) + 1).alias("pos"), F.lit(None).cast("string").alias("id"))
    return lent.union(kept).union(ends)


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, segment (from 0), head, name (of the nodes before and at its end) and seq, its turn ids.

    A conversation's last segment is the one that isn't full; it may be empty. The root is the
    first segment's head; nodes are named by the digests of all segments up to them.
    """
    segment = F.floor((F.col("pos") - 1) / SEGMENT_TURNS).cast("int")
    turn = F.when(F.col("id").isNotNull(), F.struct("pos", "id"))
    gathered = turns.groupBy("conv_id", segment.alias("segment")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = gathered.select("conv_id", "segment", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("seq")).withColumn("digest", F.md5("seq"))
    so_far = F.collect_list("digest").over(Window.partitionBy("conv_id").orderBy("segment"))
    named = lambda up_to: F.unhex(F.md5(F.array_join(up_to, "").cast("binary")))
    made = whole.withColumn("so_far", so_far)
    head = F.when(F.col("segment") == 0, F.lit(ROOT)).otherwise(named(F.slice("so_far", 1, F.col("segment"))))
    return made.select("conv_id", "segment", head.alias("head"), named(F.col("so_far")).alias("name"), "seq")


def digests(ended: DataFrame) -> DataFrame:
    """name and ends_sha256, the hash of its conversations' ids in order, of each of ended (name, conv_id)."""

    def work(batches):
        last, sha, out = None, None, []
        for batch in batches:
            for name, conv in zip(batch["name"].to_pylist(), batch["conv_id"].to_pylist()):
                if name == last:
                    sha.update(b",%d" % conv)
                    continue
                if sha:
                    out.append((last, sha.hexdigest()))
                last, sha = name, hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), ()), (pa.binary(), pa.string()))], ["name", "ends_sha256"])
            out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], ["name", "ends_sha256"])

    dealt = ended.repartition("name").sortWithinPartitions("name", "conv_id")
    return dealt.select("name", "conv_id").mapInArrow(work, "name binary, ends_sha256 string")


#: Nodes: below_* are of the tries under segments' ends.
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, above binary, head binary"
NODE_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("above", pa.binary()), ("head", pa.binary())]
)


class Open:
    """A node of the path that the sweep is in."""

    __slots__ = ("turn", "depth", "conv", "n", "sha", "children", "leaves", "saved", "waiting")

    def __init__(self, turn: bytes, depth: int):
        self.turn, self.depth, self.conv, self.n, self.sha = turn, depth, None, 0, None
        self.children = self.leaves = self.saved = 0
        self.waiting: list[list] = []  # closed children, without this node's conversation yet

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * int.from_bytes(self.turn[DIGEST:], "big")

    def row(self) -> list:
        return [self.conv, self.depth, None, self.n, self.children, self.leaves, self.saved, self.sha or NO_ENDS, None, None]


def sweep(rows: Iterator[dict]) -> Iterator[list]:
    """Nodes of containers from their suffixes, sorted by container and suffix.

    A container's first node is its head, whose row names the burst head above.
    """
    path: list[Open] = []
    top: dict = {}

    def leave(length: int) -> Iterator[list]:
        while len(path) > length:
            node = path.pop()
            node.close()
            for child in node.waiting:
                child[2] = node.conv
                yield child
            row = node.row()
            if path:
                above = path[-1]
                above.waiting.append(row)
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
                above.n += node.n
                above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            else:
                row[2], row[8], row[9] = top["parent_conv"], top["above"], top["container"]
                yield row

    for r in rows:
        if r["container"] != top.get("container"):
            yield from leave(0)
            top = r
            path.append(Open(r["turn"], r["depth"]))
        seq = r["seq"]
        shared = 0
        while shared + 1 < len(path) and seq[shared * TURN : (shared + 1) * TURN] == path[shared + 1].turn:
            shared += 1
        yield from leave(shared + 1)
        for at in range(shared * TURN, len(seq), TURN):
            path.append(Open(seq[at : at + TURN], path[-1].depth + 1))
        node = path[-1]
        node.n += r["n"]
        node.conv = r["conv"] if node.conv is None else min(node.conv, r["conv"])
        node.sha = r["sha"] or node.sha
        node.children += r["below_children"]
        node.leaves += r["below_leaves"]
        node.saved += r["below_saved"]
    yield from leave(0)


COLUMNS = ["container", "above", "parent_conv", "depth", "turn", "seq", "n", "conv", "sha", "below_children", "below_leaves", "below_saved"]


def swept(containers: DataFrame) -> DataFrame:
    def work(batches):
        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        out = []
        for node in sweep(rows()):
            out.append(node)
            if len(out) == 8192:
                yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NODE_SCHEMA)], schema=NODE_SCHEMA).to_batches()
                out = []
        if out:
            yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NODE_SCHEMA)], schema=NODE_SCHEMA).to_batches()

    dealt = containers.repartition("container").sortWithinPartitions("container", "seq")
    return dealt.select(*COLUMNS).mapInArrow(work, NODE)


def burst_trie(suffixes: DataFrame) -> DataFrame:
    """Nodes (NODE) of the tries whose suffixes have the columns COLUMNS.

    The tops have above null, and their own name in head.
    """
    turns = F.octet_length("seq") / TURN
    settled, heads, working = [], [], cut_lineage(suffixes)
    while True:
        full = working.groupBy("container").agg(F.sum(turns).alias("turns"), F.count("*").alias("suffixes")).filter((F.col("turns") > CONTAINER_TURNS) & (F.col("suffixes") > 1))
        full = cut_lineage(full.select("container"))
        if full.isEmpty():
            settled.append(working)
            break
        few = broadcast_if_few(full)
        settled.append(working.join(few, "container", "left_anti"))
        bursting = working.join(few, "container")
        ended = F.octet_length("seq") == 0
        sums = [F.sum(F.when(ended, F.col(c)).otherwise(0)).alias(c) for c in ("below_children", "below_leaves", "below_saved")]
        firsts = [F.first(c).alias(c) for c in ("above", "parent_conv", "depth", "turn")]
        heads.append(cut_lineage(bursting.groupBy("container").agg(*firsts, F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max(F.when(ended, F.col("sha"))).alias("sha"), *sums)))
        parents = heads[-1].select("container", F.col("conv").alias("parent"))
        next_turn = F.substring("seq", 1, TURN)
        moved = bursting.filter(~ended).join(broadcast_if_few(parents), "container")
        working = cut_lineage(
            moved.select(
                F.unhex(F.md5(F.concat("container", next_turn))).alias("container"), F.col("container").alias("above"), F.col("parent").alias("parent_conv"), (F.col("depth") + 1).alias("depth"),
                next_turn.alias("turn"), F.expr(f"substring(seq, {TURN + 1})").alias("seq"), *COLUMNS[6:],
            )
        )
    nodes = settled[0]
    for more in settled[1:]:
        nodes = nodes.union(more)
    nodes = cut_lineage(swept(nodes))
    risen = nodes.filter("above IS NOT NULL")
    for level in reversed(heads):
        sums = risen.groupBy(F.col("above").alias("container")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        words = F.conv(F.hex(F.substring("turn", DIGEST + 1, TURN - DIGEST)), 16, 10).cast("long")
        value = lambda c, below: F.coalesce(F.col(c), F.lit(0)) + F.col(below)
        made = level.join(sums, "container", "left").select(
            F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            value("c", "below_children").alias("n_children"), F.greatest(value("l", "below_leaves"), F.lit(1)).alias("n_leaves"),
            (value("s", "below_saved") + (F.col("n") - 1) * words).alias("saved_tokens"), F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"), "above", F.col("container").alias("head"),
        )
        made = cut_lineage(made)
        nodes, risen = nodes.union(made), risen.union(made.filter("above IS NOT NULL"))
    return nodes


def trie(turns: DataFrame, conv: str, turn: str, role: str, text: str, group: int = 20, most: int = 4) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    read = turns.filter(F.col(conv).isNotNull())
    own = cut_lineage(numbered(read.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("id"))))
    whole = cut_lineage(segments(rebuilt(own, group, most)))
    full = F.octet_length("seq") == SEGMENT_TURNS * TURN
    ends = digests(whole.filter(~full).select("name", "conv_id")).withColumnRenamed("ends_sha256", "sha")
    # Equal segments under one head are one.
    once = whole.groupBy("segment", "name").agg(F.first("head").alias("container"), F.first("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    once = cut_lineage(once.join(ends, "name", "left"))
    none = {c: F.lit(None).cast(t) for c, t in (("above", "binary"), ("parent_conv", "long"))}
    below, nodes = None, None
    for s in reversed(range((once.agg(F.max("segment")).first()[0] or 0) + 1)):
        level = once.filter(F.col("segment") == s)
        if below is None:
            level = level.withColumns({c: F.lit(0).cast("long") for c in COLUMNS[-3:]})
        else:
            joined = level.join(below, "name", "left").withColumn("sha", F.coalesce("sha", "below_sha"))
            level = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in COLUMNS[-3:]})
        level = level.withColumns(none | {"depth": F.lit(s * SEGMENT_TURNS).cast("long"), "turn": F.lit(bytes(TURN))})
        made = burst_trie(level.select(*COLUMNS))
        if s:  # the heads are nodes of the tries above
            heads = made.filter("head IS NOT NULL AND above IS NULL")
            below = heads.select(F.col("head").alias("name"), F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"), F.col("ends_sha256").alias("below_sha"))
            made = made.filter("head IS NULL OR above IS NOT NULL")
        nodes = made if nodes is None else nodes.union(made)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
