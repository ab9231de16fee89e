"""The prefix trie of conversations, built level by level.

A level groups its live conversations by (parent node, next turn); a group is
a node, named by the smallest conv_id in it. A group whose members have equal
turns from here on, so also a group of one, leaves the rounds: what follows
is a chain whose nodes are written down at the end from the turns of its
smallest member. So there are as many rounds as turns that two conversations
of different continuation share, whatever the length of the longest.
Then the levels are joined from the deepest up, each node taking the leaves
and savings of its children.

Turns are compared by SHA-256 digests of role and text, continuations by 128
bits folded from the digests and their places. Texts are shuffled once, to
order the turns; rounds move digests and ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernel.llm.scratch import Scratch
from quernel.llm.text import wide_hash

#: Ids of one node that are joined into one value: those that differ in so many last bits.
ID_BITS = 12


def order_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, idx, k, size): each conversation's turns numbered from 1, with the digest of role and text and the text's UTF-8 bytes.

    Turns are taken by (turn, role, text), nulls first; null roles and texts
    are empty. Rows without a conv_id belong to no conversation.
    """
    said, words = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    own = turns.filter(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("t"), said.alias("role"), words.alias("text"))
    order = W.partitionBy("c").orderBy(F.asc_nulls_first("t"), "role", "text")
    # the length of the role tells where the text begins
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return own.withColumn("idx", F.row_number().over(order)).select("c", "idx", digest.alias("k"), F.octet_length("text").cast("long").alias("size"))


def rebuild(ordered: DataFrame, head: Column, base: Column, longest_head: int) -> DataFrame:
    """Conversations that begin with the first ``head`` turns of conversation ``base`` and go on with their own turns after as many.

    ``head`` and ``base`` are expressions on ``c``; ``longest_head`` bounds
    ``head``, so that only that many turns of a base are sent to others.
    Returns (c, idx, k, size) and, for every conversation, a row of index 0
    without a turn.
    """
    every = ordered.select("c").distinct()
    wants = every.select(F.col("c").alias("to"), base.alias("b"), head.alias("h")).filter("h > 0")
    given = ordered.filter(F.col("idx") <= longest_head)
    first = given.join(wants, (given.c == wants.b) & (given.idx <= wants.h)).select(F.col("to").alias("c"), "idx", "k", "size")
    start = every.select("c", F.lit(0).alias("idx"), F.lit(None).cast("binary").alias("k"), F.lit(0).cast("long").alias("size"))
    return start.unionByName(first).unionByName(ordered.filter(F.col("idx") > head))


def _with_rests(rebuilt: DataFrame) -> DataFrame:
    """(c, pos, k, size, n, rest1, rest2, later): the place of each turn, the number of turns, and of the turns after it a hash and the bytes."""
    # from the last turn on: frames that end before the row are running sums
    order = W.partitionBy("c").orderBy(F.desc("idx"))
    after = order.rowsBetween(W.unboundedPreceding, -1)
    numbered = rebuilt.withColumns({"left": F.row_number().over(order) - 1, "n": (F.count("*").over(W.partitionBy("c")) - 1).cast("int")})
    placed = numbered.withColumn("pos", F.col("n") - F.col("left"))
    h1, h2 = wide_hash(F.col("pos"), F.col("k"))
    none = F.lit(0).cast("long")
    return (
        placed.withColumns({"h1": h1, "h2": h2})
        .withColumns({"rest1": F.coalesce(F.bit_xor("h1").over(after), none), "rest2": F.coalesce(F.bit_xor("h2").over(after), none), "later": F.coalesce(F.sum("size").over(after), none)})
        .select("c", "pos", "k", "size", "n", "rest1", "rest2", "later")
    )


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of ``rows``: id, its smallest member, n_convs, and whether all members go on alike."""
    alike = [F.min(x) == F.max(x) for x in ("n", "rest1", "rest2")]
    return rows.groupBy(*keys).agg(F.min("c").alias("id"), F.count("*").alias("n_convs"), (alike[0] & alike[1] & alike[2]).alias("closed"))


def _digests(spark: SparkSession, ends: DataFrame) -> DataFrame:
    """(id, depth, ends_sha256) of nodes at which conversations end: (id, depth, c).

    Ids of a range are joined in one row; a node's rows then pass in order
    through one streaming digest, which holds none of them. SHA-256 has to
    see a node's ids one after another, so that much is one task's work.
    """
    block = F.shiftright("c", ID_BITS)
    ids = ends.groupBy("id", "depth", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for i, depth, told in zip(*(batch.column(n).to_pylist() for n in ("id", "depth", "ids"))):
                if (i, depth) == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (i, depth), hashlib.sha256()
                digest.update(told.encode())
            if done:
                yield _rows(done)
        if at is not None:
            yield _rows([(*at, digest.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.string())], ["id", "depth", "ends_sha256"])

    return ids.repartition("id", "depth").sortWithinPartitions("id", "depth", "block").mapInArrow(run, "id long, depth int, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", head: Column | None = None, base: Column | None = None, longest_head: int = 0) -> DataFrame:
    """One row per node of the trie: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root, of depth 0, has no turn and no parent. n_leaves counts the
    childless nodes of a node's subtree, itself included; saved_tokens sums
    over the subtree (n_convs - 1) times the UTF-8 bytes of a node's last
    text; ends_sha256 digests the ids of the conversations that end at the
    node, ascending and joined by commas.

    With ``head`` and ``base``, expressions on the conversation's id ``c``,
    conversations are rebuilt first (see ``rebuild``). Turns are taken by
    (turn, role, text), nulls first: ties have one order, repeated rows stay
    as repeated turns. Null roles and texts count as empty, rows with a null
    conv_id are in no conversation, other columns are ignored. An empty table
    has no conversations and so no nodes, not even a root.

    A node may hold a third of all conversations: groups are counted before
    the shuffle, and members get their node by an equi-join, which adaptive
    execution splits. Every level is written, so that a lost executor costs
    its tasks only.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    ordered = order_turns(turns, conv, turn, role, text)
    if head is not None:
        ordered = rebuild(scratch.keep(ordered), head, base, longest_head)
    else:
        every = ordered.select("c").distinct()
        ordered = every.select("c", F.lit(0).alias("idx"), F.lit(None).cast("binary").alias("k"), F.lit(0).cast("long").alias("size")).unionByName(ordered)
    # sorted by place, so that a round's filter skips the pages of other places
    held = scratch.keep(_with_rests(ordered).sortWithinPartitions("pos"))
    top = held.filter("pos = 0")
    root = _grouped(top, [])
    members = top.crossJoin(F.broadcast(root.filter("id IS NOT NULL")))  # one row
    shape = ["c", "id", F.col("pos").alias("depth"), "parent", "n_convs", "closed", "n", "size", "later"]
    levels = [scratch.keep(members.withColumn("parent", F.lit(None).cast("long")).select(*shape))]
    while not (live := levels[-1].filter("NOT closed AND n > depth")).isEmpty():
        depth = len(levels)
        rows = held.filter(F.col("pos") == depth).join(live.select("c", F.col("id").alias("parent")), "c")
        # read back, so that both sides of the join are plain exchanges, of which adaptive execution splits a hot one
        nodes = scratch.keep(_grouped(rows, ["parent", "k"]))
        levels.append(scratch.keep(rows.join(nodes, ["parent", "k"]).select(*shape)))

    # from the deepest level up; a closed node's chain has its leaf and its later bytes
    below, up = None, []
    for level in reversed(levels):
        nodes = level.filter("c = id")
        others = F.col("n_convs") - 1
        if below is None:
            nodes = nodes.withColumns({"children": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
        else:
            sums = below.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            nodes = nodes.join(sums, "id", "left")
        below = scratch.keep(
            nodes.select(
                "id", "depth", "parent", "n_convs", "closed", "n",
                F.when(F.col("closed"), (F.col("n") > F.col("depth")).cast("long")).otherwise(F.col("children")).alias("n_children"),
                F.when(F.col("closed"), F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
                (others * F.col("size") + F.when(F.col("closed"), others * F.col("later")).otherwise(F.col("saved"))).alias("saved_tokens"),
            )
        )
        up.append(below)

    shown = ["id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    found = up[0].select(*shown)
    for x in up[1:]:
        found = found.unionByName(x.select(*shown))
    closed = up[0].filter("closed AND n > depth")
    for x in up[1:]:
        closed = closed.unionByName(x.filter("closed AND n > depth"))
    tops = closed.select("id", F.col("depth").alias("from"), "n_convs")
    others = F.col("n_convs") - 1
    chain = held.join(tops, (held.c == tops.id) & (held.pos > tops["from"])).select(
        "id", F.col("pos").alias("depth"), F.col("id").alias("parent"), "n_convs", (F.col("n") > F.col("pos")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (others * (F.col("size") + F.col("later"))).alias("saved_tokens")
    )
    last = levels[0].filter("closed OR n = depth")
    for x in levels[1:]:
        last = last.unionByName(x.filter("closed OR n = depth"))
    ends = _digests(spark, last.select("id", F.col("n").alias("depth"), "c"))
    nodes = found.unionByName(chain).withColumn("depth", F.col("depth").cast("int"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends, ["id", "depth"], "left").select(
        F.col("id").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
