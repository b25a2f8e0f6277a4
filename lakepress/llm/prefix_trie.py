"""Conversation prefix trie by smallest-member ownership.

Conversations are rebuilt from shared heads, and every distinct sequence of
first turns is a node of a trie. A node belongs to its smallest member. As the
members of a deeper node are among those of a shallower one, what a
conversation owns is a suffix of its own path: from a first owned depth on,
everything. So sums over subtrees need no walk of the trie. In the subtree of
a node, each member brings the bytes of its turns from there on (occurrence
tokens) less those of the nodes that it owns (owned tokens), which leaves the
bytes between the node and its first owned depth; and it brings a leaf where
it owns a node without children. One group-by of (node, member) rows adds them
up.

Texts are never shuffled: a turn is its SHA-256, and a node is its depth and
128 bits of a running XOR of turn digests, each salted with its place. Turns
are numbered by ranges, and running digests and sums are windows over blocks of
``BLOCK`` turns of a path, so a conversation of a third of all turns is dealt
to many tasks. Owners are minima with partial aggregation rather than windows
by node, as the root and a very common first turn would meet in one task.
Members that end at a node are joined in chunks of ``CHUNK`` ids, whose texts a
task passes through SHA-256 one after the other.

Defined results for odd input: rows with a null conversation id take no part;
a null turn comes first, rows of equal turn stand in order of role and then of
the text's SHA-256, repeated rows are turns of their own; null role or text is
empty; of a negative id the remainder has the id's sign, so -3 - (-3 % 5) is 0;
an empty table gives no rows. A conversation whose turns all go to its head,
where that is absent, has no turns and ends at the root. Other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakepress.llm.frames import bounded, objects, tidy
from lakepress.operators.dedupe import number_in_order
from lakepress.plans.workdir import spill

#: conversations that share a head, and remainders of the checksum that gives a head's length
GROUP, HEADS = 5, 9
BLOCK, CHUNK = 4096, 4096
NODE = ("depth", "n1", "n2")


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv, at, content, size): turns in order, from 0 in each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the role's length keeps role and text apart
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.sha2(text.cast("binary"), 256).alias("by_text"), F.unhex(F.sha2(whole, 256)).alias("content"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")
    )
    return number_in_order(rows, ["turn", "role", "by_text", "row"], "at", ["conv"]).select("conv", "at", "content", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, len), (conv, depth, content, size)): every conversation, turnless ones included, and its turns from depth 1."""
    own = spill(_numbered(turns), "turns")
    sizes = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))).withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    heads = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    # how many turns come from the base conversation
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = spill(sizes.join(heads, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    from_base = own.where((F.col("at") < HEADS) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "base")
    head = plan.where("taken > 0").join(from_base, "base").where("at < taken").select("conv", (F.col("at") + 1).cast("long").alias("depth"), "content", "size")
    rest = own.join(plan, "conv").where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("taken") + 1).cast("long").alias("depth"), "content", "size")
    return plan.select("conv", "len"), head.unionByName(rest)


def paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, len), (conv, depth, n1, n2, size, upto)): the node of every turn, and the bytes of its path up to it."""
    convs, rows = rebuilt(turns)
    salted = lambda k: F.xxhash64(F.lit(k), "depth", "content")
    rows = rows.select("conv", "depth", "size", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), salted(1).alias("a1"), salted(2).alias("a2"))
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = spill(rows.select("conv", "depth", "size", "block", *[f(c).over(so_far).alias(to) for f, c, to in ((F.bit_xor, "a1", "n1"), (F.bit_xor, "a2", "n2"), (F.sum, "size", "upto"))]), "blocks")
    # a path of one block needs no more; what the others carry over is their blocks' last rows
    ends = local.where(F.col("depth") % BLOCK == 0)
    follow = ends.select("conv", (F.col("block") + 1).alias("block"), "n1", "n2", "upto")
    whole = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    carried = follow.select("conv", "block", F.bit_xor("n1").over(whole).alias("c1"), F.bit_xor("n2").over(whole).alias("c2"), F.sum("upto").over(whole).alias("c3"))
    later = local.where("block > 0").join(carried, ["conv", "block"])
    joined = later.select("conv", "depth", F.col("n1").bitwiseXOR(F.col("c1")).alias("n1"), F.col("n2").bitwiseXOR(F.col("c2")).alias("n2"), "size", (F.col("upto") + F.col("c3")).alias("upto"))
    return convs, local.where("block = 0").select(*joined.columns).unionByName(joined)


def _digest(ends: DataFrame) -> DataFrame:
    """(depth, n1, n2, ends_sha256) of (depth, n1, n2, conv): ids in numeric order, joined by commas, in chunks of bounded size."""
    numbered = number_in_order(ends, ["conv"], "at", list(NODE)).withColumn("chunk", F.floor(F.col("at") / CHUNK))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = spill(numbered.groupBy(*NODE, "chunk").agg(ids.alias("ids"), F.count(F.lit(1)).alias("n")), "ends")
    full = chunks.where((F.col("chunk") > 0) | (F.col("n") == CHUNK)).select(*NODE).distinct()
    alone = chunks.join(full, list(NODE), "left_anti").select(*NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []
        for f in frames:
            for node, ids in zip(f[list(NODE)].itertuples(index=False, name=None), f["ids"], strict=True):
                if node == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
        if now is not None:
            out.append((*now, state.hexdigest()))
        yield pd.DataFrame({c: objects([o[i] for o in out]) for i, c in enumerate((*NODE, "ends_sha256"))})

    many = chunks.join(full, list(NODE)).select(*NODE, "chunk", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return alone.unionByName(bounded(many).mapInPandas(tidy(run), "depth bigint, n1 bigint, n2 bigint, ends_sha256 string"))


def _node(*names: str) -> list[Column]:
    return [F.lit(0).cast("long").alias(n) for n in names]


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie over ``turns`` (conv_id, turn, role, text).

    conv_id (its smallest member), depth, parent_conv_id (the parent's, null at
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    convs, rows = paths(turns)
    convs, rows = spill(convs, "convs"), spill(rows, "paths")
    # one number: the root's owner
    root_owner = convs.agg(F.min("conv").alias("conv")).first().conv
    nodes = rows.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("members"))
    owned = rows.join(nodes, list(NODE))
    # of each conversation: its first owned depth, what lies before it, and the owner of the last node there
    shared = F.col("owner") < F.col("conv")
    marks = owned.groupBy("conv").agg(
        F.coalesce(F.max(F.when(shared, F.col("depth"))), F.lit(0)).alias("last_shared"),
        F.coalesce(F.max(F.when(shared, F.col("upto"))), F.lit(0)).alias("shared_bytes"),
        F.max_by(F.when(shared, F.col("owner")), F.when(shared, F.col("depth"))).alias("above"),
    )
    ends = spill(convs.where("len > 0").join(rows, "conv").where("depth = len").select(*NODE, "conv"), "last-turns")
    # a node where as many end as are members has no children
    leaves = ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("ending"), F.min("conv").alias("conv")).join(nodes, list(NODE)).where((F.col("ending") == F.col("members")) & (F.col("owner") == F.col("conv"))).select("conv", F.lit(1).alias("leaf"))
    of = spill(convs.join(marks, "conv", "left").join(leaves, "conv", "left").select("conv", "len", F.coalesce("last_shared", F.lit(0)).alias("last_shared"), F.coalesce("shared_bytes", F.lit(0)).alias("shared_bytes"), F.coalesce("above", F.lit(root_owner).cast("long")).alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "owners")
    # depth 0 is the root, which every conversation passes
    member = rows.join(of, "conv").select(*NODE, "conv", "size", "upto", "len", "last_shared", "shared_bytes", "above", "leaf")
    root = of.select(*_node(*NODE), "conv", *_node("size", "upto"), "len", "last_shared", "shared_bytes", "above", "leaf")
    depth, last = F.col("depth"), F.col("last_shared")
    above = F.when(depth > last + 1, F.col("conv")).when(depth == last + 1, F.col("above"))
    told = member.unionByName(root).groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"),
        F.max(F.when(depth > 0, above)).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("len") > depth) & (depth >= last)).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("leaves"),
        # from the node's own turn to the last that another owns
        F.sum(F.when((depth <= last), F.col("shared_bytes") - F.col("upto") + F.col("size")).otherwise(0)).alias("saved_tokens"),
    )
    turnless = convs.where("len = 0").select(*_node(*NODE), "conv")
    digests = _digest(ends.unionByName(turnless))
    empty = hashlib.sha256(b"").hexdigest()
    return told.join(digests, list(NODE), "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.when((depth == 0) & (F.col("n_children") == 0), F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
