"""Trie of conversation prefixes by fixed-length block hashing.

Conversations that begin alike share a path of nodes, one for each turn. The trie is found in two steps:

1. turns are dealt into blocks of ``BLOCK`` and every block becomes one digest. Conversations are grouped by successive
   block digests: a *block group* holds all conversations that agree up to the end of a block. Groups are counted by
   partial aggregation, so a beginning that a third of all conversations share costs one row for each task;
2. turn boundaries matter only inside blocks whose siblings (block groups behind the same block) diverge. There the
   groups, not the conversations, are taken apart turn by turn and merged again where their turns are still equal. A
   block group without siblings is a chain: its turns become nodes as they are.

The name of a node is the exclusive or, over its blocks, of a 128-bit hash of (block number, turns of that block so
far). A conversation's block names are then running exclusive ors, which a hot conversation computes in pieces, and a
node met inside one block has the same name as one that ends it.

Sums over subtrees run over the ends of whole blocks by pointer doubling: after round r each of them knows the sum of
everything less than 2**r blocks below, so a path of n turns takes log2(n / BLOCK) rounds. Inside a block a node adds to
its at most ``BLOCK`` - 1 ancestors directly.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormrail.llm.common import WORD, numbered, written

#: Turns of a block.
BLOCK = 4
#: Blocks of a piece of a conversation whose running names one window computes.
PIECE = 4096
#: Conversation ids that one row carries on their way to the digest of a node's ends.
PACK = 8192
#: At most this many turns come from another conversation (see :func:`rebuilt`).
HEAD = 3


def _name(block: Column, turns: Column) -> Column:
    """128-bit hash of a block number and the digests of its first turns."""
    said = F.concat_ws(",", turns)
    return F.struct(F.xxhash64(F.lit(1), block, said).alias("x"), F.xxhash64(said, block, F.lit(2)).alias("y"))


def _xor(a: Column, b: Column) -> Column:
    return F.struct(a.x.bitwiseXOR(b.x).alias("x"), a.y.bitwiseXOR(b.y).alias("y"))


def _xor_all(name: Column) -> Column:
    return F.struct(F.bit_xor(name.x).alias("x"), F.bit_xor(name.y).alias("y"))


def _root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv, at, digest, words): the turns of each conversation from position 1 on, in the order of the turn number
    (null first), equal ones by digest. Null roles and texts are empty; rows without an id are left out.

    Positions come from one range shuffle of slim rows, so a single conversation may hold any share of them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.sha2(said.cast("binary"), 256).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("words")]
    rows = numbered(rows, order, "place", "turns")
    # written, so that the join can split a conversation that holds many of the rows
    first = written(rows.groupBy("conv").agg(F.min("place").alias("first")), "firsts", slim=True)
    return rows.join(first, "conv").select("conv", (F.col("place") - F.col("first") + 1).alias("at"), "digest", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, at, digest, words) of rebuilt conversations, and (conv, size) of all of them.

    Conversation c begins with the first h turns of conversation c - c % 20 as it was (all of them if it has fewer,
    none if there is none), h = crc32 of the decimal id modulo 4, and goes on with its own turns behind its first h.
    """
    turn = F.struct("at", "digest", "words")
    some = rows.groupBy("conv").agg(F.max("at").alias("own"))
    heads = rows.filter(f"at <= {HEAD} and conv % 20 = 0").groupBy("conv").agg(
        F.array_sort(F.collect_list(turn)).alias("head")).select(F.col("conv").alias("donor"), "head")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD + 1)).cast("int")
    plan = some.withColumns({"h": h, "donor": F.expr("conv - conv % 20")}).join(heads, "donor", "left").select(
        "conv", "own", "h", F.expr("slice(coalesce(head, array()), 1, h)").alias("head"))
    plan = written(plan.withColumn("given", F.size("head")), "heads")
    given = plan.select("conv", F.explode("head").alias("e")).select("conv", "e.at", "e.digest", "e.words")
    own = rows.join(plan.select("conv", "h", "given"), "conv").filter("at > h").select(
        "conv", F.expr("at - h + given").alias("at"), "digest", "words")
    sizes = plan.select("conv", F.expr("given + greatest(own - h, 0)").alias("size"))
    return given.union(own), sizes


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv, k, before, name, turns): for each block (k from 1 on) of a conversation its name, that of the block
    before it, and its at most ``BLOCK`` turns."""
    parts = rows.groupBy("conv", F.expr(f"int((at - 1) div {BLOCK}) + 1").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", "words"))).alias("turns"))
    parts = written(parts.withColumn("own", _name(F.col("k"), F.col("turns.digest"))).withColumn(
        "piece", F.expr(f"(k - 1) div {PIECE}")), "blocks")
    along = Window.partitionBy("conv", "piece").orderBy("k")
    inside = parts.withColumn("run", _xor_all_over(F.col("own"), along))
    totals = parts.groupBy("conv", "piece").agg(_xor_all(F.col("own")).alias("all"))
    ahead = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.withColumn("start", _xor_all_over(F.col("all"), ahead)).filter("piece > 0").select(
        "conv", "piece", "start")
    named = inside.join(start, ["conv", "piece"], "left").withColumn(
        "name", F.when(F.col("start").isNull(), F.col("run")).otherwise(_xor(F.col("run"), F.col("start"))))
    return named.select("conv", "k", _xor(F.col("name"), F.col("own")).alias("before"), "name", "turns")


def _xor_all_over(name: Column, window) -> Column:
    return F.struct(F.bit_xor(name.x).over(window).alias("x"), F.bit_xor(name.y).over(window).alias("y"))


def _groups(blocks: DataFrame) -> DataFrame:
    """Block groups: (name, before, k, n, conv, turns) with their number of conversations and the smallest of them."""
    return written(blocks.groupBy("name").agg(
        F.min("before").alias("before"), F.min("k").alias("k"), F.count("*").alias("n"), F.min("conv").alias("conv"),
        F.min("turns").alias("turns")), "groups")


def _nodes(groups: DataFrame) -> DataFrame:
    """(name, parent, above, depth, n, conv, words, path) of all nodes but the root. above: the end of the block before;
    path: the names of the node's ancestors inside its block, and its own."""
    path = F.transform(F.col("turns"), lambda t, j: _xor(F.col("before"), _name(
        F.col("k"), F.transform(F.slice("turns", F.lit(1), j + 1), lambda s: s.digest))))
    forks = written(groups.groupBy("before").agg(F.count("*").alias("n")).filter("n > 1").select(
        "before", F.lit(True).alias("fork")), "forks", slim=True)
    spread = groups.join(forks, "before", "left").withColumn("path", path).select(
        "before", "k", "n", "conv", "fork", "turns", "path", F.explode(F.sequence(
            F.lit(1), F.size("turns"))).alias("j")).select(
        F.expr("path[j - 1]").alias("name"), F.expr("if(j = 1, before, path[j - 2])").alias("parent"),
        F.col("before").alias("above"), F.expr(f"(k - 1) * {BLOCK} + j").cast("long").alias("depth"), "n", "conv",
        F.expr("turns[j - 1].words").alias("words"), F.expr("slice(path, 1, j)").alias("path"), "fork")
    alone = spread.filter("fork is null").drop("fork")
    merged = spread.filter("fork").groupBy("name").agg(
        *[F.min(c).alias(c) for c in ("parent", "above", "depth")], F.sum("n").alias("n"), F.min("conv").alias("conv"),
        F.min("words").alias("words"), F.min("path").alias("path"))
    return alone.union(merged.select(alone.columns))


def _below(ends: DataFrame) -> DataFrame:
    """(name, saved, leaves): sums over all that hangs below the ends of blocks, from rows (name, jump, saved, leaves)
    with each end's next end above (null at the top) and its own block's sums."""
    while True:
        ends = written(ends, "ends", slim=True)
        going = ends.filter("jump is not null")
        if going.isEmpty():
            return ends.drop("jump")
        adds = going.groupBy(F.col("jump").alias("to")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("grown"))
        far = ends.select(F.col("name").alias("over"), F.col("jump").alias("next"))
        ends = (ends.join(adds, F.col("name") == F.col("to"), "left").join(far, F.col("jump") == F.col("over"), "left")
                .select("name", F.col("next").alias("jump"),
                        (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
                        (F.col("leaves") + F.coalesce("grown", F.lit(0))).alias("leaves")))


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) from rows (name, conv): SHA-256 of the decimal ids, ascending and joined by commas.

    Rows of a node are ranged over many tasks and packed to strings of ``PACK`` ids first. A digest has to see its
    bytes one after another, so the packs of a node meet in one task, which holds one pack at a time.
    """
    def pack(batches):
        name, first, ids = None, None, []

        def out():
            return pa.RecordBatch.from_pylist([{"x": name[0], "y": name[1], "first": first, "ids": ",".join(ids)}],
                                              pa.schema([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()),
                                                         ("ids", pa.string())]))

        for batch in batches:
            done = []
            for x, y, conv in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "conv"))):
                if ids and (name != (x, y) or len(ids) == PACK):
                    done.append(out())
                    ids = []
                if not ids:
                    name, first = (x, y), conv
                ids.append(str(conv))
            yield from done
        if ids:
            yield out()

    def digest(batches):
        name, sha = None, None
        for batch in batches:
            found = []
            for x, y, ids in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "ids"))):
                if name != (x, y):
                    if name is not None:
                        found.append((*name, sha.hexdigest()))
                    name, sha = (x, y), hashlib.sha256(ids.encode())
                else:
                    sha.update(("," + ids).encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["x", "y", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*name, sha.hexdigest())],
                                             names=["x", "y", "ends_sha256"])

    slim = ends.select("name.x", "name.y", "conv")
    packs = written(slim.repartitionByRange("x", "y", "conv").sortWithinPartitions("x", "y", "conv").mapInArrow(
        pack, "x long, y long, first long, ids string"), "packs")
    return packs.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(
        digest, "x long, y long, ends_sha256 string").select(F.struct("x", "y").alias("name"), "ends_sha256")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations (:func:`rebuilt`): conv_id (the smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256, all but the last long.

    saved_tokens is what caching saves: over the node's subtree, words of the last turn times the conversations that
    need not read it again. The root has depth 0, no text and a null parent. Conversations that rebuild to no turns
    belong to the root alone. Null roles and texts are empty; equal rows are turns of their own; turns with the same
    number stand in the order of a digest of role and text. Rows without an id are left out; without any row with one
    there is no trie and no node. Other columns are not read.
    """
    rows, sizes = rebuilt(turns(conversations, id_col, turn_col, role_col, text_col))
    blocks = written(_blocks(rows), "named")
    groups = _groups(blocks)
    nodes = written(_nodes(groups), "nodes")

    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children"))
    own = written(nodes.join(children.withColumnRenamed("parent", "__of"), F.col("name") == F.col("__of"), "left")
                  .drop("__of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumn("saved", (F.col("n") - 1) * F.col("words"))
                  .withColumn("leaves", (F.col("n_children") == 0).cast("long")), "own")
    # each end of a whole block with the sums of the nodes in the blocks right behind it
    behind = own.groupBy(F.col("above").alias("of")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    top = F.col("above") == _root()
    ends = own.filter(f"depth % {BLOCK} = 0").select("name", F.when(~top, F.col("above")).alias("jump")).join(
        behind, F.col("name") == F.col("of"), "left").select(
        "name", "jump", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaves", F.lit(0)).alias("leaves"))
    below = _below(ends).select(F.col("name").alias("end"), F.col("saved").alias("more"), F.col("leaves").alias("grown"))
    full = own.join(below, F.col("name") == F.col("end"), "left").withColumns({
        "saved": F.col("saved") + F.coalesce("more", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("grown", F.lit(0))})
    sums = full.select(F.explode("path").alias("to"), "saved", "leaves").groupBy("to").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    # conversations end at the name of their last block; those without turns at the root
    last = blocks.select("conv", "name", (F.expr(f"(k - 1) * {BLOCK}") + F.size("turns")).alias("upto"))
    over = last.join(sizes, "conv").filter("upto = size").select("name", "conv").union(
        sizes.filter("size = 0").select(_root().alias("name"), "conv"))
    digests = _ends_digests(over).withColumnRenamed("name", "at_end")

    total = sizes.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    parents = nodes.select(F.col("name").alias("above_it"), F.col("conv").alias("parent_conv"))
    out = (own.select("name", "parent", "conv", "depth", "n", "n_children")
           .join(sums, F.col("name") == F.col("to")).join(parents, F.col("parent") == F.col("above_it"), "left")
           .withColumn("parent_conv", F.coalesce("parent_conv", F.lit(total.conv))))
    all_in = own.agg(F.count(F.when(F.col("parent") == _root(), 1)).alias("n_children"),
                     F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
                     F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"))
    root = all_in.filter(F.lit(total.n > 0)).select(
        _root().alias("name"), F.lit(total.conv).cast("long").alias("conv"), F.lit(0).cast("long").alias("depth"),
        F.lit(total.n).cast("long").alias("n"), "n_children", "n_leaves", "saved_tokens",
        F.lit(None).cast("long").alias("parent_conv"))
    both = out.select(root.columns).union(root).join(digests, F.col("name") == F.col("at_end"), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return both.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"),
                       F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", none).alias("ends_sha256"))
