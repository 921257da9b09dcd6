"""The prefix trie of rebuilt conversations, with totals of every subtree by
parallel tree contraction.

Conversation c is rebuilt from the first h turns of conversation c - c % 5 and
its own turns after its first h (h = crc32(decimal c) % 9).  A node is a distinct
sequence of the first d turns (role, text) of a rebuilt conversation; its members
are the conversations that begin with it.

1. A turn is known by the MD5 of its role and text; texts are read once and never
   shuffled.  Turns are numbered inside their conversation over range partitions:
   a conversation that holds a third of all turns is spread over many tasks.
2. A prefix is known by the running XOR of two 64-bit hashes of (position, turn),
   kept for each range slice of a conversation and carried over slices.
3. Nodes come from one aggregate over prefixes.  A node's key is (smallest member,
   depth).
4. Contraction, in join rounds: every childless node is raked into its parent;
   then unary nodes are spliced out between their parent and their only child,
   those whose depth has a 1 in the round's bit where their child's has a 0 (no two
   neighbours at once; a chain of consecutive depths halves each round).  What is
   spliced out is kept on the edge above the child.  A third of all nodes below one
   parent only meet aggregates that combine before the shuffle; the joins are by
   unique keys.
5. Expansion, backwards: a raked node's total was known when it went; a spliced
   node's is its child's total plus what lay on the edge and on itself.
6. Members that end at a node are streamed in order to SHA-256: sorted range
   slices make strings of bounded size, and a node's strings meet in one task.

Edge cases: null role or text is empty; turns of a conversation that share a
turn number are ordered by the MD5 of role and text, and repeated rows are turns of their own; rows
without a conv_id belong to no conversation; a conversation whose rebuilt form
has no turns is a member of the root only; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.llm.common import col, release, stage, staged

FORK = 5
KEEP = 9
#: Conversation ids in one string on their way to a node's SHA-256.
CHUNK_IDS = 1 << 15
_NODE = ["conv_id", "depth"]


def kept_turns(conv_id: Column) -> Column:
    """How many turns of its base a conversation keeps."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % KEEP).cast("int")


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FORK


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, slice, nth (in the slice), turn_key, n_bytes of every turn; and
    conv_id, slice, before (turns of the conversation in earlier slices), n."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).alias("turn_key"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_key")]
    nth = F.row_number().over(Window.partitionBy("slice", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key"))
    placed = rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id())
    # written once: a range exchange samples its bounds anew each time it runs
    placed = stage(placed.select("conv_id", "slice", nth.alias("nth"), "turn_key", "n_bytes"), "turns")
    sizes = placed.groupBy("conv_id", "slice").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"),
                           F.sum("size").over(Window.partitionBy("conv_id")).alias("n"))
    return placed, offsets


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations: conv_id, depth (from 1), slice,
    turn_key, n_bytes; and conv_id, length of every conversation."""
    placed, offsets = _numbered(turns)
    offsets = stage(offsets, "turn-offsets")
    convs = offsets.groupBy("conv_id").agg(F.max("n").alias("n"))
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    info = convs.withColumns({"base": base_of(F.col("conv_id")), "h": kept_turns(F.col("conv_id"))}).join(base, "base", "left")
    info = info.withColumn("lead", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))))
    info = stage(info.select("conv_id", "n", "base", "h", "lead"), "conversations")

    # own turns, shifted to where they come to lie: one join by (conv_id, slice) places them and knows h
    where = offsets.drop("n").join(info.select("conv_id", "h", "lead"), "conv_id")
    own = placed.join(where, ["conv_id", "slice"]).withColumn("pos", F.col("before") + F.col("nth"))
    own_part = own.where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("depth"), "slice", "turn_key", "n_bytes")
    # the first turns of a base go to the conversations (at most nine) that fork from it
    forks = info.where("lead > 0").groupBy("base").agg(F.collect_list(F.struct("conv_id", "lead")).alias("forks"))
    first = own.where((F.col("pos") < KEEP) & (F.col("conv_id") % FORK == 0)).select(F.col("conv_id").alias("base"), "pos", "turn_key", "n_bytes")
    lead_part = first.join(forks, "base").select("pos", "turn_key", "n_bytes", F.explode("forks").alias("f")).where("pos <= f.lead").select(
        F.col("f.conv_id").alias("conv_id"), F.col("pos").alias("depth"), F.lit(-1).alias("slice"), "turn_key", "n_bytes")
    lengths = info.select("conv_id", (F.col("lead") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    return own_part.unionByName(lead_part), lengths


def _prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, n_bytes, a, b (identity of the prefix), up_a, up_b (of the
    prefix one turn shorter), for every prefix of every rebuilt conversation but the empty one."""
    own = turns.select("conv_id", "slice", "depth", "n_bytes",
                       F.xxhash64(F.lit(1), "depth", "turn_key").alias("x"), F.xxhash64(F.lit(2), "depth", "turn_key").alias("y"))
    run = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns({"run_x": F.bit_xor("x").over(run), "run_y": F.bit_xor("y").over(run)})
    own = stage(own, "prefix-slices")
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy("conv_id", "slice").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).select(
        "conv_id", "slice", F.coalesce(F.bit_xor("x").over(earlier), F.lit(0)).alias("in_x"), F.coalesce(F.bit_xor("y").over(earlier), F.lit(0)).alias("in_y"))
    carried = carried.join(lengths, "conv_id")
    full = own.join(carried, ["conv_id", "slice"])
    a, b = F.col("run_x").bitwiseXOR(F.col("in_x")), F.col("run_y").bitwiseXOR(F.col("in_y"))
    return full.select("conv_id", "depth", "n_bytes", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"),
                       b.bitwiseXOR(F.col("y")).alias("up_b"), (F.col("depth") == F.col("length")).alias("ends"))


def ordered_sha256(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ends_sha256: SHA-256 of the decimal ``value``s of each key,
    ascending and comma-joined.  A key may hold any number of values."""
    types = ", ".join(f"{k} {dict(members.dtypes)[k]}" for k in keys)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def flush():
            out.append((*key, ids[0], ",".join(map(str, ids))))

        def batch_of(rows):
            return pa.RecordBatch.from_pydict({n: list(c) for n, c in zip([*keys, "first", "ids"], zip(*rows))}, schema=shape)

        shape = None
        for batch in batches:
            shape = shape or pa.schema([batch.schema.field(k) for k in keys] + [("first", pa.int64()), ("ids", pa.string())])
            for *k, v in zip(*(col(batch, c).to_pylist() for c in (*keys, value))):
                if k != key or len(ids) >= CHUNK_IDS:
                    if ids:
                        flush()
                    key, ids = k, []
                    if len(out) >= 4096 or sum(len(o[-1]) for o in out[-8:]) > 1 << 18:
                        yield batch_of(out)
                        out.clear()
                ids.append(v)
        if ids:
            flush()
            yield batch_of(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out, shape = None, None, [], None
        for batch in batches:
            shape = shape or pa.schema([batch.schema.field(k) for k in keys] + [("ends_sha256", pa.string())])
            for *k, ids in zip(*(col(batch, c).to_pylist() for c in (*keys, "ids"))):
                if k == key:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(shape.names, zip(*out))}, schema=shape)
                out.clear()
        if sha:
            out.append((*key, sha.hexdigest()))
            yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(shape.names, zip(*out))}, schema=shape)

    rows = members.select(*keys, value).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    strings = rows.mapInArrow(chunks, f"{types}, first long, ids string")
    together = strings.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "first")
    return together.mapInArrow(digest, f"{types}, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: list[str], max_rounds: int = 200) -> DataFrame:
    """conv_id, depth and the sum of each of ``values`` over the node's subtree.

    ``tree``: conv_id, depth, parent_conv_id (null at the root; the parent's depth
    is one less), n_children, and the values."""
    known = staged()
    up, edge = ["up_conv", "up_depth"], [f"edge_{v}" for v in values]
    live = tree.select(*_NODE, F.col("parent_conv_id").alias("up_conv"), (F.col("depth") - 1).alias("up_depth"), F.col("n_children").alias("kids"),
                       *values, *[F.lit(0).cast("long").alias(e) for e in edge])
    live = stage(live, "tree")
    bits = max(1, int(tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]).bit_length())
    raked, spliced = [], []
    for r in range(max_rounds):
        leaf = F.col("kids") == 0
        # rake: childless nodes are done, and go into their parents
        raked.append(live.where(leaf).select(*_NODE, *values))
        below = live.where("up_conv is not null").groupBy(*up).agg(
            F.sum((~leaf).cast("int")).alias("now"), F.max(F.when(~leaf, F.col("conv_id"))).alias("child_conv"), F.max(F.when(~leaf, F.col("depth"))).alias("child_depth"),
            *[F.sum(F.when(leaf, F.col(v) + F.col(e)).otherwise(0)).alias(f"from_{v}") for v, e in zip(values, edge)],
            *[F.sum(F.when(leaf, 0).otherwise(F.col(e))).alias(f"on_{e}") for e in edge])
        below = below.withColumnsRenamed(dict(zip(up, _NODE)))
        inner = live.where(~leaf).join(below, _NODE).select(
            *_NODE, *up, F.col("now").alias("kids"), "child_conv", "child_depth", *[(F.col(v) + F.col(f"from_{v}")).alias(v) for v in values],
            *edge, *[f"on_{e}" for e in edge])
        # compress: unary nodes, never two neighbours at once
        bit = r % bits
        at = lambda c: F.shiftright(F.col(c), bit).bitwiseAND(1)
        goes = F.coalesce((F.col("kids") == 1) & F.col("up_conv").isNotNull() & (at("depth") == 1) & (at("child_depth") == 0), F.lit(False))
        inner = stage(inner.withColumn("goes", goes), f"tree-raked-{r}")
        out = inner.where("goes")
        some = out.head(1)
        spliced.append(out.select(*_NODE, "child_conv", "child_depth", *[(F.col(v) + F.col(f"on_{e}")).alias(v) for v, e in zip(values, edge)]) if some else None)
        moved = out.select(F.col("child_conv").alias("conv_id"), F.col("child_depth").alias("depth"), F.col("up_conv").alias("to_conv"), F.col("up_depth").alias("to_depth"),
                           *[(F.col(v) + F.col(e) + F.col(f"on_{e}")).alias(f"new_{e}") for v, e in zip(values, edge)])
        left = inner.where("not goes")
        if some:
            left = left.join(moved, _NODE, "left").select(
                *_NODE, F.coalesce("to_conv", "up_conv").alias("up_conv"), F.coalesce("to_depth", "up_depth").alias("up_depth"), "kids", *values,
                *[F.coalesce(f"new_{e}", e).alias(e) for e in edge])
            live = stage(left, f"tree-{r}")
        else:
            live = left.select(*_NODE, *up, "kids", *values, *edge)
            if not live.head(1):
                break
    else:
        raise RuntimeError(f"tree not contracted after {max_rounds} rounds")

    # re-expand: the rounds backwards; what went later is known already
    pieces = []
    for done, gone in zip(reversed(raked), reversed(spliced)):
        if gone is not None:
            later = _union(pieces)
            child = later.select(F.col("conv_id").alias("child_conv"), F.col("depth").alias("child_depth"), *[F.col(v).alias(f"below_{v}") for v in values])
            back = gone.join(child, ["child_conv", "child_depth"]).select(*_NODE, *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values])
            pieces.append(stage(back, "tree-expanded"))
        pieces.append(done)
    totals = stage(_union(pieces), "subtree-totals")
    release([x for x in staged()[:-1] if x not in known])
    return totals


def _union(pieces: list[DataFrame]) -> DataFrame:
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id (whole number), turn, role, text."""
    known = staged()
    rows, lengths = rebuilt_turns(turns)
    lengths = stage(lengths, "lengths")
    made = staged()[:-1]
    prefixes = stage(_prefixes(rows, lengths), "prefixes")
    release([x for x in [*made, *staged()[len(made) + 1:-1]] if x not in known])
    below = prefixes.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"))
    below = stage(below, "nodes")
    first, n_convs = lengths.agg(F.min("conv_id"), F.count("*")).first()
    none = F.lit(0).cast("long")
    up = below.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["depth", "a", "b", "conv_id", "n_convs", "n_bytes", "parent_conv_id"]
    # the root has all conversations below it: its children need no join
    top = below.where("depth = 1").withColumn("parent_conv_id", F.lit(first).cast("long")).select(columns)
    deeper = below.where("depth > 1").join(up, ["depth", "up_a", "up_b"]).select(columns)
    root = lengths.limit(1).select(none.alias("depth"), none.alias("a"), none.alias("b"), F.lit(first).cast("long").alias("conv_id"),
                                   F.lit(n_convs).alias("n_convs"), none.alias("n_bytes"), F.lit(None).cast("long").alias("parent_conv_id"))
    nodes = stage(root.unionByName(top).unionByName(deeper), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stage(nodes, "trie-children")
    tree = nodes.select(*_NODE, "parent_conv_id", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    members = prefixes.where("ends").select("depth", "a", "b", "conv_id").unionByName(
        lengths.where("length = 0").select(none.alias("depth"), none.alias("a"), none.alias("b"), "conv_id"))
    ends = ordered_sha256(members, ["depth", "a", "b"], "conv_id")
    out = nodes.join(totals, _NODE).join(ends, ["depth", "a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
