"""Prefix trie of turn sequences by van Emde Boas recursion over depth.

A sequence of height 2h is cut at depth h.  Its upper half is a path of the upper trie, its
lower half a path in the forest below; what ties the two is the *name* of the cut prefix.
Both halves are cut again in the same way, all pieces of one height at once, so a sequence
of n turns needs log2(n) steps, not n.  A name is a 128-bit digest made of the name of the
piece's top and the digest of the half above the cut, the digest of a piece one of the
digests of its halves: equal prefixes get equal names wherever they are cut, and names need
no common table.  Totals go the other way: the total of the lower half of a path is grafted
onto every node of its upper half, height by height.

Rows of the sum: a node's members are the sequences with its name.  Its smallest member
*owns* it; a sequence owns a path downwards (what lies below an owned node on the owner's
path is owned too).  The total of a node over its subtree is the sum over its members of
what each owns at or below the node's depth, so totals are grafted along paths and then
added up by name, and no subtree is ever gathered.

How it runs.  Texts are turned into a digest and a length in the first scan and never
shuffled.
1. Turns are range-sorted by sequence and order key; positions are counted within a
   partition and carried over its borders by one number a partition, so a sequence with a
   third of all rows is spread over many tasks.
2. Sequences are cut into blocks of ``BLOCK`` turns (the pieces a task handles by the same
   recursion).  Heights above that are Spark rounds over block rows: digests on the way up,
   names on the way down; later totals up and grafts down.  Each round up halves the rows
   and each round down doubles them, and only sequences longer than a block take part.
3. Nodes are sums by name with map-side combining, so a turn that starts a third of all
   conversations is one row a task.  Member lists are cut into numbered pieces before they
   are put together, and the SHA-256 of a list is streamed over its pieces.

Defined cases: rows with a null id belong to no sequence; a null role or text is empty;
turns of one number (or of none, which come first) are ordered by the digest of role and
text; negative ids count like others, with the remainder's sign as in SQL; an empty table
gives an empty result (no member, no root).
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

BLOCK = 32  # turns of a piece that one task handles, a power of two
LIST_PIECE = 4096  # ids of a member list in one row
_NAME = 16  # bytes
ROOT = bytes(_NAME)
_PIECE_TAG, _NAME_TAG = b"\x01", b"\x02"


def _hash(tag: bytes, first: bytes, second: bytes) -> bytes:
    return hashlib.sha256(tag + first + second).digest()[:_NAME]


def _short(text: Column) -> Column:
    """First 128 bits of the SHA-256 of a binary column."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * _NAME))


def _hashed(tag: bytes, first: Column, second: Column) -> Column:
    return _short(F.concat(F.lit(tag), first, second))


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return _short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def numbered(frame: DataFrame, key: str, order: list[str], keep: list[str], label: str) -> DataFrame:
    """key, ``keep`` and ``pos``: the place of a row among those of its key, from 0; stored.

    One range shuffle by key and order; a key may span any number of partitions.
    """
    by = [F.col(key), *(F.col(c).asc_nulls_first() for c in order)]
    ordered = frame.repartitionByRange(*by).sortWithinPartitions(*by).select(key, *keep)

    def run(batches):
        place, last, count, first = TaskContext.get().partitionId(), None, 0, True
        for rows in batches:
            if not len(rows):
                continue
            keys = rows[key].to_numpy()
            new = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            starts = np.flatnonzero(new)
            local = np.arange(len(keys)) - np.concatenate([[-count], starts])[np.cumsum(new)]
            carried = (np.cumsum(new) == (last is None)) & first  # the first key may have begun in an earlier partition
            rows["part"], rows["pos"], rows["carried"] = place, local, carried
            last, count, first = keys[-1], int(local[-1]) + 1, bool(carried[-1])
            yield rows

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    rows = stored(ordered.mapInPandas(run, f"{fields}, part int, pos long, carried boolean"), label)
    # One row a partition from here on, whatever the data; so the result is safe to broadcast.
    spans = rows.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(key, "pos")).alias("end"))
    spans = spans.select("part", "first", F.col(f"end.{key}").alias("last"), (F.col("end.pos") + 1).alias("n"))
    by_part = Window.orderBy("part")
    upto = spans.withColumn("upto", F.sum("n").over(Window.partitionBy("last").orderBy("part")))
    before = F.when(F.lag("last").over(by_part) == F.col("first"), F.lag("upto").over(by_part))
    base = upto.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    pos = F.col("pos") + F.when(F.col("carried"), F.coalesce("base", F.lit(0))).otherwise(0)
    return rows.join(F.broadcast(base), "part", "left").select(key, *keep, pos.alias("pos"))


def _blocks(turns: DataFrame) -> DataFrame:
    """conv, block, turns (digest, bytes) at depths block * BLOCK .. (block + 1) * BLOCK, of rows (conv, depth, digest, bytes).

    The turn at a border ends the piece above and is the top node of the one below.
    """
    block = F.floor(F.col("depth") / BLOCK)
    both = F.when((F.col("depth") % BLOCK == 0) & (F.col("depth") > 0), F.array(block - 1, block)).otherwise(F.array(block))
    rows = turns.withColumn("block", F.explode(both)).groupBy("conv", "block")
    entries = F.sort_array(F.collect_list(F.struct("depth", "digest", "bytes")))
    return rows.agg(entries.alias("turns"))


def _digest(digests: list[bytes]) -> bytes:
    """Digest of a piece of a power of two turns, by halves."""
    if len(digests) == 1:
        return digests[0]
    half = len(digests) // 2
    return _hash(_PIECE_TAG, _digest(digests[:half]), _digest(digests[half:]))


def _names(top: bytes, digests: list[bytes], height: int, out: list[bytes]) -> None:
    """Names of the prefixes of up to height - 1 turns below ``top``, in order of depth."""
    if height == 1:
        out.append(top)
        return
    half = height // 2
    _names(top, digests[:half], half, out)
    if len(digests) >= half:
        cut = _hash(_NAME_TAG, top, _digest(digests[:half]))
        _names(cut, digests[half:], half, out)


def _full_digests(blocks: DataFrame) -> DataFrame:
    """conv, block, digest of blocks with all their turns."""

    def run(batches):
        for rows in batches:
            rows["digest"] = [_digest([t["digest"] for t in turns[1:]]) for turns in rows["turns"]]
            yield rows[["conv", "block", "digest"]]

    # A first block has no turn at its top but the root's row.
    return blocks.where(F.size("turns") == BLOCK + 1).mapInPandas(run, "conv long, block long, digest binary")


def _up(frame: DataFrame, *values: Column) -> DataFrame:
    """Pieces of twice the height: conv, block and ``values`` of each two neighbours."""
    return frame.groupBy("conv", F.floor(F.col("block") / 2).alias("block")).agg(*values)


def _down(pieces: DataFrame, cuts: DataFrame, upper: Column, lower: Column) -> DataFrame:
    """Pieces of half the height: the upper half of each, and the lower one where the left half has a cut.

    ``cuts`` has the even blocks of the half height; ``upper`` and ``lower`` make their ``value``.
    """
    joined = pieces.withColumn("left", 2 * F.col("block")).join(cuts.withColumnRenamed("block", "left"), ["conv", "left"], "left")
    halves = [F.struct(F.col("left").alias("block"), upper.alias("value")), F.struct((F.col("left") + 1).alias("block"), lower.alias("value"))]
    both = F.when(F.col("cut").isNull(), F.array(halves[0])).otherwise(F.array(*halves))
    return joined.select("conv", F.explode(both).alias("half")).select("conv", "half.block", "half.value")


def _tops(blocks: DataFrame, last: int) -> DataFrame:
    """conv, block, value: the name of the prefix above each block but the first, by cutting at half depth."""
    heights = [stored(_full_digests(blocks), "trie-digests")]  # heights[k]: whole pieces of BLOCK * 2^k turns
    while 1 << len(heights) <= last:
        left, right = (F.max(F.when(F.col("block") % 2 == k, F.col("digest"))) for k in (0, 1))
        pairs = _up(heights[-1], left.alias("l"), right.alias("r")).where("l is not null and r is not null")
        heights.append(stored(pairs.select("conv", "block", _hashed(_PIECE_TAG, F.col("l"), F.col("r")).alias("digest")), "trie-digests"))
    tops = heights[0].where("block = 0").select("conv", "block", F.lit(ROOT).alias("value"))
    for height in reversed(heights):
        cuts = height.where("block % 2 = 0").select("conv", "block", F.col("digest").alias("cut"))
        tops = stored(_down(tops, cuts, F.col("value"), _hashed(_NAME_TAG, F.col("value"), F.col("cut"))), "trie-tops")
    return tops.where("block > 0")


def _grafts(sums: DataFrame, last: int) -> DataFrame:
    """conv, block, value: leaves and tokens a long sequence owns in all blocks below each block.

    ``sums`` has what it owns in each block.  The total of a lower half is grafted onto its upper half.
    """
    add = lambda column: F.coalesce(F.sum(column), F.lit(0))
    heights = [stored(sums, "trie-sums")]
    while 1 << len(heights) <= last:
        heights.append(stored(_up(heights[-1], add("leaves").alias("leaves"), add("tokens").alias("tokens")), "trie-sums"))
    value = F.struct(F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("tokens"))
    below = heights[0].where("block = 0").select("conv", "block", value.alias("value"))
    both = F.struct(*[(F.col(f"value.{c}") + F.col(f"cut.{c}")).alias(c) for c in ("leaves", "tokens")])
    for height in reversed(heights):
        cuts = height.where("block % 2 = 1").select("conv", (F.col("block") - 1).alias("block"), F.struct("leaves", "tokens").alias("cut"))
        upper = F.when(F.col("cut").isNull(), F.col("value")).otherwise(both)
        below = stored(_down(below, cuts, upper, F.col("value")), "trie-grafts")
    return below


_PATH = "conv long, block long, names binary, bytes array<long>, ends boolean, more boolean"


def _paths(blocks: DataFrame, last: int) -> DataFrame:
    """The node names of each piece: names (16 bytes each), bytes of the nodes' texts, whether the
    sequence ends in the piece, whether it goes on below its last node."""
    top = F.col("value")
    tops = blocks.where("block = 0").withColumn("value", F.lit(ROOT))
    if last:
        tops = tops.union(blocks.where("block > 0").join(_tops(blocks, last), ["conv", "block"]).select(*blocks.columns, "value"))

    def run(batches):
        for rows in batches:
            out = []
            for turns, name in zip(rows["turns"], rows["value"]):
                names: list[bytes] = []
                _names(name, [t["digest"] for t in turns[1:]], BLOCK, names)
                whole = len(turns) > BLOCK
                out.append((b"".join(names), [t["bytes"] for t in turns[: len(names)]], not whole, whole))
            yield pd.DataFrame({"conv": rows["conv"], "block": rows["block"]} | dict(zip(["names", "bytes", "ends", "more"], zip(*out))))

    return stored(tops.withColumn("value", top).mapInPandas(run, _PATH), "trie-paths")


def _name_at(place: Column) -> Column:
    return F.substring(F.col("names"), place * _NAME + 1, F.lit(_NAME))


def _nodes(paths: DataFrame) -> DataFrame:
    """name, conv (smallest member), depth, bytes, n_convs, n_ends of every node; stored."""
    places = F.posexplode("bytes").alias("at", "bytes")
    rows = paths.select("conv", "block", "names", "ends", F.size("bytes").alias("n"), places)
    rows = rows.select(
        _name_at(F.col("at")).alias("name"),
        "conv",
        (F.col("block") * BLOCK + F.col("at")).alias("depth"),
        "bytes",
        (F.col("ends") & (F.col("at") == F.col("n") - 1)).cast("long").alias("end"),
    )
    sums = [F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.count("*").alias("n_convs"), F.sum("end").alias("n_ends")]
    return stored(rows.groupBy("name").agg(*sums), "trie-nodes")


def _owned(nodes: DataFrame) -> DataFrame:
    """conv, block, own (place, leaf, tokens): the nodes a sequence owns, by piece; at most BLOCK of them."""
    entry = F.struct(
        (F.col("depth") % BLOCK).alias("at"),
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"),  # all members end here
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("tokens"),
    )
    rows = nodes.groupBy("conv", F.floor(F.col("depth") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("own"))
    total = lambda field: F.aggregate(F.col("own"), F.lit(0).cast("long"), lambda a, x: a + x[field])
    return stored(rows.withColumn("leaves", total("leaf")).withColumn("tokens", total("tokens")), "trie-owned")


_PARTS = "name binary, leaves long, tokens long, children long, parent long, above binary, first boolean"


def _parts(paths: DataFrame, owned: DataFrame, last: int) -> DataFrame:
    """Per node of a piece: what the sequence owns at or below it; of owned nodes also whether the path goes
    on (a child), the parent where the sequence owns that too, else the parent's name in ``above``."""
    joined = paths.select("conv", "block", "names", "more").join(owned.drop("leaves", "tokens"), ["conv", "block"], "left")
    if last:
        longer = paths.where("block > 0 or more").select("conv", "block").join(owned.select("conv", "block", "leaves", "tokens"), ["conv", "block"], "left")
        grafts = _grafts(longer.na.fill(0, ["leaves", "tokens"]), last)
        # The last node of the piece above, for a path that a sequence owns from a border on.
        before = paths.select("conv", (F.col("block") + 1).alias("block"), _name_at(F.size("bytes") - 1).alias("before")).where("block > 0")
        taken = owned.select("conv", (F.col("block") + 1).alias("block"), F.lit(True).alias("taken"))
        borders = owned.where("block > 0 and own[0].at = 0").select("conv", "block").join(before, ["conv", "block"]).join(taken, ["conv", "block"], "left")
        joined = joined.join(grafts, ["conv", "block"], "left").join(borders, ["conv", "block"], "left")
    else:
        none = F.struct(F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("tokens"))
        joined = joined.withColumn("value", none).withColumn("before", F.lit(None).cast("binary")).withColumn("taken", F.lit(None).cast("boolean"))

    def run(batches):
        for rows in batches:
            out = []
            for conv, block, names, more, own, value, before, taken in zip(*(rows[c] for c in ("conv", "block", "names", "more", "own", "value", "before", "taken"))):
                names = [names[k : k + _NAME] for k in range(0, len(names), _NAME)]
                leaves, tokens = (value["leaves"], value["tokens"]) if value is not None else (0, 0)
                mine = {o["at"]: (o["leaf"], o["tokens"]) for o in own} if own is not None else {}
                top = min(mine, default=None)
                for at in range(len(names) - 1, -1, -1):
                    children, parent, above = 0, None, None
                    if at in mine:
                        leaves, tokens = leaves + mine[at][0], tokens + mine[at][1]
                        children = int(at + 1 < len(names) or more)
                        if at > top or (at == 0 and taken is True):
                            parent = conv
                        elif at:
                            above = names[at - 1]
                        else:
                            above = before
                    if leaves or tokens or children or above is not None or parent is not None:
                        out.append((names[at], leaves, tokens, children, parent, above, above is not None))
            columns = dict(zip([c.split()[0] for c in _PARTS.split(", ")], zip(*out) if out else [[]] * 7))
            yield pd.DataFrame(columns | {"parent": pd.array(columns["parent"], dtype="Int64")})

    return stored(joined.mapInPandas(run, _PARTS), "trie-parts")


def _end_digests(paths: DataFrame) -> DataFrame:
    """name, ends_sha256 of the nodes where sequences end: SHA-256 of their ids, ascending, joined by commas."""
    last = paths.where("ends").select(_name_at(F.size("bytes") - 1).alias("name"), "conv")
    places = numbered(last, "name", ["conv"], ["conv"], "trie-ends")
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = places.groupBy("name", F.floor(F.col("pos") / LIST_PIECE).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    ordered = pieces.repartition("name").sortWithinPartitions("name", "piece")

    def run(batches):
        name, sha = None, None
        for rows in batches:
            out = []
            for new, ids in zip(rows["name"], rows["ids"]):
                if new != name:
                    if sha is not None:
                        out.append((name, sha.hexdigest()))
                    name, sha = new, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["name", "ends_sha256"])
        if sha is not None:
            yield pd.DataFrame([(name, sha.hexdigest())], columns=["name", "ends_sha256"])

    return ordered.mapInPandas(run, "name binary, ends_sha256 string")


def trie(sequences: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences (conv, depth, digest, bytes).

    Every sequence has a row of depth 0 and rows of depth 1, 2, ...  Returned: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    blocks = stored(_blocks(sequences), "trie-blocks")
    last = blocks.agg(F.max("block")).first()[0] or 0
    paths = _paths(blocks, last)
    nodes = _nodes(paths)
    parts = _parts(paths, _owned(nodes), last)
    above = parts.where("first").select("name", "above")
    owners = above.select(F.col("above").alias("name")).distinct().join(nodes.select("name", "conv"), "name")
    # Many sequences may branch off one node: the branches are dealt anew, each with its one owner.
    owners = stored(owners.select(F.col("name").alias("above"), F.col("conv").alias("parent")), "trie-owners")
    parents = above.join(owners, "above").select("name", "parent")

    blank = {"conv": "long", "depth": "long", "n_convs": "long", "leaves": "long", "tokens": "long", "children": "long", "parent": "long", "ends_sha256": "string"}

    def shaped(frame: DataFrame) -> DataFrame:
        return frame.select("name", *[F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()])

    branches = above.groupBy(F.col("above").alias("name")).agg(F.count("*").alias("children"))
    rows = [nodes, parts, parents, branches, _end_digests(paths)]
    union = shaped(rows[0])
    for frame in rows[1:]:
        union = union.union(shaped(frame))
    kept = [F.max(c).alias(c) for c in ("conv", "depth", "n_convs", "parent", "ends_sha256")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("leaves", "tokens", "children")]
    return union.groupBy("name").agg(*kept, *sums).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("tokens").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Sequences (conv, depth, digest, bytes) of conversations that share the first turns of their family.

    Of conversation c the first h = crc32(c) % ``heads`` turns are replaced by those of conversation
    c - c % ``family`` (all it has, if fewer; none if there is no such conversation).
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"),
    )
    placed = numbered(turns, "conv", ["turn", "digest"], ["digest", "bytes"], "trie-turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    leaders = (
        placed.where((F.col("conv") % family == 0) & (F.col("pos") < heads - 1))
        .groupBy(F.col("conv").alias("leader"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    )
    each = placed.where("pos = 0").select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("leader"))
    head = F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int"))
    each = stored(each.join(leaders, "leader", "left").select("conv", "h", head.alias("head")), "trie-heads")
    root = F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("bytes")))
    firsts = each.select("conv", F.explode(F.concat(root, "head")).alias("turn")).select("conv", (F.col("turn.pos") + 1).alias("depth"), "turn.digest", "turn.bytes")
    own = placed.join(each.select("conv", "h", F.size("head").cast("long").alias("k")), "conv").where("pos >= h")
    return firsts.union(own.select("conv", F.col("k") + F.col("pos") - F.col("h") + 1, "digest", "bytes"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text)."""
    return trie(rebuilt(conversations))
