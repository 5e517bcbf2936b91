"""Prefix tries of conversations as node tables.

A prefix is named by 128 bits: the exclusive or of a hash of each turn's content (SHA-256) and place. Such names can be
made from both ends of a split conversation, and a parent's name is the node's without its last turn. Rows of one name
become one node by a hash aggregate; that all of them have one last turn and one parent is checked for every name, so
equal names stand for equal prefixes, or the operator refuses.

Sums over subtrees are made in shards. A node is heavy if its conversations have more turns from it on than an even
share of all; under heavy nodes hang whole subtrees of a share at most, dealt to shards by the name of their top. A
shard numbers its nodes by a minimal perfect hash, checked against the names, puts their counts into flat arrays by
slot, and adds children to parents through an array of parent slots, deepest first. Heavy nodes, fewer at each depth
than there are shards, then go the same way with what hangs below them already summed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm._common import stored

#: Turns of a conversation that are ordered together; ids that are joined to one text; nodes of a shard at most.
BLOCK, CHUNK_BITS, SHARD = 4096, 8, 1 << 20
#: Rows of a table that is sent to all tasks, at most; beyond, it is joined by a shuffle.
SENT = 1 << 17

_NODE = "depth long, d1 long, d2 long, p1 long, p2 long, owner long, n_convs long, bytes long"
_SUMS = "n_children long, n_leaves long, saved_tokens long"


class Slots:
    """A minimal perfect hash of distinct 128-bit names. Names that are alone at their place of a level are numbered
    there; the others go to the next level. Each slot keeps its name, so that a stranger is told from a member."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.of = np.empty(len(high), np.int64)
        rest, used = np.arange(len(high)), 0
        while len(rest):
            if len(self.levels) == 200:
                raise ValueError("two nodes have one name")
            at = self._place(high[rest], low[rest], 2 * len(rest))
            alone = np.bincount(at, minlength=2 * len(rest)) == 1
            slot = np.cumsum(alone) - 1 + used
            self.levels.append((alone, slot))
            lucky = alone[at]
            self.of[rest[lucky]] = slot[at[lucky]]
            used, rest = used + int(alone.sum()), rest[~lucky]
        self.high, self.low = np.empty_like(high), np.empty_like(low)
        self.high[self.of], self.low[self.of] = high, low

    def _place(self, high: np.ndarray, low: np.ndarray, size: int, level: int | None = None) -> np.ndarray:
        salt = np.uint64(0x9E3779B97F4A7C15 * (1 + (len(self.levels) if level is None else level)) & (1 << 64) - 1)
        with np.errstate(over="ignore"):
            x = (high.view(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(31) ^ low.view(np.uint64)) * np.uint64(0x94D049BB133111EB)
            return ((x ^ x >> np.uint64(29)) % np.uint64(size)).astype(np.int64)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slots of names, -1 for those that have none."""
        out, rest = np.full(len(high), -1), np.arange(len(high))
        for level, (alone, slot) in enumerate(self.levels):
            at = self._place(high[rest], low[rest], len(alone), level)
            hit = alone[at]
            out[rest[hit]] = slot[at[hit]]
            rest = rest[~hit]
        known = out >= 0
        known[known] = (self.high[out[known]] == high[known]) & (self.low[out[known]] == low[known])
        return np.where(known, out, -1)


def _sum_shard(batches):
    """Adds up the subtrees of one partition's nodes. With the columns of _NODE come the sums of what hangs below from
    elsewhere; parent_owner is null and top true where the parent is elsewhere."""
    import pyarrow as pa

    parts = [b for b in batches if len(b)]
    if not parts:
        return
    c = {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in parts]) for n in parts[0].schema.names}
    kinds, parts = parts[0].schema, None
    slots = Slots(c["d1"], c["d2"])

    def scattered(values):
        out = np.empty(len(values), np.int64)
        out[slots.of] = values
        return out

    parent, depth = scattered(slots.find(c["p1"], c["p2"])), scattered(c["depth"])
    parent[depth == 0] = -1  # the root's name is its own parent's
    owner, below = scattered(c["owner"]), parent >= 0
    children = scattered(c["n_children"]) + np.bincount(parent[below], minlength=len(parent))
    leaves = scattered(c["n_leaves"]) + (children == 0)
    saved = scattered(c["saved_tokens"]) + (scattered(c["n_convs"]) - 1) * scattered(c["bytes"])
    order = np.argsort(-depth, kind="stable")
    order = order[below[order]]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    of = slots.of
    out = {n: pa.array(c[n], kinds.field(n).type) for n in ("depth", "d1", "d2", "p1", "p2", "owner", "n_convs")}
    out |= {"parent_owner": pa.array(owner[parent][of], pa.int64(), mask=~below[of]), "top": pa.array(~below[of])}
    out |= {n: pa.array(x[of]) for n, x in (("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved))}
    table = pa.table(out)
    yield from table.to_batches(max_chunksize=1 << 16)


_SUMMED = "depth long, d1 long, d2 long, p1 long, p2 long, owner long, n_convs long, parent_owner long, top boolean, " + _SUMS


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places (from 1) of turns in their conversations, by turn (null first), then role, then text; and the number of
    turns of each conversation. turns: conv_id, turn, role, text, without nulls but in turn.

    Rows are dealt to ranges of the order, so that a conversation of any length is split; a range orders its part, and
    the parts' counts give how many come before.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The first characters are in the order of the texts, and short enough to be sampled.
    ranges = turns.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64))
    ranges = stored(ranges.withColumn("part", F.spark_partition_id()), "turns")
    runs = ranges.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part")
    runs = stored(runs.withColumn("before", F.sum("n").over(before) - F.col("n")), "turn_runs")
    here = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "text")
    rows = ranges.join(runs.drop("n"), ["part", "conv_id"]).withColumn("k", F.row_number().over(here) + F.col("before"))
    return rows.select("part", "conv_id", "k", "role", "text"), runs.groupBy("conv_id").agg(F.sum("n").alias("n"))


def _texts(turns: DataFrame) -> DataFrame:
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *texts)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, pos, role, text: the turns of each conversation as a path, with a textless row of pos 0."""
    rows, sizes = numbered(_texts(turns))
    top = sizes.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    return top.unionByName(rows.select("conv_id", F.col("k").cast("long").alias("pos"), "role", "text"))


def crossed(turns: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Paths of conversations that share beginnings: conversation c starts with the first h turns of c - c % family (all
    it has, none if it isn't there), h = crc32(decimal c) % (most + 1), and goes on with its own turns after its first h.

    Rows without conv_id take no part; a null role or text is an empty one.
    """
    rows, sizes = numbered(_texts(turns))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h")
    sizes = stored(sizes.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % family).alias("base")), "conversations")
    # The conversations that begin with another one's turns: 2 * family - 1 of them at most.
    users = sizes.groupBy(F.col("base").alias("conv_id")).agg(F.collect_list(F.struct(F.col("conv_id").alias("c"), "h")).alias("users"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")
    facts = sizes.join(base, "base", "left").join(users, "conv_id", "left").select("conv_id", "h", taken, "users")
    # Facts of a conversation go to each range that has turns of it, so that a long one is no hot key of a join.
    facts = rows.select("part", "conv_id").distinct().join(facts, "conv_id")
    own = F.when(F.col("k") > F.col("h"), F.array(F.struct(F.col("conv_id").alias("conv_id"), (F.col("k") - F.col("h") + F.col("m")).cast("long").alias("pos"))))
    lent = F.transform(F.filter(F.coalesce("users", F.array().cast("array<struct<c:long,h:long>>")), lambda u: F.col("k") <= u["h"]), lambda u: F.struct(u["c"].alias("conv_id"), F.col("k").cast("long").alias("pos")))
    placed = rows.join(facts, ["part", "conv_id"]).select(F.explode(F.concat(F.coalesce(own, F.array().cast("array<struct<conv_id:long,pos:long>>")), lent)).alias("at"), "role", "text")
    top = sizes.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    return top.unionByName(placed.select("at.conv_id", "at.pos", "role", "text"))


def _prefixes(steps: DataFrame) -> DataFrame:
    """A row for each prefix of each path: conv_id, pos, length, its name and its parent's, and its last turn."""
    sha = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    steps = steps.select("conv_id", "pos", F.floor(F.col("pos") / BLOCK).alias("block"), sha.alias("sha"), F.octet_length("text").cast("long").alias("bytes"))
    name = lambda *salt: F.when(F.col("pos") > 0, F.xxhash64("pos", "sha", *map(F.lit, salt))).otherwise(F.lit(0).cast("long"))
    steps = steps.select("*", name().alias("a"), name("second").alias("b"))
    blocks = steps.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.max("pos").alias("length"))
    path, whole = Window.partitionBy("conv_id").orderBy("block"), Window.partitionBy("conv_id")
    before = [F.bit_xor(c).over(path).bitwiseXOR(F.col(c)).alias(f"{c}_before") for c in "ab"]
    blocks = blocks.select("conv_id", "block", *before, F.max("length").over(whole).alias("length"))
    here = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select("*", F.bit_xor("a").over(here).alias("xa"), F.bit_xor("b").over(here).alias("xb")).join(blocks, ["conv_id", "block"])
    d1, d2 = F.col("xa").bitwiseXOR(F.col("a_before")), F.col("xb").bitwiseXOR(F.col("b_before"))
    return rows.select("conv_id", "pos", "length", d1.alias("d1"), d2.alias("d2"), d1.bitwiseXOR(F.col("a")).alias("p1"), d2.bitwiseXOR(F.col("b")).alias("p2"), "sha", "bytes")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def _ends(prefixes: DataFrame, parts: int) -> DataFrame:
    """Digest of the ids of the paths that end at each node, in order. Ids are joined in chunks; chunks of a node pass
    through one running hash, so that no list of them is held."""

    def digest(batches):
        import pyarrow as pa

        at, state, done = None, None, []
        for batch in batches:
            for d1, d2, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at == (d1, d2):
                    state.update(b"," + ids.encode())
                    continue
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (d1, d2), hashlib.sha256(ids.encode())
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=["d1", "d2", "ends_sha256"])
                done = []
        if at:
            yield pa.record_batch([pa.array([x]) for x in (*at, state.hexdigest())], names=["d1", "d2", "ends_sha256"])

    ends = prefixes.where("pos = length").groupBy("d1", "d2", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.agg(ids.alias("ids")).repartition(parts, "d1", "d2").sortWithinPartitions("d1", "d2", "chunk")
    return chunks.select("d1", "d2", "ids").mapInArrow(digest, "d1 long, d2 long, ends_sha256 string")


def nodes(steps: DataFrame) -> DataFrame:
    """The nodes of the trie of paths (conv_id, pos from 0 without gaps, role, text; pos 0 is the textless root).

    Per node: conv_id, its smallest member; depth; parent_conv_id (root: null); n_convs, its members; n_children;
    n_leaves and saved_tokens, sums over its subtree of childless nodes and of (n_convs - 1) times the bytes of the last
    text; ends_sha256, SHA-256 of the decimal ids of the paths that end there, ascending, with commas between.
    No paths give no nodes. A conversation of any length and any number of copies are split: see the module's notes. A
    path of more than SHARD / (number of shards) heavy nodes takes a round for each such stretch.
    """
    prefixes = stored(_prefixes(steps), "prefixes")
    same = [f(c).alias(f"{f.__name__}_{c}") for c in ("p1", "p2", "sha", "bytes") for f in (F.min, F.max)]
    made = prefixes.groupBy(F.col("pos").alias("depth"), "d1", "d2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("pos") + 1).alias("weight"), *same)
    made = stored(made, "trie_nodes")
    if not made.where(" or ".join(f"min_{c} <> max_{c}" for c in ("p1", "p2", "sha", "bytes"))).isEmpty():
        raise ValueError("two different prefixes have one name")
    made = made.select("depth", "d1", "d2", F.col("min_p1").alias("p1"), F.col("min_p2").alias("p2"), "owner", "n_convs", F.col("min_bytes").alias("bytes"), "weight")
    total = prefixes.count()
    parts = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHARD))
    share, zero = math.ceil(total / parts), F.lit(0).cast("long")
    is_heavy = (F.col("depth") == 0) | (F.col("weight") > share)
    heavy = stored(made.where(is_heavy).drop("weight"), "heavy_nodes")
    n_heavy = heavy.count()

    # Heavy nodes are the beginning of a path; the first other one is the top of the subtree that the path goes into.
    marks = _sent(heavy.select("d1", "d2", F.lit(True).alias("heavy")), n_heavy)
    light = prefixes.join(marks, ["d1", "d2"], "left").where("heavy is null")
    tops = light.groupBy("conv_id").agg(F.min_by(F.struct("d1", "d2"), "pos").alias("t")).select(F.col("conv_id").alias("owner"), F.col("t.d1").alias("t1"), F.col("t.d2").alias("t2"))
    sums = [zero.alias(c.split()[0]) for c in _SUMS.split(", ")]
    dealt = made.where(~is_heavy).join(tops, "owner").repartition(parts, "t1", "t2")
    low = stored(dealt.select("depth", "d1", "d2", "p1", "p2", "owner", "n_convs", "bytes", *sums).mapInArrow(_sum_shard, _SUMMED), "low_nodes")

    # Fewer than `parts` heavy nodes at a depth: so many depths make a shard of bounded size.
    height = max(1, SHARD // parts)
    deepest = heavy.agg(F.max("depth")).first()[0]
    summed = [low]
    for band in range(-1 if deepest is None else deepest // height, -1, -1):
        adds = summed[-1].where("top")
        adds = adds.unionByName(low.where("top")) if len(summed) > 1 else adds
        adds = adds.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        here = heavy.where(F.floor(F.col("depth") / height) == band).join(adds, ["d1", "d2"], "left").fillna(0, ["n_children", "n_leaves", "saved_tokens"])
        one = here.select("depth", "d1", "d2", "p1", "p2", "owner", "n_convs", "bytes", "n_children", "n_leaves", "saved_tokens").repartition(1)
        summed.append(stored(one.mapInArrow(_sum_shard, _SUMMED), "heavy_sums"))
    rows = summed[0]
    for more in summed[1:]:
        rows = rows.unionByName(more)
    owners = _sent(heavy.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("owner").alias("above")), n_heavy)
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_owner", "above")).alias("parent_conv_id")
    rows = rows.join(owners, ["p1", "p2"], "left").join(_ends(prefixes, parts), ["d1", "d2"], "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return rows.select(F.col("owner").alias("conv_id"), "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
