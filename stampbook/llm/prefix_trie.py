"""Conversation prefix trie by union-find over the edges between sorted neighbours.

1.  A conversation is a sequence of turn hashes, cut into blocks of 256 turns. All conversations that share the turns before a
    block form one group of block strings, whose root is the node above the block; so no row and no group grows with a dialogue.
2.  Equal strings collapse, the rest are sorted over the whole table. Neighbours are joined in descending order of their longest
    common prefix (LCP); every merge of components makes a branching node at that depth, and what lies between two branching
    nodes is a chain with the same members.
3.  Each slice of the sorted strings builds its own forest. Nodes that reach past a slice's end are its two border paths at most:
    they are contracted to one row each, merged across slices by their prefix, and name the parents of what hangs below them.

Sums over subtrees are sums over members: a conversation owns the nodes of its path of which it is the smallest member, which
are those below the depth at which its component last met a smaller one. So a first pass over the forest finds that depth and
the childless nodes, and a second adds up bytes, owned bytes and leaves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampbook.llm.common import scratch_folder, small_broadcast, tidy, written
from stampbook.operators.numbering import numbered
from stampbook.operators.ordering import scan

#: Turns in a block string.
BLOCK = 256
#: Sorted strings in a slice: at most 16,384 strings of 256 turns, 12 bytes each.
SLICE = 1 << 14
#: Ids in one piece of a digest's input.
PIECE = 1 << 13
BROADCAST_ROWS = 1_000_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, at (places of a conversation follow each other), item (hash of role and text), bytes of the text.

    Turns are in the order of turn (missing first); turns that share it follow by role, then text. Only those carry their text
    into the sort.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ties = written(rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.lit(True).alias("tied")), "ties")
    ties = small_broadcast(ties, BROADCAST_ROWS)
    rows = rows.join(ties, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    narrow = rows.select("conv_id", "turn", *[F.when(F.col("tied"), F.col(c)).alias(c) for c in ("role", "text")], F.xxhash64("role", "text").alias("item"), F.octet_length("text").cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return numbered(narrow, order, "at", scratch_folder(conversations.sparkSession)).select("conv_id", "at", "item", "bytes")


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, depth) of every conversation, and (id, pos from 0, item, bytes) of its turns."""
    turns = written(turns_of(conversations), "turns")
    own = written(turns.groupBy(F.col("conv_id").alias("id")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("depth")), "own")
    placed = turns.join(own, F.col("conv_id") == F.col("id")).select("id", (F.col("at") - F.col("first")).alias("pos"), "item", "bytes")
    return own.select("id", "depth"), placed


def rebuilt(conversations: DataFrame, family: int = 5, cycle: int = 9) -> tuple[DataFrame, DataFrame]:
    """As ``sequences``, each conversation c rebuilt: the first h turns of conversation c - c % ``family``, then its own turns
    after its first h; h = crc32 of the decimal c, modulo ``cycle``."""
    own, turns = (written(x, name) for x, name in zip(sequences(conversations), ("lengths", "places"), strict=True))
    head = F.array_sort(F.collect_list(F.struct("pos", "item", "bytes")))
    heads = turns.where(F.col("pos") < cycle - 1).groupBy(F.col("id").alias("base")).agg(head.alias("head"))
    convs = own.withColumn("h", (F.crc32(F.col("id").cast("string").cast("binary")) % cycle).cast("int")).withColumn("base", F.col("id") - F.col("id") % family)
    convs = convs.join(heads, "base", "left")
    none = F.array().cast("array<struct<pos:bigint,item:bigint,bytes:bigint>>")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).withColumn("m", F.size("head").cast("long"))
    convs = written(convs.select("id", "h", "m", "head", (F.col("m") + F.greatest(F.col("depth") - F.col("h"), F.lit(0))).alias("depth")), "rebuilt")
    after = turns.join(convs.select("id", "h", "m"), "id").where("pos >= h").select("id", (F.col("m") + F.col("pos") - F.col("h")).alias("pos"), "item", "bytes")
    before = convs.select("id", F.explode("head").alias("x")).select("id", "x.pos", "x.item", "x.bytes")
    return convs.select("id", "depth"), after.unionByName(before)


def block_strings(ids: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and block: id, k, items, lens, prior (hash of all earlier turns), base (their bytes), weight
    (bytes of the block), skey (hash of the string and all before it). A conversation that ends at a block's start has it empty."""
    cut = turns.groupBy("id", F.expr(f"pos div {block}").alias("k")).agg(F.array_sort(F.collect_list(F.struct("pos", "item", "bytes"))).alias("x"))
    blocks = cut.select("id", "k", F.transform("x", lambda x: x["item"]).alias("items"), F.transform("x", lambda x: x["bytes"].cast("int")).alias("lens"))
    none = [F.array().cast("array<bigint>").alias("items"), F.array().cast("array<int>").alias("lens")]
    blocks = blocks.unionByName(ids.where(f"depth % {block} = 0").select("id", F.expr(f"depth div {block}").alias("k"), *none))
    blocks = written(blocks.withColumn("weight", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), "cut")
    alone = (F.col("k") == 0) & (F.size("items") < block)
    long = blocks.where(~alone).withColumn("content", F.xxhash64("k", "items").cast("decimal(38,0)"))
    long = scan(long, ["id"], ["k"], {"sum_content": ("sum", F.col("content")), "sum_weight": ("sum", F.col("weight"))})
    before = F.when(F.col("k") > 0, F.xxhash64((F.col("sum_content") - F.col("content")).cast("decimal(38,0)"))).otherwise(F.lit(0).cast("long"))
    long = long.withColumn("prior", before).withColumn("base", F.col("sum_weight") - F.col("weight")).select("id", "k", "items", "lens", "weight", "prior", "base")
    short = blocks.where(alone).withColumns({"prior": F.lit(0).cast("long"), "base": F.lit(0).cast("long")})
    return short.unionByName(long).withColumn("skey", F.xxhash64("k", "prior", "items"))


def _digests(pairs: DataFrame) -> DataFrame:
    """skey, sha: SHA-256 of all ids of a skey, ascending, joined by commas. Pieces of the text are made where the sorted ids
    lie; only those pass through the task that hashes them one after another."""

    def pieces(batches):
        for batch in batches:
            skey, ids = batch.column("skey").to_numpy(), batch.column("id").to_numpy()
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(skey)) + 1, np.arange(PIECE, len(skey), PIECE), [len(skey)]]))
            spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
            if spans:
                text = [",".join(map(str, ids[a:b].tolist())).encode() for a, b in spans]
                starts = [a for a, _ in spans]
                yield pa.RecordBatch.from_arrays([pa.array(skey[starts]), pa.array(ids[starts]), pa.array(text, pa.binary())], ["skey", "first", "piece"])

    def stream(batches):
        key, sha = None, None
        for batch in batches:
            keys, out = batch.column("skey").to_pylist(), []
            for k, piece in zip(keys, batch.column("piece"), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([s for _, s in out])], ["skey", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([sha.hexdigest()])], ["skey", "sha"])

    parts = pairs.repartitionByRange("skey", "id").sortWithinPartitions("skey", "id").mapInArrow(pieces, "skey long, first long, piece binary")
    return parts.repartition("skey").sortWithinPartitions("skey", "first").mapInArrow(stream, "skey long, sha string")


class Forest:
    """The components of one slice as chains: nodes from depth ``lo`` to ``top`` with the same members.

    ``parent`` is the chain whose top node is above ``lo`` (-1: none). A chain is open down to depth ``lim``: those nodes go on
    in a neighbouring slice. ``lost``: (string of the smallest member, depth) where a component met one with a smaller member.
    """

    def __init__(self, table: pa.Table, sums: list[str], size: int):
        table = table.take(pa.array(np.argsort(table.column("at").to_numpy(), kind="stable")))
        at, part = table.column("at").to_numpy(), table.column("part")[0].as_py()
        k, prior = table.column("k").to_numpy(), table.column("prior").to_numpy()
        items = table.column("items").combine_chunks()
        off, flat = items.offsets.to_numpy().astype(np.int64), items.values.to_numpy()
        length = np.diff(off)
        shared = np.full(len(at) + 1, -1, np.int64)
        for i in range(1, len(at)):
            if k[i] == k[i - 1] and prior[i] == prior[i - 1]:
                n = min(length[i], length[i - 1])
                other = np.flatnonzero(flat[off[i] : off[i] + n] != flat[off[i - 1] : off[i - 1] + n])
                shared[i] = other[0] if len(other) else n
        own = np.flatnonzero((at - 1) // size == part)
        a, b = own[0], own[-1] + 1
        self.left, self.right, lcp = int(shared[a]), int(shared[b]), shared[a:b]
        self.table = table.slice(a, b - a)
        self.k, self.length, self.off, self.low = k[a:b], length[a:b], off[a:b], self.table.column("low").to_numpy()
        head = np.array([k[a], prior[a]], np.int64).tobytes(), np.array([k[b - 1], prior[b - 1]], np.int64).tobytes()
        self.left_keys = self._keys(head[0], flat[off[a] : off[a] + max(self.left, 0)], self.left)
        self.right_keys = self._keys(head[1], flat[off[b - 1] : off[b - 1] + max(self.right, 0)], self.right)
        self._join(lcp, [self.table.column(c).to_pylist() for c in sums])

    @staticmethod
    def _keys(head: bytes, items: np.ndarray, depth: int) -> np.ndarray:
        """Hash of the prefix of each depth up to ``depth``."""
        state, out = xxhash.xxh64(head), []
        for d in range(depth + 1):
            if d:
                state.update(items[d - 1].tobytes())
            out.append(state.intdigest())
        return np.array(out, np.uint64).view(np.int64)

    def _join(self, lcp: np.ndarray, sums: list[list[int]]) -> None:
        m = len(self.length)
        up, top, end = list(range(m)), self.length.tolist(), list(range(m))
        first, last, low = list(range(m)), list(range(m)), list(range(m))
        kids: list[list[int]] = [[] for _ in range(m)]
        ids = self.low.tolist()
        chains, parents, self.lost = [], [], []

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def close(x, depth):
            chains.append((first[x], last[x], depth + 1, top[x], low[x], end[x], len(kids[x]), *[s[x] for s in sums]))
            parents.append(-1)
            for kid in kids[x]:
                parents[kid] = len(chains) - 1
            kids[x], end[x] = [len(chains) - 1], -1

        edges = np.flatnonzero(lcp[1:] >= 0) + 1
        for i in edges[np.argsort(-lcp[edges], kind="stable")].tolist():
            depth = int(lcp[i])
            a, b = find(i - 1), find(i)
            for x in (a, b):
                if top[x] > depth:
                    close(x, depth)
                    top[x] = depth
            up[b], last[a], end[a] = a, last[b], max(end[a], end[b])
            kids[a] += kids[b]
            for s in sums:
                s[a] += s[b]
            if ids[low[b]] < ids[low[a]]:
                low[a], low[b] = low[b], low[a]
            self.lost.append((low[b], depth))
        for x in range(m):
            if up[x] == x:
                close(x, -1)
        columns = np.array(chains, np.int64).T
        self.first, self.last, self.lo, self.top, self.lowest, self.end, self.n_kids, *self.sums = columns
        self.parent = np.array(parents, np.int64)
        self.at_left, self.at_right = self.first == 0, self.last == m - 1
        self.lim = np.maximum(np.where(self.at_left, self.left, -1), np.where(self.at_right, self.right, -1))

    def keys(self, chain: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Keys of open nodes, by chain and depth."""
        out = np.zeros(len(chain), np.int64)
        by_left = self.at_left[chain] & (depth <= self.left)
        out[by_left] = self.left_keys[depth[by_left]]
        out[~by_left] = self.right_keys[depth[~by_left]]
        return out

    def expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """(chain, depth) of every node."""
        n = self.top - self.lo + 1
        chain = np.repeat(np.arange(len(n)), n)
        return chain, np.arange(len(chain)) - np.repeat(np.cumsum(n) - n, n) + self.lo[chain]


#: What pass 1 finds: a conversation's lost depth (LOST), the owner of a childless node (LEAF), an open node (OPEN).
LOST, LEAF, OPEN = 0, 1, 2
PASS_1 = "kind int, id long, depth long, key long"


def _owners(table: pa.Table, block: int, size: int) -> pa.Table:
    f = Forest(table, [], size)
    rows, depths = (np.array(x, np.int64) for x in (zip(*f.lost, strict=True) if f.lost else ((), ())))
    leaf = np.flatnonzero((f.n_kids == 0) & (f.top < block) & ~(f.at_right & (f.right >= f.top)))
    chain, depth = f.expanded()
    chain, depth = chain[depth <= f.lim[chain]], depth[depth <= f.lim[chain]]
    kind = np.repeat(np.array([LOST, LEAF, OPEN], np.int32), [len(rows), len(leaf), len(chain)])
    string = np.concatenate([rows, f.lowest[leaf], f.lowest[chain]])
    depths = np.concatenate([depths, f.top[leaf], depth]) + f.k[string] * block
    key = np.concatenate([np.zeros(len(rows) + len(leaf), np.int64), f.keys(chain, depth)])
    return pa.table({"kind": kind, "id": f.low[string], "depth": depths, "key": key})


#: Rows of pass 2: a finished node, a slice's part of an open one, and what a full string says of the node at the next block's root.
NODE, PART_OF_OPEN, ABOVE = 0, 1, 2
SUMS = ["n", "total", "own", "leaves"]
PASS_2 = "kind int, id long, depth long, key long, parent long, pkey long, n long, total long, own long, leaves long, low_total long, low_own long, before long, kids long, last long, sha string"


def _nodes(table: pa.Table, block: int, size: int) -> pa.Table:
    f = Forest(table, SUMS, size)
    t = f.table
    chain, depth = f.expanded()
    lim, row = f.lim[chain], f.first[chain]
    is_open, at_top, at_lo = depth <= lim, depth == f.top[chain], depth == f.lo[chain]
    closed_kids = np.bincount(f.parent[(f.parent >= 0) & (f.lo > f.lim)], minlength=len(f.lo))
    kids = np.where(at_top, np.where(is_open, closed_kids[chain], f.n_kids[chain]), np.where(is_open, depth + 1 > lim, 1))

    above = np.where(at_lo, f.parent[chain], chain)
    some = above >= 0
    open_above = some & (depth - 1 <= f.lim[above])
    parent = np.where(some & ~open_above, f.low[f.lowest[above]], 0)
    pkey, key = np.zeros(len(chain), np.int64), np.zeros(len(chain), np.int64)
    pkey[open_above] = f.keys(above[open_above], depth[open_above] - 1)
    key[is_open] = f.keys(chain[is_open], depth[is_open])

    lens = t.column("lens").combine_chunks()
    first_len = lens.offsets.to_numpy().astype(np.int64)
    cum = np.concatenate(([0], np.cumsum(lens.values.to_numpy().astype(np.int64))))
    base = t.column("base").to_numpy()
    before = base[row] + np.where(depth > 0, cum[first_len[row] - lens.offsets[0].as_py() + np.maximum(depth - 1, 0)] - cum[first_len[row] - lens.offsets[0].as_py()], 0)
    full = depth == block
    stop = first_len[row] - lens.offsets[0].as_py() + block
    last = np.where(full, cum[np.minimum(stop, len(cum) - 1)] - cum[np.maximum(np.minimum(stop, len(cum) - 1) - 1, 0)], 0)

    low = f.lowest[chain]
    ends = np.where(at_top & (f.end[chain] >= 0), f.end[chain], -1)
    sha = t.column("sha").combine_chunks().take(pa.array(ends, mask=ends < 0))
    column = lambda c: t.column(c).to_numpy()[low]
    return pa.table({
        "kind": np.where(full, ABOVE, np.where(is_open, PART_OF_OPEN, NODE)).astype(np.int32), "id": f.low[low], "depth": depth + f.k[row] * block,
        "key": pa.array(key, mask=~is_open), "parent": pa.array(parent, mask=~some | open_above), "pkey": pa.array(pkey, mask=~open_above),
        **{name: s[chain] for name, s in zip(SUMS, f.sums, strict=True)}, "low_total": column("low_total"), "low_own": column("low_own"),
        "before": before, "kids": kids.astype(np.int64), "last": last, "sha": sha,
    })


def _slices(strings: DataFrame, size: int) -> DataFrame:
    """Strings with their slice; the last of a slice also stands in the next one, the first also in the one before."""
    part, at = F.expr(f"(at - 1) div {size}"), F.col("at")
    also = F.array(part, F.when((at % size == 0) & ~F.col("last_one"), part + 1), F.when(((at - 1) % size == 0) & (at > 1), part - 1))
    end = strings.agg(F.max("at")).first()[0]
    strings = strings.withColumn("last_one", at == F.lit(end))
    return strings.withColumn("part", F.explode(F.filter(also, lambda x: x.isNotNull()))).drop("last_one")


def trie(ids: DataFrame, turns: DataFrame, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """Nodes of the prefix trie of sequences.

    ``ids``: id, depth (number of items, 0 included), once per sequence. ``turns``: id, pos from 0 without gaps, item (a 64-bit
    hash), bytes (long). Result, per distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Without sequences there is no row. ``block`` and ``size`` (items in a block string, strings in
    a slice) bound the memory of a task and change no result.
    """
    blocks = written(block_strings(ids, turns, block), "blocks")
    key = ["skey", "k", "prior", "items", "lens", "base"]
    strings = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    strings = written(numbered(strings, [F.col("k"), F.col("prior"), F.col("items")], "at", scratch_folder(blocks.sparkSession)), "strings")

    first = written(_slices(strings.select("at", "k", "prior", "items", "low"), size).groupBy("part").applyInArrow(lambda t: _owners(t, block, size), PASS_1), "pass1")
    opened = first.where(f"kind = {OPEN}")
    least = opened.groupBy("key", "depth").agg(F.min("id").alias("least"))
    lost = first.where(f"kind = {LOST}").select("id", "depth").unionByName(opened.join(least, ["key", "depth"]).where("id <> least").select("id", "depth"))
    names = strings.where("n > 1").select("skey", "low")
    lost = lost.unionByName(blocks.select("id", "skey", (F.col("k") * block + F.size("items")).alias("depth")).join(names, "skey").where("id <> low").select("id", "depth"))
    lost = written(lost.groupBy("id").agg(F.max("depth").alias("lost")), "lost")
    totals = blocks.groupBy("id").agg(F.sum("weight").alias("total")).join(lost, "id", "left").join(first.where(f"kind = {LEAF}").select("id", F.lit(1).cast("long").alias("leaf")), "id", "left")
    totals = written(totals.select("id", "total", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "totals")
    passed = F.aggregate(F.slice("lens", F.lit(1), (F.col("lost") - F.col("k") * block).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    owned = blocks.select("id", "k", "lens", "base").join(totals, "id").where(f"k = lost div {block}")
    owned = written(owned.select("id", "total", (F.col("total") - F.col("base") - passed).alias("own"), "leaf"), "owned")

    members = blocks.select("skey", "id").join(owned, "id").groupBy("skey").agg(F.sum("total").alias("total"), F.sum("own").alias("own"), F.sum("leaf").alias("leaves"), F.min(F.struct("id", "total", "own")).alias("first"))
    ends = strings.where((F.size("items") < block) & (F.col("n") > 1)).select("skey")
    digests = written(_digests(blocks.select("skey", "id").join(ends, "skey", "left_semi")), "digests")
    alone = F.when((F.col("n") == 1) & (F.size("items") < block), F.sha2(F.col("low").cast("string").cast("binary"), 256))
    full = strings.join(written(members, "members"), "skey").join(digests, "skey", "left")
    full = full.select("at", "k", "prior", "items", "lens", "base", "low", "n", "total", "own", "leaves", F.col("first.total").alias("low_total"), F.col("first.own").alias("low_own"), F.coalesce("sha", alone).alias("sha"))
    rows = written(_slices(full, size).groupBy("part").applyInArrow(lambda t: _nodes(t, block, size), PASS_2), "pass2")

    parts = rows.where(f"kind = {PART_OF_OPEN}").groupBy("key", "depth").agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "own", "leaves", "kids")], F.min(F.struct("id", "low_total", "low_own")).alias("f"), F.max("before").alias("before"), F.max("sha").alias("sha"), F.max("pkey").alias("pkey"),
    )
    parts = written(parts, "open")
    children = parts.where("pkey IS NOT NULL").groupBy(F.col("pkey").alias("key"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("more"))
    parts = parts.join(children, ["key", "depth"], "left").select("key", "depth", "pkey", "f.*", *SUMS, "before", (F.col("kids") + F.coalesce("more", F.lit(0))).alias("kids"), "sha")
    parts = written(parts, "opened")
    done = rows.where(f"kind = {NODE}")
    columns = ["id", "depth", "parent", "pkey", *SUMS, "low_total", "low_own", "before", "kids", "sha"]
    nodes = done.select(columns).unionByName(parts.withColumn("parent", F.lit(None).cast("long")).select(columns))

    named = small_broadcast(parts.select(F.col("key").alias("pkey"), F.col("id").alias("named")), BROADCAST_ROWS)

    def resolved(df):
        """Parents that are open nodes by their name."""
        held = df.where("pkey IS NOT NULL").join(named, "pkey").withColumn("parent", F.col("named"))
        return df.where("pkey IS NULL").drop("pkey").unionByName(held.drop("pkey", "named"))

    above = resolved(rows.where(f"kind = {ABOVE}").select("id", "depth", "parent", "pkey", "last"))
    above = written(above.select(F.col("id").alias("i"), F.col("depth").alias("d"), F.col("parent").alias("p"), "last"), "above")
    nodes = resolved(nodes)
    root_of_block = (F.col("depth") % block == 0) & (F.col("depth") > 0)
    joined = nodes.where(root_of_block).join(above, (F.col("id") == F.col("i")) & (F.col("depth") == F.col("d"))).withColumn("parent", F.col("p"))
    nodes = nodes.where(~root_of_block).withColumn("last", F.lit(0).cast("long")).unionByName(joined.drop("i", "d", "p"))
    distinct = F.col("own") - F.col("low_own") + F.col("low_total") - F.col("before")
    saved = F.col("total") - F.col("n") * F.col("before") - distinct + (F.col("n") - 1) * F.col("last")
    return nodes.select(
        F.col("id").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Prefix trie of all conversations (conv_id, turn, role, text), as ``trie``.

    A missing role or text is empty. Repeated rows are turns like others; turns that share their number follow by role, then
    text. Rows without conv_id belong to no conversation and are left out. Equal turns have equal role and text, told apart by
    64-bit hashes. Other columns are ignored; an empty table has no node.
    """
    return trie(*sequences(conversations))


@tidy
def op11_prefix_trie(spark, folder: str) -> DataFrame:
    """The whole of conversations, rebuilt over families of five."""
    return trie(*rebuilt(spark.read.parquet(f"{folder}/conversations.parquet")))
