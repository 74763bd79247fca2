"""Exact n-gram Jaccard self-join as classes: set-relation skipping over index lists by block.

1.  Equal sets have equal answers: they collapse to the smallest id first, and only one of them goes on.
2.  A set's shingles are cut into blocks by their position in hash space. Two sets of similarity t differ in at most d shingles,
    d known from their sizes, so that of d + 1 blocks at least one is the same in both. Each block's content is an index list;
    a list is skipped at once by all sets that differ anywhere in that block, so frequent shingles alone never make a list long,
    and sets that only share a passage rarely meet. Sizes are handled in bands; a set is listed in its own band and the one below.
    Empty blocks say nothing and are not listed. A set goes through cuts of other hashes until one fills more than d of its blocks:
    at most d blocks can tell it from a similar set, so one filled block is the same in both, and of two similar sets
    both are listed under the first cut that ends either. The number of blocks is chosen so that the first cut mostly does.
    Of a set's filled blocks, all but those that can differ are also blocks of any similar set. So a set stays in its rarest lists
    only, one more than the blocks it can differ by; those that nobody shares come first, and a set with that many of them is
    similar to none. Only what is left in some list meets a pivot, and only its text is kept.
3.  Answers are derived, not recomputed: per list, members are compared with one pivot only, the one that stands in the most
    and longest lists. What tells a member x from the pivot p is its difference D(x). Two members of one list can only be similar
    without both being linked to p if their differences overlap in at least (|D(x)| + |D(y)| - d) / 2 shingles. So an index over
    the first d + 1 shingles of the differences (those that p lacks first) finds all pairs left, and the places at which
    two differences first meet bound their overlap, which skips the rest of a list. Pairs within a class are skipped.
    Where many classes meet under one shingle of a pivot's differences, those are ordered anew, the shingles that most of them
    share last: a set that has more than d of its own then meets none of the others. And of two sets that can be similar one at
    least stands early under their shingle, so that late ones only meet the early ones.
    What is found is compared by whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stampbook.llm.common import tidy, written
from stampbook.llm.textbytes import BASE, LOWER, Prefix, Words, buffer, mix, slices

def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, ascending in each text; first of each text). Texts of fewer words: all as one."""
    data, starts = buffer(column)
    data = LOWER[data]
    w = Words(data, starts)
    values = w.values(data)
    prefix, count = Prefix(values), np.diff(w.first)
    short = (count > 0) & (count < n)
    text = np.repeat(np.arange(len(count)), count)
    whole = np.arange(len(values)) + n <= w.first[1:][text]
    begin = np.concatenate([np.flatnonzero(whole), w.first[:-1][short]])
    end = np.concatenate([np.flatnonzero(whole) + n, w.first[1:][short]])
    owner = np.concatenate([text[whole], np.flatnonzero(short)])
    hashes = prefix.spans(begin, end)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.searchsorted(owner[keep], np.arange(len(count) + 1))


def set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every set, the same for equal sets."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(BASE)), out=total[1:])
    return mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64)).view(np.int64)


def _sets(n: int):
    """doc_id, id of the set, its size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, first = shingle_sets(part.column("text"), n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(set_ids(hashes, first)), pa.array(np.diff(first)), part.column("text_hash")], ["doc_id", "sid", "size", "text_hash"])

    return run


#: Ids of sets that a task remembers, to send each once; beyond that it starts anew and may send some twice.
REMEMBERED = 200_000


def _unseen(sid: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of the sets that the task has not met so far."""
    new = []
    for i, s in enumerate(sid.tolist()):
        if s not in seen:
            seen.add(s)
            new.append(i)
    if len(seen) > REMEMBERED:
        seen.clear()
    return np.array(new, np.int64)


def _texts(n: int):
    """Id of the set, and a text: equal sets once for each task, as any of their texts will do."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                sid = set_ids(*shingle_sets(part.column("text"), n))
                new = _unseen(sid, seen)
                if len(new):
                    yield pa.RecordBatch.from_arrays([pa.array(sid[new]), part.column("text").take(pa.array(new))], ["sid", "text"])

    return run


class Bands:
    """Size bands of ratio 1/t, and the number of blocks that each needs."""

    def __init__(self, percent: int):
        self.t = percent / 100

    def band(self, size: np.ndarray) -> np.ndarray:
        """Two sets of similarity t are in the same band or in neighbouring ones."""
        return np.floor(np.log(np.maximum(size, 1)) / -math.log(self.t) + 1e-9).astype(np.int64)

    def most(self, band: int) -> int:
        """By how many shingles two similar sets of this band and the next can differ."""
        largest = math.ceil(self.t ** -(band + 2)) + 1
        return math.floor((1 - self.t) / (1 + self.t) * 2 * largest + 1e-9)

    def differ(self, size: np.ndarray, band: int) -> np.ndarray:
        """The same for one set: a similar one has at most size / t shingles."""
        return np.minimum(np.floor((1 - self.t) / self.t * size + 1e-9).astype(np.int64), self.most(band))

    def blocks(self, band: int) -> int:
        """So many that any set of the lists is expected to fill more of them than it can differ by (hardest for the smallest
        set that can differ by ``most``)."""
        most = self.most(band)
        m, hardest = 1.1 * (most + 1), most * self.t / (1 - self.t) if self.t < 1 else 0
        while m * (1 - math.exp(-hardest / m)) < min(1.05 * most, (most + hardest) / 2):
            m *= 1.1
        return math.ceil(m)


#: Cuts of one set that are told apart in ``cut`` (two bands of each number).
CUTS = 1 << 12


def _lists(n: int, percent: int):
    """Every set's id with the key of each index list it stands in: equal sets once for each task. ``cut`` names the band and cut
    among the set's own; in units of ``CUTS`` it says how many lists of that cut the set needs beyond those it fills (mostly less
    than none: one more than the blocks it can differ by is enough)."""
    bands = Bands(percent)

    def cut(hashes, first, band, number):
        """Keys of the filled blocks of all sets under one cut, and the set of each."""
        m = bands.blocks(band)
        size = np.diff(first)
        text = np.repeat(np.arange(len(size)), size)
        spread = mix(hashes + np.uint64(number * BASE & (1 << 64) - 1))
        block = ((spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        place = text * m + block
        order = np.argsort(place, kind="stable")
        place, spread = place[order], mix(spread[order] ^ np.uint64(0x5851F42D4C957F2D))
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        content, place = np.add.reduceat(spread, new), place[new]
        label = mix((place % m).astype(np.uint64) + np.uint64(band << 24) + (np.uint64(number) << np.uint64(48)))
        return mix(content ^ label), place // m

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                hashes, first = shingle_sets(part.column("text"), n)
                size = np.diff(first)
                sid = set_ids(hashes, first)
                new = _unseen(sid, seen)
                new = new[size[new] > 0]
                own = bands.band(size[new])
                for band in np.unique(own).tolist():
                    for b in (band - 1, band):
                        pick = new[own == band]
                        number = 0
                        while len(pick) and b >= 0:
                            length = size[pick]
                            stop = np.cumsum(length)
                            at = np.repeat(first[pick] - (stop - length), length) + np.arange(stop[-1])
                            keys, owner = cut(hashes[at], np.concatenate(([0], stop)), b, number)
                            spare = bands.differ(length, b) + 1 - np.bincount(owner, minlength=len(pick))
                            name = spare * CUTS + min(2 * number + (b == band), CUTS - 1)
                            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sid[pick][owner]), pa.array(name[owner])], ["key", "sid", "cut"])
                            pick = pick[spare > 0]
                            number += 1

    return run


def _shared(batches):
    """The rows (key, sid and others) of keys with more than one set, each once, from rows in the order of key and sid."""
    last: list = []  # the row before a batch
    held = np.array([False])  # whether another set before it has its key
    names: list[str] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        rows = [batch.column(c).to_numpy() for c in names]
        rows = [np.concatenate(x) for x in zip(last, rows, strict=True)] if last else rows
        key, sid = rows[names.index("key")], rows[names.index("sid")]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))
        rows, key = [x[new] for x in rows], key[new]
        same = key[1:] == key[:-1]
        shared = np.concatenate((held, same)) | np.append(same, False)
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][shared[:-1]]) for x in rows], names)
        last, held = [x[-1:] for x in rows], shared[-1:]
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in last], names)


def _alone(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, ...]:
    """Of pairs (text_a, text_b): hash and pair of every shingle that one of the two lacks, whether a has it; sizes of a and of b."""
    a, fa = shingle_sets(part.column("text_a"), n)
    b, fb = shingle_sets(part.column("text_b"), n)
    rows = np.arange(part.num_rows)
    na, nb = np.diff(fa), np.diff(fb)
    owner = np.concatenate([np.repeat(rows, na), np.repeat(rows, nb)])
    hashes, old = np.concatenate([a, b]), np.arange(len(a) + len(b)) < len(a)
    order = np.lexsort((hashes, owner))
    h, o, old = hashes[order], owner[order], old[order]
    twin = np.zeros(len(h) + 1, bool)
    twin[1:-1] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    alone = ~(twin[1:] | twin[:-1])
    return h[alone], o[alone], old[alone], na, nb


def _late(part: pa.RecordBatch, h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """For shingles of the part's rows: their place in the ``hot`` list (upper halves of shingles) of the row's pivot, from 1; 0
    for those not in it. Rows of one pivot have the same list, which is looked at once."""
    _, one, pivot = np.unique(part.column("a").to_numpy(), return_index=True, return_inverse=True)
    hot = part.column("hot").take(pa.array(one))
    length = hot.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = hot.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32).astype(np.uint64)
    if not len(flat):
        return np.zeros(len(h), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length) + 1
    known = (np.repeat(np.arange(len(length), dtype=np.uint64), length) << np.uint64(32)) | flat
    order = np.argsort(known, kind="stable")
    known, place = known[order], place[order]
    asked = (pivot[o].astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, place[at], 0)


def _compare(n: int, percent: int):
    """For pairs (a, b) with their texts: whether they are similar, the size of b, the size of their difference, and, where
    ``wide``, the first shingles of the difference in the order: not in ``hot``, then as there; not in a, in a; by hash."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a"):
                h, o, old, na, nb = _alone(part, n)
                rows = np.arange(part.num_rows)
                differ = np.bincount(o, minlength=part.num_rows)
                both = (na + nb - differ) // 2
                similar = (100 * both >= percent * (both + differ)) & (na + nb > 0)
                wide = part.column("wide").to_numpy(zero_copy_only=False)
                pick = np.flatnonzero(wide[o])
                pick = pick[np.lexsort((h[pick], old[pick], _late(part, h[pick], o[pick]), o[pick]))]
                begin = np.searchsorted(o[pick], rows)
                most = nb * (100 - percent) // percent + 1  # one more than b can differ from any set similar to it
                pick = pick[np.arange(len(pick)) - begin[o[pick]] < most[o[pick]]]
                ends = np.searchsorted(o[pick], np.arange(part.num_rows + 1)).astype(np.int32)
                first = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[pick].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similar), pa.array(nb), pa.array(differ), first], ["a", "b", "similar", "size", "differ", "first"])

    return run


def _common(n: int):
    """a, shingle, n: shingles in the differences of several pairs of one ``a``, counted within the rows at hand."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a"):
                h, o, _, _, _ = _alone(part, n)
                names, pivot = np.unique(part.column("a").to_numpy(), return_inverse=True)
                pivot = pivot[o]
                order = np.lexsort((h, pivot))
                h, pivot = h[order], pivot[order]
                new = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (pivot[1:] != pivot[:-1]))))
                count = np.diff(np.append(new, len(h)))
                new, count = new[count > 1], count[count > 1]
                yield pa.RecordBatch.from_arrays([pa.array(names[pivot[new]]), pa.array(h[new].view(np.int64)), pa.array(count)], ["a", "shingle", "n"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """id, class (smallest id reachable) for every id that an edge (a, b) touches.

    Large stars and small stars in turn until nothing changes. Every table is written, so that no lineage grows and a join on a
    centre with many edges can be dealt anew.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        large = written(both.join(low, "a").where("b > a AND b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        small = large.join(low, "a").where("b <> low").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b"))
        new = written(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        sums = [tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) for x in (edges, new)]
        edges = new
        if sums[0] == sums[1]:
            break
    # at rest every a has one b, the smallest of its class
    return edges.select(F.col("a").alias("id"), F.col("b").alias("class")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct())


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` with both texts, the pairs of one ``a`` mostly together."""
    of = lambda c: texts.select(F.col("sid").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select(*pairs.columns, "text_a", "text_b")


def _compared(pairs: DataFrame, texts: DataFrame, n: int, percent: int, hot: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, wide) compared by their whole texts; ``hot``: per a, the shingles that come last, if any."""
    both = _with_texts(pairs, texts)
    both = both.withColumn("hot", F.lit(None).cast("array<int>")) if hot is None else both.join(hot, "a", "left")
    return both.mapInArrow(_compare(n, percent), "a long, b long, similar boolean, size long, differ long, first array<long>")


#: Members of a class that stand for it under one (pivot, shingle) while classes are still merged.
SPEAKERS = 4
#: Sets whose ids are broadcast to pick their texts; of more, all texts are shuffled.
BROADCAST_SETS = 500_000
#: Classes under one (pivot, shingle) from which on the pivot's differences are ordered anew, and the shingles of a pivot then
#: known to be frequent (both only save work: any order finds the same pairs).
CROWD, HOT = 8, 2048
#: What brings two differences together.
KEY = ["pivot", "shingle"]


def _mixed(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    """The rows of every (pivot, shingle) that holds two classes, with their class: a set linked with none so far is its own."""
    if classes is None:
        members = members.withColumn("class", F.col("sid"))
    else:
        members = members.join(classes, F.col("sid") == F.col("id"), "left").drop("id").withColumn("class", F.coalesce("class", "sid"))
    members = written(members, "differences")
    mixed = members.groupBy(KEY).agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select(KEY)
    return written(members.join(written(mixed, "mixed"), KEY), "differences")


def _rarest_first(members: DataFrame, classes: DataFrame | None, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``members`` with the differences to crowded pivots in a new order, the shingles that most of them share last.

    Whoever has no row here is similar to no set of another class under that pivot, so the order need not be known to it.
    """
    crowded = members.groupBy(KEY).agg(F.count_distinct("class").alias("n")).where(F.col("n") > CROWD).select("pivot").distinct()
    crowded = written(crowded, "crowded")
    if crowded.isEmpty():
        return members
    pairs = written(members.join(crowded, "pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b"), F.lit(True).alias("wide")).distinct(), "crowd")
    counts = _with_texts(pairs, texts).mapInArrow(_common(n), "a long, shingle long, n long").groupBy("a", "shingle").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "shingle"))).where(F.col("place") <= HOT)
    hot = F.transform(F.sort_array(F.collect_list(F.struct("place", "shingle")), asc=False), lambda x: F.shiftright(x["shingle"], 32).cast("int"))
    hot = written(top.groupBy("a").agg(hot.alias("hot")), "hot")
    again = _compared(pairs, texts, n, percent, hot)
    again = again.select(F.col("a").alias("pivot"), F.col("b").alias("sid"), "size", "differ", F.posexplode("first").alias("place", "shingle"))
    return written(members.join(crowded, "pivot", "left_anti").unionByName(_mixed(again, classes)), "ordered")


def _slack(percent: int) -> Column:
    """How early a difference has its shingle: of two sets that can be similar the sum is not negative."""
    return F.col("size") * (100 - percent) / (100 + percent) - F.col("place") + F.lit(1e-6)


def _other(members: DataFrame) -> DataFrame:
    """``members`` as the other side of a pair."""
    return members.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in ("class", "sid", "size", "differ", "place")])


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, wide), once each, of those whose differences to one pivot may overlap far enough."""
    most = F.floor((F.col("size") + F.col("o_size")) * (100 - percent) / (100 + percent) + F.lit(1e-9))  # by how much similar sets of these sizes differ
    overlap = F.least(F.col("differ") - F.col("place"), F.col("o_differ") - F.col("o_place"))
    fits = (2 * overlap >= F.col("differ") + F.col("o_differ") - most) & (F.abs(F.col("size") - F.col("o_size")) <= most)
    return pairs.where(fits).select(F.least("sid", "o_sid").alias("a"), F.greatest("sid", "o_sid").alias("b"), F.lit(False).alias("wide")).distinct()


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one (pivot, shingle) but of different classes, no pair of one class formed: a class may be large."""
    kinds = written(members.groupBy(*KEY, "class").agg(F.max(_slack(percent)).alias("slack")), "classes_of")
    other = kinds.select(*KEY, F.col("class").alias("o_class"), F.col("slack").alias("o_slack"))
    kinds = kinds.where("slack >= 0").join(other, KEY).where("class <> o_class AND slack + o_slack >= 0")
    kinds = written(kinds.select(*KEY, F.least("class", "o_class").alias("class"), F.greatest("class", "o_class").alias("o_class")).distinct(), "kinds")
    return kinds.join(members, [*KEY, "class"]).join(_other(members), [*KEY, "o_class"])


def _merged(edges: DataFrame, pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> tuple[DataFrame, bool]:
    """``edges`` with the pairs that are similar, and whether there are any."""
    sets = written(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "compared")
    if sets.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS:
        texts = texts.join(F.broadcast(sets), "sid", "left_semi")
    more = written(_compared(pairs, texts, n, percent), "more").where("similar").select("a", "b")
    return (edges, False) if more.isEmpty() else (edges.unionByName(more), True)


def _rarest(members: DataFrame) -> DataFrame:
    """key, sid: the rows of ``members`` (key, sid, cut) that two similar sets are sure to meet in, of keys with several of them.

    Similar sets agree on all blocks of a cut but those they can differ by. So in one order of all keys, rarest first, they meet
    within as many of each one's keys as it can differ by and one more. Its keys that nobody shares count among these.
    """
    sizes = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    own = Window.partitionBy("sid", "cut")
    placed = members.join(sizes, "key").withColumn("place", F.row_number().over(own.orderBy("n", "key"))).withColumn("shared", F.count(F.lit(1)).over(own))
    kept = placed.where(F.col("place") <= F.col("shared") + F.floor(F.col("cut") / CUTS)).select("key", "sid")
    kept = written(kept, "rarest")
    several = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return written(kept.join(written(several, "several"), "key"), "lists")


def linked_classes(rows: DataFrame, n: int, percent: int) -> DataFrame | None:
    """id, class for every set that is linked with a different one; None if there is none."""
    listed = rows.select("text").mapInArrow(_lists(n, percent), "key long, sid long, cut long")
    members = written(listed.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_shared, "key long, sid long, cut long"), "lists")
    members = _rarest(members)
    needed = written(members.select("sid").distinct(), "needed")
    needed = F.broadcast(needed) if needed.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS else needed.hint("shuffle_hash")
    texts = rows.select("text").mapInArrow(_texts(n), "sid long, text string").join(needed, "sid")
    texts = written(texts.groupBy("sid").agg(F.min("text").alias("text")), "texts")

    sizes = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    weights = written(members.join(sizes, "key").groupBy("sid").agg(F.sum("n").alias("weight")), "weights")
    pivots = members.join(weights, "sid").groupBy("key").agg(F.max(F.struct("weight", "sid")).alias("pivot")).select("key", F.col("pivot.sid").alias("a"))
    pairs = members.join(written(pivots, "pivots"), "key").where("sid <> a").select("a", F.col("sid").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    wide = pairs.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("wide"))  # a pivot of one other set has nothing to derive
    found = written(_compared(pairs.join(written(wide, "wide"), "a"), texts, n, percent), "found")
    edges = found.where("similar").select("a", "b")
    classes = None if edges.isEmpty() else written(components(edges), "classes")
    # one link merges two classes: first by a few members of each under a (pivot, shingle), then, where a class has more, by all
    # of those classes that are still apart
    apart = found.where(F.size("first") > 0).select(F.col("a").alias("pivot"), F.col("b").alias("sid"), "size", "differ", F.posexplode("first").alias("place", "shingle"))
    apart = _rarest_first(_mixed(apart, classes), classes, texts, n, percent)
    nearest = Window.partitionBy(*KEY, "class").orderBy("place", "differ", "sid")
    ranked = written(apart.withColumn("n", F.row_number().over(nearest)), "ranked")
    few = ranked.where(F.col("n") <= SPEAKERS)
    pairs = written(_fitting(few.where(_slack(percent) >= 0).join(_other(few), KEY).where("class <> o_class"), percent), "derived")
    edges, merged = _merged(edges, pairs, texts, n, percent)
    if merged:
        classes = written(components(edges), "classes")
    large = written(ranked.where(F.col("n") == SPEAKERS + 1).select(KEY).distinct(), "large")
    if not large.isEmpty():
        rest = _mixed(ranked.drop("class", "n").join(large, KEY), classes)
        rest = _fitting(_across(rest, percent), percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        edges, merged = _merged(edges, written(rest, "derived"), texts, n, percent)
        if merged:
            classes = written(components(edges), "classes")
    return classes


def near_classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Classes of documents linked, directly or through others, by 100 * |A and B| >= percent * |A or B| of their shingle sets.

    A set: the distinct n-word shingles of the text, A-Z lower-cased, words split at blanks; of fewer words, the whole sequence;
    without words (or a missing text) empty and linked with nothing. Result: doc_id, n_shingles, component_id (smallest doc_id
    reachable, itself included), class (an id of the class; missing for empty sets), text_hash; one row per input row. Rows are judged each by its own text, also where they repeat a doc_id;
    a missing doc_id is never the smallest. An empty table gives an empty result. Other columns are ignored. Sets and shingles
    are told apart by 64-bit hashes. ``percent`` must be above 50: below, similar sets need not share a block.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent: above 50, at most 100")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = written(rows.mapInArrow(_sets(n), "doc_id long, sid long, size long, text_hash long"), "sets")
    classes = linked_classes(rows, n, percent)
    ids = sets.where("size > 0").groupBy("sid").agg(F.min("doc_id").alias("low")).withColumn("class", F.col("sid"))
    if classes is not None:
        ids = ids.drop("class").join(classes, F.col("sid") == F.col("id"), "left").select("sid", "low", F.coalesce("class", "sid").alias("class"))
        ids = written(ids, "ids")
        ids = ids.join(written(ids.groupBy("class").agg(F.min("low").alias("least")), "least"), "class").select("sid", F.col("least").alias("low"), "class")
    ids = written(ids, "names")
    out = sets.join(ids, "sid", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"), "class", "text_hash")


@tidy
def op9_jaccard(spark, folder: str) -> DataFrame:
    """The whole of documents: 3-word shingles, 90 percent."""
    return near_classes(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
