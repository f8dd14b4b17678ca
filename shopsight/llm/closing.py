"""Components of a similarity join whose candidates come in groups, without comparing all members of a group.

A group is any list of sets among which links may exist (the sets under one
index entry). Each round compares the members of a group with one leader. Groups
whose other members are then in one component are closed. Open groups of one leader
become one, so a pair of leader and member goes on once, whatever number of entries
it shares. Of these, those of up to ``BLOCK`` members are settled in a task, by counts of what each two share. What a leader
leaves open in larger ones rests on a property of symmetric differences. Let a group's
centre be the shingles that more than half of its members have, ``d(A)`` those in
which A differs from the centre, and R the member for which ``w(A) = |d(A)| - t |A|``
is least, with ``t = (1 - s) / (1 + s)`` at likeness s. Sets link if they differ in at most
``t (|A| + |B|)`` shingles. Two members with disjoint ``d(A)`` and ``d(B)`` differ in
``|d(A)| + |d(B)|``, so if they link, ``w(A) + w(B) <= 0``, hence ``w(A) + w(R) <= 0``
and ``w(B) + w(R) <= 0``, and both link with R. Members with ``w(A) + w(R) <= 0`` differ from R
in so few shingles at most that they link with it without a comparison; all other links are between members that share a shingle of ``d``. These meet again in
smaller groups, one for each such shingle, and the next round gives these groups
leaders of their own. From the centre, members differ by their own edits only, so few
share one. A group's leader is its heaviest member and in none of its
smaller groups, whose leaders are lighter, so rounds end.

Few shingles of d get that far. A link needs ``2 |d(A) & d(B)| >= w(A) + w(B)``, and as ``d(A)`` is at most the sets'
difference larger than ``d(B)``, also ``|d(A) & d(B)| >= |d(A)| - t (|A| + |B|)``. So a member indexes only so many of the
first shingles of its d, in one order for all members, that a linked pair must share one of them; the
order begins with those that the centre lacks, which members seldom share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm.components import labelled, least_labels, narrowed
from shopsight.llm.shingles import _mixed, as_set, least_difference
from shopsight.session import materialize

#: Members of an open group that are compared with one another in one task, and the shingles that more than 64 of them have at most.
BLOCK = 512
BLOCK_SHINGLES = 1 << 21
#: Shingles shared in a block that are counted at once.
COLUMNS = 4_096
#: Shingles of a group's differences that one task matches, about.
SLOT = 1 << 18
#: Members or pairs, with their sets, that a task takes at least.
TASK_SETS = 1_000
#: Rows that a task sends on at once.
CHUNK = 50_000


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether percent * union <= 100 * intersection, for sorted distinct arrays; empty sets link with nothing."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


Estimate = Callable[[np.ndarray, np.ndarray], bool]


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """Add the shingles of both sets as set_a and set_b."""
    for column, name in ((a, "set_a"), (b, "set_b")):
        pairs = pairs.join(sets.select(F.col("node").alias(column), F.col("shingles").alias(name)), column)
    return pairs


def near_by_parity(pairs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """The pairs (a, b) of sets that do not differ in too many shingles by their parities, which drop no linked pair; stored."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("parity").alias(f"parity_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [x + y for x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b")))]
            both = zip(*([np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()] for c in ("parity_a", "parity_b")))
            near = [(100 - percent) * n >= (100 + percent) * least_difference(x, y) for n, (x, y) in zip(total, both)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    columns = ["a", "b", *(f"{c}_{side}" for c in ("n", "parity") for side in ("a", "b"))]
    return materialize(narrowed(pairs.select(*columns), rows, TASK_SETS).mapInArrow(run, "a bigint, b bigint"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, may_link: Estimate, rows: int) -> DataFrame:
    """Those of at most ``rows`` pairs (a, b) of sets that ``may_link`` does not rule out and that link as whole sets; stored.

    Whole sets travel only for pairs whose parities, a 64th to a 32nd of their size, leave a link possible.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*([as_set(x) for x in batch.column(c).to_pylist()] for c in ("set_a", "set_b")))
            yield batch.select(["a", "b"]).filter(pa.array([may_link(a, b) and linked(a, b, percent) for a, b in both], pa.bool_()))

    pairs = near_by_parity(pairs, sets, percent, rows)
    both = _with_sets(pairs, sets, "a", "b").select("a", "b", "set_a", "set_b")
    return materialize(narrowed(both, pairs.count(), TASK_SETS).mapInArrow(run, "a bigint, b bigint"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of some sorted distinct arrays share, from the shingles that more than one of them has."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate([np.empty(0, np.uint64), *sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]) - 1
    often = np.bincount(column) > 1
    owner, column = owner[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(often.sum()), COLUMNS):
        some = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), np.float32)  # counts up to COLUMNS are exact in it
        held[owner[some], column[some] - at] = 1
        both += (held @ held.T).astype(np.int64)
    return both


def within_blocks(members: DataFrame, sets: DataFrame, percent: int, may_link: Estimate) -> DataFrame:
    """Links (a, b) that join the components of each group; stored.

    ``members`` has grp, node and label. A group has ``BLOCK`` members at most, and
    members that are already in one component are not compared.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group.column("node").to_pylist()
        label = group.column("label").to_numpy().copy()
        shingles = [as_set(x) for x in group.column("shingles").to_pylist()]
        size, shared = np.array([len(x) for x in shingles], np.int64), overlaps(shingles)
        near = (shared > 0) & (100 * shared >= percent * (size[:, None] + size - shared))
        found: list[tuple[int, int]] = []
        for i in range(len(node)):
            while len(others := np.flatnonzero(near[i] & (label != label[i]))):
                j = others[0]
                near[i, j] = near[j, i] = False
                if may_link(shingles[i], shingles[j]):
                    found.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held = members.select("grp", "node", "label").join(sets.select("node", "shingles"), "node")
    return materialize(narrowed(held.groupBy("grp").applyInArrow(run, "a bigint, b bigint"), members.count(), TASK_SETS))


def _chunked(keys: list[tuple], arrays: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each value of the arrays, with its array's keys."""
    size = [len(x) for x in arrays]
    columns = [np.repeat(np.array(k, np.int64), size) for k in zip(*keys)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate(arrays).view(np.int64))], names=names)


def _by_group(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[dict[int, list[tuple[np.ndarray, ...]]]]:
    """Members' arrays by group, of so many members as a task holds at once."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    size = 0
    for batch in batches:
        for grp, *blobs in zip(*(batch.column(c).to_pylist() for c in ("grp", *columns))):
            held.setdefault(grp, []).append(tuple(map(as_set, blobs)))
            size += len(blobs[0]) // 8
            if size >= 10 * CHUNK:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp and e: the shingles that more than half of a group's members in one task have."""
    for held in _by_group(batches, ("d",)):
        keys, arrays = [], []
        for grp, own in held.items():
            e, times = np.unique(np.concatenate([d for d, in own]), return_counts=True)
            keys.append((grp,))
            arrays.append(e[2 * times > len(own)])
        yield _chunked(keys, arrays, ["grp", "e"])


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, e and times: how many of a group's members in one task have each shingle of ``asked``."""
    for held in _by_group(batches, ("d", "asked")):
        keys, arrays, times = [], [], []
        for grp, own in held.items():
            asked = own[0][1]
            keys.append((grp,))
            arrays.append(asked)
            times.append(np.sum([np.isin(asked, d, assume_unique=True) for d, _ in own], axis=0, dtype=np.int64))
        rows = _chunked(keys, arrays, ["grp", "e"])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(times))], names=["grp", "e", "times"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp and asked: a list of shingles as a sorted array."""
    for batch in batches:
        asked = [np.sort(np.array(x, np.int64).view(np.uint64)).tobytes() for x in batch.column("asked").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(asked, pa.binary())], names=["grp", "asked"])


def _moves(apart: DataFrame) -> DataFrame:
    """grp and moves: the shingles in which more than half of a group's members differ from its leader, at most twice a member's mean.

    What more than half of all members have, more than half of those in some task
    have, so tasks name these shingles first, at most twice a member's mean for
    each group, and then count them only.
    """
    asked = apart.select("grp", "d").mapInArrow(_often, "grp bigint, e bigint").groupBy("grp").agg(F.collect_set("e").alias("asked"))
    asked = materialize(asked.mapInArrow(_packed, "grp bigint, asked binary"))
    counted = apart.join(asked, "grp").select("grp", "d", "asked").mapInArrow(_times, "grp bigint, e bigint, times bigint")
    counted = counted.groupBy("grp", "e").agg(F.sum("times").alias("times"))
    members = apart.groupBy("grp").agg(F.count("*").alias("members"))
    return counted.join(members, "grp").where("2 * times > members").groupBy("grp").agg(F.sort_array(F.collect_list("e")).alias("moves"))


def _from_centre(d: np.ndarray, more: int, moves: np.ndarray) -> np.ndarray:
    """A member's differences from the centre, of those from the leader (first the ``more`` that the leader lacks) and the leader's from the centre."""
    lacks, has = d[:more], d[more:]
    return np.concatenate([np.setdiff1d(lacks, moves, assume_unique=True), np.setdiff1d(moves, d, assume_unique=True), np.setdiff1d(has, moves, assume_unique=True)])


def centred(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """grp, node, n_shingles, d (the shingles in which the node differs from the centre of its group), apart (their number) and w; stored.

    The centre has the shingles that more than half of the members have (of the leader's,
    where there is a tie), whether or not some member is that set. All d of a group have
    one order: what leader and centre lack, what one of them has, what both have.
    """

    def from_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lead = ([as_set(x) for x in batch.column(c).to_pylist()] for c in ("set_a", "set_b"))
            more = [np.setdiff1d(a, b, assume_unique=True) for a, b in zip(own, lead)]
            d = [np.concatenate([m, np.setdiff1d(b, a, assume_unique=True)]).tobytes() for m, a, b in zip(more, own, lead)]
            columns = [*(batch.column(c) for c in ("grp", "node", "n_shingles")), pa.array(d, pa.binary()), pa.array([len(m) for m in more], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "node", "n_shingles", "d", "more"])

    def from_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moves = [np.array(m or [], np.int64).view(np.uint64) for m in batch.column("moves").to_pylist()]
            d = [_from_centre(as_set(x), n, m) for x, n, m in zip(batch.column("d").to_pylist(), batch.column("more").to_pylist(), moves)]
            columns = [*(batch.column(c) for c in ("grp", "node", "n_shingles")), pa.array([x.tobytes() for x in d], pa.binary()), pa.array([len(x) for x in d], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "node", "n_shingles", "d", "apart"])

    both = _with_sets(opened.select("grp", "node", "n_shingles", "lead"), sets, "node", "lead")
    kind = "grp bigint, node bigint, n_shingles bigint, d binary"
    rows = opened.count()
    apart = materialize(narrowed(both.select("grp", "node", "n_shingles", "set_a", "set_b"), rows, TASK_SETS).mapInArrow(from_leader, f"{kind}, more bigint"))
    moved = apart.join(_moves(apart), "grp", "left").select("grp", "node", "n_shingles", "d", "more", "moves").mapInArrow(from_centre, f"{kind}, apart bigint")
    moved = narrowed(moved, rows, TASK_SETS)
    return materialize(moved.withColumn("w", (100 + percent) * F.col("apart") - (100 - percent) * F.col("n_shingles")))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, slot, node, label and e: the first ``take`` shingles of d by their slot, a row for each slot that a member has some in."""
    names = ["grp", "slot", "node", "label", "e"]
    for batch in batches:
        rows = []
        for grp, slots, node, label, take, d in zip(*(batch.column(c).to_pylist() for c in ("grp", "slots", "node", "label", "take", "d"))):
            first = as_set(d)[:take]
            slot = first % np.uint64(slots)
            rows += [(grp, k, node, label, first[slot == k].tobytes()) for k in np.unique(slot).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 4 else pa.int64()) for k in range(5)], names=names)


def _matched(slot: pa.Table) -> pa.Table:
    """grp (a hash of the members) and node of the lists of a slot's shingles that more than one label is in, one of equal lists."""
    slot = slot.combine_chunks()
    own = [as_set(x) for x in slot.column("e").to_pylist()]
    times = [len(x) for x in own]
    node, label = (np.repeat(slot.column(c).to_numpy(), times) for c in ("node", "label"))
    e = np.concatenate(own)
    order = np.lexsort((node, e))
    e, node, label = e[order], node[order], label[order]
    start = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    size = np.diff(np.append(start, len(e)))
    digest = np.add.reduceat(_mixed(node.astype(np.uint64)), start) + size.astype(np.uint64)
    apart = np.flatnonzero(np.minimum.reduceat(label, start) < np.maximum.reduceat(label, start))
    keep = np.zeros(len(start), bool)
    keep[apart[np.unique(digest[apart], return_index=True)[1]]] = True
    row = np.repeat(keep, size)
    return pa.table([pa.array(np.repeat(digest.view(np.int64), size)[row]), pa.array(node[row])], names=["grp", "node"])


def leading(opened: DataFrame, percent: int) -> DataFrame:
    """grp, node, label, d and take: of how many of its first shingles of d a member has one in common with each member it links with.

    A pair shares at least what either member needs: ``|d| - t`` times both sizes, and
    half the sum of both w. The nearest member's component links only outwards; the
    others with it and with one another.
    """
    up, down = 100 + percent, 100 - percent
    inside = F.col("label") == F.col("lead_label")
    best = opened.groupBy("grp").agg(
        F.min(F.when(inside, F.col("w"))).alias("w_in"),
        F.min(F.when(~inside, F.col("w"))).alias("w_out"),
        F.max("n_shingles").alias("n_most"),
    )
    least = F.when(inside, F.col("w_out")).otherwise(F.least("w_in", "w_out"))
    other = F.least(F.col("n_most"), F.floor(100 * F.col("n_shingles") / F.lit(percent)))
    by_size = F.col("apart") - F.floor(down * (F.col("n_shingles") + other) / F.lit(up))
    need = F.greatest(F.lit(1), by_size, F.ceil((F.col("w") + least) / F.lit(2 * up)))
    return opened.join(best, "grp").select("grp", "node", "label", "d", F.greatest(F.lit(0), F.col("apart") - need + 1).alias("take"))


def smaller_groups(opened: DataFrame, percent: int) -> DataFrame:
    """grp and node of the groups in which links that leaders did not show must lie; stored.

    ``opened`` has the columns of ``centred`` and the labels label and (of the member nearest to the centre) lead_label.
    """
    entries = materialize(leading(opened, percent).where("take > 0"))
    slots = entries.groupBy("grp").agg(F.ceil(F.sum("take") / F.lit(SLOT)).alias("slots"))
    sliced = entries.join(slots, "grp").select("grp", "slots", "node", "label", "take", "d")
    sliced = sliced.mapInArrow(_sliced, "grp bigint, slot bigint, node bigint, label bigint, e binary")
    found = sliced.groupBy("grp", "slot").applyInArrow(_matched, "grp bigint, node bigint").distinct()
    return materialize(narrowed(found, opened.count(), TASK_SETS))


def membership() -> list[Column]:
    """Aggregates of a list: its number of members and two hashes of them, by which equal lists are known."""
    return [F.count("*").alias("n_members"), F.bit_xor(F.xxhash64("node")).alias("digest"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("second")]


def closed(groups: DataFrame, sets: DataFrame, percent: int, may_link: Estimate) -> tuple[DataFrame, DataFrame]:
    """Labels (node, label) of the components over all links within groups, and the links that prove them.

    ``groups`` has grp and node; ``sets`` node, n_shingles, shingles, parity and weight of
    all members (the heaviest member of a group leads it); ``may_link`` drops pairs
    of sets that do not link before they are compared as a whole. Nodes without a
    link have no label. An empty table of groups gives empty results.
    """
    links = labels = None
    while True:
        members = groups.join(sets.select("node", "n_shingles", "weight"), "node")
        top = members.groupBy("grp").agg(F.max(F.struct("weight", "node", "n_shingles")).alias("top"))
        stars = members.join(top, "grp").where(F.col("node") != F.col("top.node"))
        stars = stars.select("grp", "node", "n_shingles", F.col("top.node").alias("lead"), F.col("top.n_shingles").alias("lead_n"))
        stars = materialize(narrowed(stars, groups.count()))
        rows = stars.count()
        if not rows:
            if links is None:
                links = stars.select(F.col("node").alias("a"), F.col("lead").alias("b"))
                labels = least_labels(links, "a", "b")
            return labels, links
        near = 100 * F.least("n_shingles", "lead_n") >= percent * F.greatest("n_shingles", "lead_n")
        pairs = stars.where(near).select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        if labels is not None:
            pairs = labelled(labelled(pairs, labels, "a", "x"), labels, "b", "y").where("x <> y")
        found = verified(pairs, sets, percent, may_link, rows)
        links = found if links is None else links.unionByName(found)
        labels = least_labels(found, "a", "b", labels)
        # open groups of one leader are one group
        merged = _open(labelled(stars, labels, "node", "label")).withColumn("grp", F.col("lead")).dropDuplicates(["grp", "node"])
        merged = materialize(narrowed(merged, rows))
        sizes = merged.groupBy("grp").agg(F.count("*").alias("rest"), F.sum("n_shingles").alias("held"))
        opened = materialize(narrowed(merged.join(sizes, "grp"), rows))
        block = (F.col("rest") <= BLOCK) & ((F.col("rest") <= 64) | (F.col("held") <= BLOCK_SHINGLES))
        small, large = opened.where(block), opened.where(~block)
        if not small.isEmpty():
            found = within_blocks(small, sets, percent, may_link)
            links, labels = links.unionByName(found), least_labels(found, "a", "b", labels)
        if large.isEmpty():
            return labels, links
        large = centred(large, sets, percent)
        nearest = large.groupBy("grp").agg(F.min(F.struct("w", "node")).alias("top"))
        large = materialize(narrowed(large.join(nearest, "grp").withColumn("lead", F.col("top.node")), rows, TASK_SETS))
        sure = large.where("node <> lead AND w + top.w <= 0").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
        found = materialize(narrowed(sure.distinct(), rows))
        links, labels = links.unionByName(found), least_labels(found, "a", "b", labels)
        large = _open(labelled(labelled(large.drop("top", "label"), labels, "node", "label"), labels, "lead", "lead_label"))
        groups = smaller_groups(materialize(narrowed(large, rows, TASK_SETS)), percent)


def _open(placed: DataFrame) -> DataFrame:
    """The members of the groups that more than one label has part in."""
    still = placed.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return placed.join(still.select("grp"), "grp", "left_semi")
