"""What the rounds of ``closing`` send and carry over."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from shopsight.llm import closing
from shopsight.llm.components import least_labels
from shopsight.llm.shingles import parity


def batch(members):
    blobs = [np.sort(np.array(d, np.uint64)).tobytes() for _, d in members]
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in members], pa.int64()), pa.array(blobs, pa.binary())], names=["grp", "d"])


def test_a_task_names_only_what_most_of_its_members_have():
    members = [(7, [1, 2, 3, *range(100 * i, 100 * i + 20)]) for i in range(1, 400)] + [(8, [5, 6]), (8, [6, 9])]
    out = pa.Table.from_batches(closing._often(iter([batch(members)]))).to_pydict()
    assert sorted(zip(out["grp"], out["e"])) == [(7, 1), (7, 2), (7, 3), (8, 6)]


def test_moves_are_counted_over_all_tasks(spark):
    rng = np.random.default_rng(3)
    members = [(g, sorted({*rng.choice(12, 6, replace=False).tolist(), *range(1000 * g + 10 * i, 1000 * g + 10 * i + 4)})) for g in (1, 2) for i in range(1, 60)]
    apart = spark.createDataFrame([(g, bytearray(np.array(d, "<u8").tobytes())) for g, d in members], "grp bigint, d binary").repartition(5)
    want = {}
    for g in (1, 2):
        own = [d for x, d in members if x == g]
        want[g] = [e for e in sorted({e for d in own for e in d}) if 2 * sum(e in d for d in own) > len(own)]
    got = {r["grp"]: r["moves"] for r in closing._moves(apart.localCheckpoint()).collect()}
    assert got == {g: m for g, m in want.items() if m}


def test_labels_over_earlier_labels(spark):
    edges = [(5, 9), (9, 12), (2, 30), (30, 31), (40, 41)]
    later = [(12, 31), (41, 40), (50, 51), (51, 9), (7, 60)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    as_dict = lambda df: {r["node"]: r["label"] for r in df.collect()}
    known = least_labels(frame(edges), "a", "b")
    assert as_dict(least_labels(frame(later), "a", "b", known)) == as_dict(least_labels(frame(edges + later), "a", "b"))
    assert as_dict(least_labels(frame([]), "a", "b", known)) == as_dict(known)


def test_few_shingles_of_far_members_are_indexed_and_linked_members_meet(spark):
    """Members lack the same shingles of their centre by chance; only those that links need are sent on."""
    rng = np.random.default_rng(8)
    common = np.arange(1, 151, dtype=np.uint64)
    shingles = {}
    for family in range(40):
        own = np.concatenate([rng.choice(common, 150 - 30, replace=False), np.arange(30, dtype=np.uint64) + np.uint64(1000 * (family + 1))])
        for copy in range(3):
            kept = rng.choice(own, len(own) - 4 * copy, replace=False)
            shingles[len(shingles)] = np.sort(np.concatenate([kept, np.arange(copy, dtype=np.uint64) + np.uint64(1_000_000 + 10 * len(shingles))]))
    sets = spark.createDataFrame([(n, len(s), bytearray(s.tobytes())) for n, s in shingles.items()], "node bigint, n_shingles bigint, shingles binary")
    opened = closing.centred(sets.where("node > 0").selectExpr("0L AS grp", "node", "n_shingles", "0L AS lead"), sets, 80)
    rows = closing.leading(opened.selectExpr("*", "node AS label", "-1L AS lead_label"), 80).collect()
    first = {r["node"]: set(np.frombuffer(r["d"], "<u8")[: r["take"]].tolist()) for r in rows}
    d = {r["node"]: np.frombuffer(r["d"], "<u8") for r in rows}
    majority = {e for e in set(np.concatenate(list(shingles.values())).tolist()) if 2 * sum(e in shingles[n] for n in d) > len(d)}
    assert all(set(d[n].tolist()) == majority ^ set(shingles[n].tolist()) for n in d)
    pairs = [(a, b) for a in d for b in d if a < b and closing.linked(shingles[a], shingles[b], 80) and np.intersect1d(d[a], d[b]).size]
    assert len(pairs) > 60 and all(first[a] & first[b] for a, b in pairs)
    assert 2 * sum(map(len, first.values())) < sum(map(len, d.values()))
    found = closing.smaller_groups(opened.selectExpr("*", "node AS label", "-1L AS lead_label"), 80)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["grp"], set()).add(r["node"])
    assert all(any({a, b} <= g for g in groups.values()) for a, b in pairs)
    assert max(map(len, groups.values())) < len(d) / 4


def test_overlaps_against_brute_force(monkeypatch):
    monkeypatch.setattr(closing, "COLUMNS", 16)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 150, n)).astype(np.uint64) for n in (0, 1, 40, 90, 200, 0, 60)]
    got = closing.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    assert closing.overlaps([]).shape == (0, 0) and not closing.overlaps([sets[0], sets[5]]).any()


def families(rng, n):
    """Sets of 100 shingles, 70 of them common to all: near the leader of all, linked in threes."""
    common = np.arange(70, dtype=np.uint64)
    out = []
    for family in range(n):
        own = np.arange(30, dtype=np.uint64) + np.uint64(1000 * (family + 1))
        out += [np.sort(np.concatenate([common, own[: 30 - copy], np.arange(copy, dtype=np.uint64) + np.uint64(10**6 + 10 * len(out) + copy)])) for copy in range(3)]
    return [out[i] for i in rng.permutation(len(out))]


def stored(spark, shingles):
    rows = [(i, len(s), i, bytearray(s.tobytes()), bytearray(parity(s).tobytes())) for i, s in enumerate(shingles)]
    return spark.createDataFrame(rows, "node bigint, n_shingles bigint, weight bigint, shingles binary, parity binary").localCheckpoint()


@pytest.mark.parametrize(("block", "rounds"), [(512, 1), (2, 3)])
def test_a_group_of_hundreds_needs_no_rounds(spark, monkeypatch, block, rounds):
    """The members of a group without a member that most of them link with are settled at once; in parts, they end alike."""
    shingles = families(np.random.default_rng(6), 60)
    compared = []
    inner = closing.verified
    monkeypatch.setattr(closing, "verified", lambda pairs, *rest: compared.append(1) or inner(pairs, *rest))
    if block == 2:
        monkeypatch.setattr(closing, "BLOCK", block)
    monkeypatch.setattr(closing, "SLOT", 700)
    sets = stored(spark, shingles)
    labels, links = closing.closed(sets.selectExpr("0L AS grp", "node"), sets, 80, lambda a, b: True)
    got = {r["node"]: r["label"] for r in labels.collect()}
    family = [int(s[s >= 1000][0]) // 1000 for s in shingles]
    assert got == {i: family.index(f) for i, f in enumerate(family)}
    assert len(compared) <= rounds
    assert all(closing.linked(shingles[r["a"]], shingles[r["b"]], 80) for r in links.collect())


def test_differences_move_in_few_rows(spark):
    """A member sends one row for each slot and not one for each of its differences."""
    shingles = families(np.random.default_rng(7), 60)
    sets = stored(spark, shingles)
    opened = closing.centred(sets.where("node > 0").selectExpr("0L AS grp", "node", "n_shingles", "0L AS lead"), sets, 80)
    entries = closing.leading(opened.selectExpr("*", "node AS label", "-1L AS lead_label"), 80).where("take > 0").selectExpr("*", "2L AS slots").localCheckpoint()
    rows = entries.select("grp", "slots", "node", "label", "take", "d").mapInArrow(closing._sliced, "grp bigint, slot bigint, node bigint, label bigint, e binary").collect()
    assert len(rows) <= 2 * entries.count()
    held = {}
    for r in rows:
        e = np.frombuffer(r["e"], "<u8")
        assert len(e) and (e % 2 == r["slot"]).all()
        held.setdefault(r["node"], set()).update(e.tolist())
    assert held == {r["node"]: set(np.frombuffer(r["d"], "<u8")[: r["take"]].tolist()) for r in entries.collect()}
