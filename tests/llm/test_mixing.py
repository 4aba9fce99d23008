from __future__ import annotations

import re
from pathlib import Path

import pytest
from conftest import SCHEMA, words
from hypothesis import given, settings
from hypothesis import strategies as st

from tesora.llm import mixing

SMALL = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by repeated sharing of the excess."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = total
    while open_:
        level = rest / sum(weight[i] for i in open_)
        full = {i for i in open_ if level * weight[i] >= most * sizes[i]}
        for i in full or open_:
            target[i] = most * sizes[i] if full else level * weight[i]
        if not full:
            break
        rest -= sum(target[i] for i in full)
        open_ -= full
    return target


@pytest.mark.skipif(not Path(SMALL).exists(), reason="shared tables are absent")
def test_query_matches_its_sql(spark):
    from oracle_check import compare, connect

    state, *_, note = compare(spark, connect(SMALL), SMALL, "op10", mixing.op10_mixing, mixing.OP10_SQL)
    assert state == "match", note


@pytest.mark.parametrize("sizes", [[100], [10, 1000, 3], [1, 1, 1, 500, 500, 2, 0], [0, 0], [7] * 10, [1000, 1, 1, 1]])
def test_targets(spark, sizes):
    names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert [got[n] for n in names] == pytest.approx(plain_targets(sizes))


@settings(max_examples=50)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=5).filter(any), st.floats(0, 1))
def test_positions_invert_the_integral(schedule, x):
    import duckdb

    at = duckdb.sql(f"SELECT {mixing.position_sql('0', f'CAST({x!r} AS DOUBLE)', [schedule])}").fetchall()[0][0]
    phase, inside = min(int(at * len(schedule)), len(schedule) - 1), at * len(schedule)
    due = sum(schedule[:phase]) + schedule[phase] * (inside - phase)
    assert due / sum(schedule) == pytest.approx(x, abs=1e-9) and 0 <= at <= 1


def test_awkward_rows(spark, awkward, nothing):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    rows = {(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in awkward.collect()}
    assert {(r.doc_id, r.source, r["size"]) for r in got} == rows
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        assert (r.positions is None) == (r.copies == 0)
    again = mixing.mix(awkward.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(nothing).count() == 0 and mixing.curriculum(nothing).count() == 0


def test_sources_come_near_their_targets(spark):
    rows = [(i, words(20 + i * 37 % 300, i), "en", f"s{i % 5}", 0, *[None] * 10) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken.setdefault((r.source, r.target), []).append(r.taken)
    for (_, target), parts in taken.items():
        assert sum(parts) == pytest.approx(target, rel=0.002)


def plain_last_pass(rows, rest):
    """Starts of the documents taken from (start, size) in order, one after another, and the one that closes the gap."""
    taken, gap, left = [], rest, []
    for start, size in rows:
        if size <= gap:
            taken.append(start)
            gap -= size
        else:
            left.append((size, start))
    near = [(abs(size - gap), start) for size, start in left if abs(size - gap) < gap]
    return taken, gap, near


@pytest.mark.parametrize("seed", range(4))
def test_a_document_of_a_third_of_its_source_does_not_end_the_pass(spark, seed):
    rows = [(i, words(60, i), "en", "a", 0, *[None] * 10) for i in range(300)]
    rows.append((1000 + seed, words(9000, seed), "en", "a", 0, *[None] * 10))
    rows += [(2000 + i, words(5 + i * 31 % 90, i), "en", [None, "b", "c"][i % 3], 0, *[None] * 10) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.01)


def test_the_last_pass_equals_one_after_another(spark):
    import hashlib

    rows = [(i, words(5 + i * i * 37 % 400, i), "en", f"s{i % 4}", 0, *[None] * 10) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {r[0]: r[1] for r in rows}
    for source in {r.source for r in got}:
        mine = sorted((r for r in got if r.source == source), key=lambda r: hashlib.md5(f"{r.doc_id} {text[r.doc_id]}".encode()).hexdigest())
        aim, total = int(mine[0].target), mine[0].source_size
        passes, at, queue = min(aim // total, 2), 0, []
        for r in mine:
            queue.append((at, r["size"]))
            at += r["size"]
        taken, gap, near = plain_last_pass(queue, aim - passes * total)
        extra = {s for r, (s, _) in zip(mine, queue, strict=True) if r.copies > passes}
        assert set(taken) <= extra and len(extra) == len(taken) + bool(near)
        if near:
            best = (extra - set(taken)).pop()
            assert abs(dict(queue)[best] - gap) == min(near)[0]


def test_copies_are_rows_in_training_order(spark):
    rows = [(i, words(50 + i, i), "en", f"s{i % 3}", 0, 1, 0.5, *[None] * 8) for i in range(60)] + [(7, "same text", "en", "s1", 0, *[None] * 10)] * 5
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix(docs).collect()
    mixed = mixing.curriculum(docs)
    assert mixed.columns == docs.columns
    found = [r.doc_id for r in mixed.collect()]
    want = [r.doc_id for r in plan for _ in range(r.copies)]
    assert sorted(found) == sorted(want)
    times = sorted((t, r.doc_id) for r in plan for t in r.positions or [])
    first = {d: t for t, d in reversed(times)}
    order = [first[d] for d in dict.fromkeys(found)]
    assert order == sorted(order)


def test_an_impossible_share_is_refused(spark):
    with pytest.raises(ValueError):
        mixing.targets(spark.createDataFrame([("a", 1)], "source string, source_size long"), share=(5, 2))


@pytest.mark.skipif(not Path(SMALL).exists(), reason="shared tables are absent")
def test_the_query_reads_the_range_sorted_mix(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen, real = [], mixing.in_order
    monkeypatch.setattr(mixing, "in_order", lambda plan: seen.append(real(plan)) or seen[-1])
    got = mixing.op10_mixing(spark, SMALL).collect()
    placed = seen[0].withColumns({"file": F.input_file_name(), "line": F.monotonically_increasing_id()}).collect()
    placed.sort(key=lambda r: (r.file.rsplit("/", 1)[1], r.line))
    times = [r.position for r in placed]
    taken = [t for t in times if t is not None]
    assert times == sorted(taken) + [None] * (len(times) - len(taken))
    assert sum(r.taken for r in got) == sum(r["size"] for r in placed if r.position is not None)
    assert len(taken) == sum(r.taken // r["size"] for r in got if r.taken)


def test_the_mix_starts_no_python_workers(spark, awkward):
    """Its inputs are written tables; an empty table made of rows of the driver is a Python job on all executors."""
    plan = mixing.mix(awkward)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
