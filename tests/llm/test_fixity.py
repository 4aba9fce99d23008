from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesora.llm import fixity

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, digest string, part int, level int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], PAGES)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="shared tables are absent")
def test_query_matches_its_sql(spark):
    from oracle_check import compare, connect

    state, *_, note = compare(spark, connect(SMALL), SMALL, "op3", fixity.op3_fixity, fixity.OP3_SQL)
    assert state == "match", note


def test_record_bytes(spark):
    text = fixity.warc_records(pages(spark, [(3, "http://x/é", "<p>ü</p>")])).first()["record"].decode()
    head, body = text.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.1\r\n") and "Content-Length: 9" in head and body == "<p>ü</p>\r\n\r\n"


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_audit_finds_exactly_the_damage(spark, fan):
    rows = [(i, f"http://h/{i}", "p" * (i % 13)) for i in range(100)]
    records = fixity.warc_records(pages(spark, rows).repartition(5))
    places = fixity.manifest(records)
    body = F.when(F.col("page_id") == 17, F.encode(F.lit("short"), "UTF-8")).when(
        F.col("page_id") == 50, F.concat(F.substring("record", F.lit(1), F.octet_length("record") - 1), F.encode(F.lit("!"), "UTF-8"))
    )
    other = records.where("page_id not in (0, 99)").withColumn("record", F.coalesce(body, "record"))
    other = other.unionByName(spark.createDataFrame([(500, bytearray(b"new"))], "page_id long, record binary"))
    got = {r.page_id: r.status for r in fixity.audit(places, other, fan).collect()}
    assert got == {0: "missing", 99: "missing", 17: "resized", 50: "altered", 500: "extra"}


def laid_out(spark, rows):
    """A replica of (page_id, bytes) written one after another, with its own offsets."""
    at, out = 0, []
    for key, data in rows:
        out.append((key, at, bytearray(data)))
        at += len(data)
    return spark.createDataFrame(out, "page_id long, record_offset long, record binary").repartition(3)


def stored(spark, n=60):
    rows = [(i, f"http://h/{i}", "p" * (i % 13)) for i in range(n)]
    records = fixity.warc_records(pages(spark, rows).repartition(5))
    data = {r.page_id: bytes(r.record) for r in records.collect()}
    return fixity.manifest(records), [(i, data[i]) for i in range(n)]


@pytest.mark.parametrize(("fan", "span"), [(2, 300), (3, 1000), (64, 1 << 16)])
def test_replicas_with_their_own_places(spark, fan, span):
    places, rows = stored(spark)
    same = laid_out(spark, rows)
    assert fixity.audit(places, same, fan, span).count() == 0
    place = {r.page_id: r.record_offset for r in places.collect()}
    # reordered: two records have changed places, and what stands between them has shifted if their sizes differ
    swapped = [*rows]
    swapped[10], swapped[25] = rows[25], rows[10]
    other = laid_out(spark, swapped)
    own = {r.page_id: r.record_offset for r in other.collect()}
    got = {r.page_id: (r.status, r.found_offset) for r in fixity.audit(places, other, fan, span).collect()}
    assert got == {i: ("moved", own[i]) for i in own if own[i] != place[i]} and {10, 25} <= set(got)
    # shifted: a lost record moves all that follow
    got = {r.page_id: r.status for r in fixity.audit(places, laid_out(spark, rows[:40] + rows[41:]), fan, span).collect()}
    assert got == {40: "missing"} | {i: "moved" for i in range(41, 60)}
    # in place: one altered, one lost, one cut, one put behind the others
    held = [(r.page_id, r.record_offset, bytes(r.record)) for r in same.collect() if r.page_id != 3]
    held = [(i, at, b"#" * len(d) if i == 7 else d[:-5] if i == 50 else d) for i, at, d in held] + [(900, 10**6, b"new")]
    store = spark.createDataFrame([(i, at, bytearray(d)) for i, at, d in held], "page_id long, record_offset long, record binary")
    got = {r.page_id: r.status for r in fixity.audit(places, store.unionByName(store.limit(2)), fan, span).collect()}
    assert got == {3: "missing", 7: "altered", 50: "resized", 900: "extra"}


def test_only_differing_ranges_are_reached(spark):
    places, rows = stored(spark)
    rows[33] = (33, rows[33][1][:-1] + b"!")
    other = fixity.digests(laid_out(spark, rows))
    at = places.where("page_id = 33").first().record_offset
    height = 9  # more than enough levels: the root covers everything
    bad = fixity.differing(fixity.tree(places, height, 3, 400), fixity.tree(other, height, 3, 400), 3)
    assert [r.idx for r in bad.collect()] == [at // 400]


def test_repeated_and_null_ids_are_paired_by_offset(spark):
    rows = [(None, None, None), (None, "a", "b"), (5, "u", "x"), (5, "u", "x"), (5, "u", "y")]
    records = fixity.warc_records(pages(spark, rows))
    places = fixity.manifest(records)
    data = sorted(((r.page_id, bytes(r.record)) for r in records.collect()), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1]).hexdigest()))
    lost = [d for d in data if d[0] is None] + [d for d in data if d[0] == 5][:2]
    got = fixity.audit(places, laid_out(spark, [(k, b"?" * len(d)) for k, d in lost])).collect()
    assert sorted((r.page_id or 0, r.status) for r in got) == [(0, "altered"), (0, "altered"), (5, "altered"), (5, "altered"), (5, "missing")]


def test_equal_replicas_give_no_row(spark):
    records = fixity.warc_records(pages(spark, [(1, None, None), (None, "u", "x"), (2, "u", "")]))
    assert fixity.audit(fixity.manifest(records), records).count() == 0


def test_offsets_are_gapless_and_nulls_and_repeats_have_places(spark):
    rows = [(None, None, None), (None, "a", "b"), (5, "u", "x"), (5, "u", "x"), (5, "u", "y"), (2, "v", "z" * 100_000)]
    records = fixity.warc_records(pages(spark, rows).repartition(3))
    places = fixity.manifest(records)
    got = places.orderBy("record_offset").collect()
    assert [r.page_id for r in got] == [None, None, 2, 5, 5, 5]
    at = 0
    for r in got:
        assert r.record_offset == at
        at += r.length
    lost = fixity.audit(places, records.where("page_id is null or page_id <> 5")).collect()
    assert [r.status for r in lost] == ["missing"] * 3
    assert fixity.audit(places, records).count() == 0


def test_empty_table(spark):
    records = fixity.warc_records(pages(spark, []))
    places = fixity.manifest(records)
    assert places.count() == 0 and fixity.audit(places, records).count() == 0
    extra = fixity.audit(places, fixity.warc_records(pages(spark, [(1, "u", "h")]))).collect()
    assert [r.status for r in extra] == ["extra"]
