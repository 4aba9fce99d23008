from __future__ import annotations

import hashlib

import pytest

from tesora.llm import linededup

LONG = "a passage that many documents carry, well over forty"
BLANKS = " \t\n\x0b\x0c\r"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_chars=40, least_docs=5):
    """(doc, lines, dropped, digest) of every row, by a dictionary of keys."""
    cut = [(d, [(x, x.strip(BLANKS).translate(ASCII)) for x in (t or "").split("\n")]) for d, t in rows]
    holders = {}
    for d, lines in cut:
        for _, key in lines:
            if len(key) >= least_chars:
                holders.setdefault(key, set()).add(d)
    out = []
    for d, lines in cut:
        def stays(key, d=d):
            found = holders.get(key, ())
            return len(found) < least_docs or d == max((x for x in found if x is not None), default=None)

        kept = [x for x, key in lines if stays(key)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs, **kw):
    met = linededup.without_dropped(docs, linededup.drops(docs, **kw))
    rows = met.select("doc_id", "__lines", "__dropped", "__kept").collect()
    return sorted(((r[0], len(r[1]), r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows), key=str)


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs, **kw) == plain(rows, **kw)


def test_repeated_lines_stay_in_the_largest_id(spark):
    rows = [(i, f"own {i}\n {LONG.upper() if i % 2 else LONG}\t\nend\n{LONG}") for i in range(7)]
    rows += [(20 + i, f"{LONG} but only in four") for i in range(4)]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc: r.n_dropped for r in linededup.drops(docs).collect()} == dict.fromkeys(range(6), 2)


def test_repeats_within_one_document_do_not_count_as_documents(spark):
    check(spark, [(1, "\n".join([LONG] * 9)), (2, LONG), (3, "short\nshort")])


def test_bitmaps_of_many_lines(spark):
    many = [f"line {i} that is long enough to be a key of its own" for i in range(300)]
    rows = [(d, "\n".join(many[d:])) for d in range(6)] + [(9, "\n".join(many[130:131] + ["x"] * 200 + many[299:]))]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bitmaps = {r.doc: r.bitmap for r in linededup.drops(docs).collect()}
    assert 9 not in bitmaps and all(w.bits for b in bitmaps.values() for w in b)


def test_long_runs_of_kept_lines_take_no_words(spark):
    far = "\n".join(["y"] * 1000 + [LONG])
    docs = spark.createDataFrame([(i, far) for i in range(6)], "doc_id long, text string")
    assert {tuple(map(tuple, r.bitmap)) for r in linededup.drops(docs).collect()} == {((15, 1 << 40),)}


def test_other_letters_and_blanks(spark):
    wide = "ÉCOLE " * 8
    rows = [(i, f"{wide}\n{wide.lower()}\n {LONG}\n\x0b{LONG}\x0c\n{'漢' * 39}\n{'漢' * 40}") for i in range(5)]
    check(spark, rows)


def test_shared_and_missing_ids(spark):
    rows = [(None, LONG), (None, f"x\n{LONG}"), (1, LONG), (1, f"{LONG}\ny"), (2, LONG), (3, LONG), (3, LONG), (4, f"z\n{LONG}")]
    check(spark, rows)


def test_a_line_of_a_third_of_all_rows(spark):
    check(spark, [(i, f"{LONG}\nrow {i}" if i % 3 == 0 else f"{i} " * 30) for i in range(900)])


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(awkward) == plain(rows)
    assert found(awkward, least_chars=1, least_docs=2) == plain(rows, 1, 2)
    assert found(nothing) == []


@pytest.mark.parametrize("step", ["MapInArrow", "ArrowEval", "BatchEval", "MapInPandas", "FlatMap"])
def test_plan_is_native(spark, awkward, step):
    plan = linededup.without_dropped(awkward, linededup.drops(awkward))._jdf.queryExecution().toString()
    assert step not in plan
