from __future__ import annotations

import datetime as dt
import random

import pytest

from tesora.operators import mapping as mp

SCHEMA = "mapping_version string, relationship string, source_code string, target_code string, canonical_id string, valid_from date, valid_to date, share double"
DAY = dt.date(2024, 1, 1)
END = dt.date(2024, 12, 31)


def table(spark, *rows):
    """Rows of (relationship, source, target, share) or with (version, from, to) behind."""
    full = [(r[4] if len(r) > 4 else "v", r[0], r[1], r[2], f"C:{r[2] or r[1]}", *(r[5:7] if len(r) > 5 else (DAY, END)), r[3]) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def reasons(df):
    return {(r.source_code, r.reason_code) for r in mp.check_mapping(df).quarantine.collect()}


def test_every_fault_sends_the_whole_code_to_review(spark):
    df = table(
        spark,
        ("one_to_one", "good", "a", None),
        ("merged", "kind", "a", None),
        ("one_to_one", "target", None, None),
        ("retired", "ended", "a", None),
        ("renamed_same_code", "name", "other", None),
        ("one_to_many", "share", "a", 1.5),
        ("one_to_many", "share", "b", 0.5),
        ("one_to_many", "noshare", "b", None),
        ("one_to_one", "two", "a", None),
        ("one_to_one", "two", "b", None),
        ("one_to_many", "mixed", "a", 0.5),
        ("one_to_one", "mixed", "b", None),
        ("one_to_many", "sum", "a", 0.5),
        ("one_to_many", "sum", "b", 0.4),
        ("one_to_many", "twice", "a", 0.5),
        ("one_to_many", "twice", "a", 0.5),
        ("one_to_one", "span", "a", None, "v", END, DAY),
        ("one_to_one", "lap", "a", None, "v", DAY, dt.date(2024, 6, 1)),
        ("one_to_one", "lap", "b", None, "v", dt.date(2024, 6, 1), None),
        ("one_to_one", "lap", "b", None, "w", dt.date(2024, 6, 1), None),
        (None, "null", "a", None),
    )
    assert reasons(df) == {
        ("kind", "UNKNOWN_RELATIONSHIP"), ("null", "UNKNOWN_RELATIONSHIP"), ("target", "MISSING_TARGET"), ("ended", "UNEXPECTED_TARGET"),
        ("name", "CODE_CHANGED"), ("share", "BAD_SHARE"), ("noshare", "BAD_SHARE"), ("two", "AMBIGUOUS"), ("mixed", "AMBIGUOUS"),
        ("sum", "SHARES_DO_NOT_SUM"), ("twice", "AMBIGUOUS"), ("span", "BAD_INTERVAL"), ("lap", "OVERLAP"),
    }
    kept = mp.check_mapping(df).clean.collect()
    assert sorted((r.mapping_version, r.source_code) for r in kept) == [("v", "good"), ("w", "lap")]
    assert mp.check_mapping(df).quarantine.count() == df.count() - 2


def test_missing_keys_go_to_review(spark):
    df = table(spark, ("one_to_one", None, "a", None), ("one_to_one", "x", "a", None, None, DAY, END))
    assert {r.reason_code for r in mp.check_mapping(df).quarantine.collect()} == {"MISSING_KEY"}
    assert mp.check_mapping(df.limit(0)).clean.count() == 0


def test_amounts_add_up_whatever_the_shares(spark):
    rng = random.Random(1)
    third = 1 / 3
    rows = table(
        spark,
        ("one_to_many", "s", "a", third), ("one_to_many", "s", "b", third), ("one_to_many", "s", "c", 1 - 2 * third),
        ("many_to_one", "m", "a", None), ("retired", "r", None, None), ("excluded", "e", None, None),
    )
    clean = mp.check_mapping(rows)
    assert clean.quarantine.count() == 0
    facts = [(i, rng.choice(["s", "m", "r", "e", "u", None]), dt.date(2024, 5, 1), rng.randint(-1000, 10**12)) for i in range(200)]
    facts += [(900, "s", dt.date(2025, 1, 1), 7), (901, "s", END, 1), (902, "s", DAY, -1), (903, "s", DAY, 100)]
    df = spark.createDataFrame(facts, "id int, code string, day date, cents long").repartition(3)
    out = mp.apply_mapping(df, clean.clean, code="code", on="day", amount="cents")
    parts = {}
    for r in out.clean.collect():
        parts.setdefault(r.id, {})[r.target_code] = r.cents
    amount = {i: c for i, *_, c in facts}
    assert all(sum(p.values()) == amount[i] for i, p in parts.items())
    assert parts[903] == {"a": 33, "b": 34, "c": 33} and max(abs(parts[i][t] - amount[i] / 3) for i in parts if len(parts[i]) == 3 for t in "abc") <= 1
    behind = {r.id: r.reason_code for r in out.quarantine.collect()}
    assert set(parts) | set(behind) == set(amount) and not set(parts) & set(behind)
    assert behind[900] == "UNMAPPED" and {behind[i] for i, c, *_ in facts if c == "r"} == {"RETIRED"}
    assert {behind[i] for i, c, *_ in facts if c is None} == {"UNMAPPED"}


def plain_paths(edges, versions):
    """Follow every path through a dictionary of {(version, code): [(target, share)]}."""
    out = []

    def follow(at, code, share, seen):
        if at == len(versions):
            out.append((seen[0], code, round(share, 9), "FINAL"))
            return
        found = edges.get((versions[at], code))
        if found is None:
            out.append((seen[0], code, round(share, 9), "UNMAPPED"))
        for target, part in found or ():
            if target is None:
                out.append((seen[0], None, round(share, 9), "RETIRED"))
            else:
                follow(at + 1, target, share * part, [*seen, target])

    for version, code in edges:
        if version == versions[0]:
            follow(0, code, 1.0, [code])
    return sorted(out, key=str)


def test_composition_over_years(spark):
    rng = random.Random(3)
    codes, rows, edges = [f"c{i}" for i in range(12)], [], {}
    for version in ("1", "2", "3", "4"):
        for c in codes:
            kind = rng.choice(["one", "one", "split", "end", "none"])
            if kind == "one":
                found = [(rng.choice(codes), 1.0)]
                rows.append(("one_to_one", c, found[0][0], None, version, DAY, END))
            elif kind == "split":
                a, b = rng.sample(codes, 2)
                found = [(a, 0.25), (b, 0.75)]
                rows += [("one_to_many", c, t, s, version, DAY, END) for t, s in found]
            elif kind == "end":
                found = [(None, 1.0)]
                rows.append(("retired", c, None, None, version, DAY, END))
            else:
                continue
            edges[version, c] = found
    mapping = mp.check_mapping(table(spark, *rows)).clean
    paths = mp.compose(mapping, versions=["1", "2", "3", "4"])
    got = sorted(((r.source_code, r.target_code, round(r.share, 9), r.status) for r in paths.collect()), key=str)
    assert got == plain_paths(edges, ["1", "2", "3", "4"])
    final = {}
    for s, t, share, status in got:
        if status == "FINAL":
            final[s, t] = final.get((s, t), 0) + share
    named = {(r.source_code, r.target_code): r for r in mp.relationship_of(paths).collect()}
    assert {k: round(r.share, 6) for k, r in named.items()} == {k: round(v, 6) for k, v in final.items()}


def test_chains_end_and_cycles_are_found(spark):
    chain = [("one_to_one", f"n{i}", f"n{i + 1}", None) for i in range(9)]
    cycle = [("one_to_one", a, b, None) for a, b in ("xy", "yz", "zx", "wx")]
    df = table(spark, *chain, *cycle, ("renamed_same_code", "same", "same", None), ("one_to_one", "gone", "r", None), ("retired", "r", None, None))
    got = {r.source_code: (r.target_code, r.status, len(r.codes)) for r in mp.compose(mp.check_mapping(df).clean).collect()}
    assert got["n0"] == ("n9", "FINAL", 9) and got["n8"] == ("n9", "FINAL", 1)
    assert all(got[c][1] == "CYCLE" for c in "xyzw")
    assert got["same"][:2] == ("same", "FINAL") and got["gone"][:2] == (None, "RETIRED")
    assert mp.compose(mp.check_mapping(df.limit(0)).clean).count() == 0


@pytest.mark.parametrize("amount", [-5, 0, 1, 99, 10**15])
def test_cuts_at_cumulative_shares(spark, amount):
    from pyspark.sql import functions as F

    cuts = [0.0, 0.1, 0.1 + 0.2, 0.6, 1.0]
    parts = [mp.part_of(F.lit(amount), F.lit(a), F.lit(b)) for a, b in zip(cuts, cuts[1:])]
    assert sum(spark.range(1).select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()) == amount
