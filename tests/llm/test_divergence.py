from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tesora.llm import divergence, terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=50):
    """All groups of (text, lang, source) rows against each other, term by term."""
    held = [([t.translate(ASCII) for t in TERM.findall(x or "")], g or "", s or "") for x, g, s in rows]
    out = []
    for lang in {g for _, g, _ in held}:
        df, counts, whole = Counter(), {}, Counter()
        for found, g, s in held:
            if g == lang:
                df.update(set(found))
                counts.setdefault(s, Counter()).update(found)
                whole.update(found)
        kept = [t for t, n in df.items() if n >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // total for t in kept}

        q = shares(whole)
        p = {s: shares(c) for s, c in counts.items()}
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            above = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", above, top)):
                ranked = sorted(found, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def sample(n, seed=2):
    rng = random.Random(seed)
    words = [("ß" if i % 7 == 0 else "") + "abcdefghijklmnopqrstuvwxyz"[i % 26] * (1 + i % 23) for i in range(80)]
    return [
        (" ".join(rng.choices(words, range(80, 0, -1), k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "ä", "z", "b", None]))
        for _ in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)


def test_equals_plain_counting(spark):
    rows = sample(300)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == plain(rows)


def test_blocks_and_tiles(spark):
    rows = sample(300, 4)
    groups, kept = divergence.profiles(frame(spark, rows), 5)
    found = divergence.pair_rows(groups, kept, block=7, tile=2).collect()
    want = {(g, s, i): v for g, s, part, i, v, _ in plain(rows, 5) if part == "pair"}
    assert {(r.lang, r.source, r["item"]): r.value for r in found} == want and len(found) == len(want)


def test_language_without_common_terms(spark):
    rows = [("one two", "en", "a"), (None, "en", "b"), ("x", "en", "c"), ("", None, None)]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == plain(rows)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    assert sorted(map(tuple, divergence.audit(awkward, least_docs=1).collect())) == plain(rows, 1)
    assert divergence.audit(nothing).count() == 0


def test_counts_of_a_piece():
    texts = ["Aa b aa" + " c" * 3, "", "b abcdefghi abcdefghi abcdefgh", "x" * 17 + " " + "x" * 17 + " é1É", "aa"]
    (row, data, offsets), *rest = terms.steps(pa.array(texts))
    assert (row, rest) == (0, [])
    got = {}
    for of, found, n, docs in divergence.count_terms(data, offsets, np.array([0, 0, 1, 1, 0])):
        got |= {(g, t.decode()): (a, b) for g, t, a, b in zip(of.tolist(), found, n.tolist(), docs.tolist(), strict=True)}
    want = {(0, "aa"): (3, 2), (0, "b"): (1, 1), (0, "c"): (3, 1), (1, "b"): (1, 1), (1, "abcdefghi"): (2, 1), (1, "abcdefgh"): (1, 1)}
    assert got == want | {(1, "x" * 17): (2, 1), (1, "é"): (1, 1), (1, "É"): (1, 1)}


def test_steps_cut_between_rows():
    texts = pa.array(["ab", None, "cdef", "", "g" * 50, "h"]).slice(1)
    found = [(row, bytes(data[:-16]), (offsets - offsets[0]).tolist()) for row, data, offsets in terms.steps(texts, 5)]
    assert found == [(0, b"cdef", [0, 0, 4, 4]), (3, b"g" * 50, [0, 50]), (4, b"h", [0, 1])]


def test_radix_order_is_stable():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 500, np.uint64) >> s for s in (np.uint64(55), np.uint64(1)))
    assert terms.radix_order(a, b).tolist() == sorted(range(500), key=lambda i: (a[i], b[i], i))
    assert terms.radix_order(np.empty(0, np.uint64)).tolist() == []


def test_share_beyond_64_bits(spark):
    cases = [(10**12, 10**13, 7), (0, 0, 1), (5, 5, 3), (10**14, 10**14, 10**6)]
    df = spark.createDataFrame(cases, "n long, total long, terms long")
    got = [r[0] for r in df.select(divergence.share(df.n, df.total, df.terms)).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * v) for n, total, v in cases]
