"""Spelling variants against a plain version over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows):
    out = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        found = sorted((v for v in counts if v != w and near(v, w)), key=lambda v: (-counts[v], v))
        form = found[0] if found and counts[found[0]] >= 2 * n else None
        out[w] = (form, n, len(found))
    rows = set()
    for w, (form, n, many) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, many, counts[form] if form else None))
    return rows


def texts(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aabcÀéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaa", "aaaaaaa", "baaaaa", "ababab", "bababa"]
    rows = []
    for d in range(60):
        words = []
        for _ in range(80):
            w = rng.choice(stems)
            k = rng.randrange(len(w))
            w = rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abÉ") + w[k:], w[:k] + rng.choice("abÿ") + w[k + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w.capitalize() if w.isascii() else w]))
        rows.append((d, rng.choice([" ", "\n", "1", "漢", "Ω", "-"]).join(words)))
    long = "".join(rng.choice("xyz") for _ in range(3000))
    rows += [(100, f"{long} {long[:-1]} {long[1:]} {long[:1500]}é{long[1501:]}")] * 3
    return rows + [(None, "Ünïcode words words words wordz wordz wordz"), (101, None), (102, ""), (103, "1 2 3 漢字 ΩΩΩΩΩ"), (0, rows[0][1]), (0, rows[0][1])]


@pytest.mark.parametrize("block", [7, 64, 1 << 14])
def test_variants_equal_all_pairs(spark, block):
    from orograph.llm.variants import variants

    rows = texts(3)
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as word", "doc_id as n", "text as form", "doc_id as root").repartition(5)
    got = variants(table, block=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(plain_counts(rows)))


def test_variants_of_nothing(spark):
    from orograph.llm.variants import variants

    assert variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0


def test_chains_are_followed_to_their_end(spark):
    from orograph.llm.variants import rooted

    forms = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(40)], "word string, form string")
    assert {(r.word, r.root) for r in rooted(forms).collect()} == {(f"w{k:02}", "w40") for k in range(40)}


def test_runs_are_whole_across_slices(monkeypatch):
    from orograph.llm import variants

    rng = random.Random(1)
    text = "".join(rng.choice(["abc", "é", " ", "漢", "À", "9", "zz\n"]) for _ in range(4000))
    want = Counter(w.encode() for w in RUN.findall(text))
    monkeypatch.setattr(variants, "SLICE", 50)
    assert variants.runs(text.encode().replace("À".encode(), "À".encode())) == want


def test_rectangles_equal_a_scan():
    from orograph.llm.wavelet import Wavelet

    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 64, 100):
        v = rng.permutation(n)
        l, r, a, b = (rng.integers(0, n + 1, 50) for _ in range(4))
        q, found = Wavelet(v).report(l, r, a, b)
        want = {(i, int(x)) for i in range(50) for x in v[l[i] : r[i]] if a[i] <= x < b[i]}
        assert set(zip(q.tolist(), found.tolist())) == want and len(q) == len(want)
