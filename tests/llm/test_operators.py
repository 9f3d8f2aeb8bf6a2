"""Each operator against a plain version, on nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def same(df, want):
    assert Counter(tuple(r) for r in df.collect()) == Counter(want)


# 1
def test_sentencepiece_round_trip(docs, no_docs, rows):
    from orograph.llm.pieces import round_trip

    got = round_trip(docs).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((d, sha(t or "")) for d, t, *_ in rows)
    assert all(r.lossless and r.text_sha256 == r.decoded_sha256 for r in got)
    assert round_trip(no_docs).count() == 0
    again = {(r.doc_id, r.text_sha256): r.ids_sha256 for r in round_trip(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text_sha256): r.ids_sha256 for r in got}


def test_sentencepiece_decodes_what_was_encoded(spark):
    from orograph.llm.pieces import decode, encode, round_trip

    long = "".join(f"Stretch {k} of \u00e9 very  long text\n" for k in range(60_000))
    rows = [(1, long, "d"), (2, None, "d"), (3, "", None), (4, " a ", "d"), (4, " a ", "d"), (None, "x" * 70_000, "d"), (5, long[:700], "d")]
    table = spark.createDataFrame(rows, "doc_id long, text string, decoded string").coalesce(1)
    encoded = encode(table)
    got = decode(encoded).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((d, t or "") for d, t, _ in rows)
    ids = {r.doc_id: r.ids for r in got}
    assert len(ids[1]) > 1 << 18 and ids[2] == ids[3] == []
    digests = {r.doc_id: (r.n_pieces, r.ids_sha256, r.lossless) for r in round_trip(table).collect()}
    assert digests == {d: (len(i), sha(",".join(map(str, i))), True) for d, i in ids.items()}
    nothing = decode(encoded.limit(0)).collect()
    missing = decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()
    assert nothing == [] and missing[0].decoded == ""


def test_sentencepiece_sampling_follows_the_lattice():
    from orograph.llm import pieces, vocab

    model = pieces.Model(vocab.VOCABULARY, pieces.ALPHA)
    known = {p: (i, model.weight[i]) for i, (p, _) in enumerate(vocab.pieces(vocab.VOCABULARY)) if p}

    def ways(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                for rest, w in ways(s[n:]):
                    yield (known[s[:n]][0], *rest), known[s[:n]][1] + w

    every = dict(ways("▁the▁king"))
    total = sum(np.exp(w) for w in every.values())
    n = 20_000
    ids, bounds = pieces.sample(model, pa.array(["the king"] * n), pieces.mix64(np.arange(n).astype(np.uint64)), 1)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    assert set(seen) <= set(every)
    assert max(abs(np.exp(w) / total - seen[t] / n) for t, w in every.items()) < 0.015


def test_sentencepiece_other_columns_pass(clashing):
    from orograph.llm.pieces import encode

    got = encode(clashing)
    assert set(got.columns) == set(clashing.columns)
    assert got.filter("target <> 'x-target'").count() == 0


# 2
PAGES = [(1, "http://a", "p" * 150), (2, "http://b", "p" * 150), (3, None, "short"), (4, "u\r\nv é", "short"), (5, "http://e", None), (6, "http://f", ""), (None, "http://g", "p" * 150), (None, "h", "q" * 120), (None, "h", "q" * 120), (8, "x", "é\r\n\r\nWARC/1.1\r\n" * 40), (9, "x", "z" * 300_000), (1, "http://a", "p" * 150), (7, "x", "é\r\n\r\nWARC/1.1\r\n" * 40)]


def test_warc(spark):
    from orograph.llm.warc import archive_pages

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    want = []
    for p, _, h in PAGES:
        data = (h or "").encode()
        ids = [q for q, _, g in PAGES if (g or "").encode() == data and q is not None]
        first = min(ids, default=None) if len(data) >= 100 else None
        other = first is not None and p != first
        want.append((p, len(data), sha(data), "revisit" if other else "response", first if other else None))
    same(archive_pages(pages.repartition(3)).drop("url"), want)
    assert archive_pages(pages.limit(0)).count() == 0


def test_warc_members_open_alone(spark, tmp_path):
    import gzip

    from orograph.llm.warc import normalise, with_revisits, write_archives

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    raw = write_archives(with_revisits(pages), f"file://{tmp_path}").persist()
    done = normalise(raw, f"file://{tmp_path}").collect()
    for r in done:
        data = open(r["path"].removeprefix("file://"), "rb").read()
        entries = [x.split("\t") for x in open(r["index"].removeprefix("file://")).read().splitlines()]
        assert len(entries) == r["n_records"]
        assert sum(int(x[1]) for x in entries) == len(data)
        for offset, length, *_ in entries:
            assert gzip.decompress(data[int(offset) : int(offset) + int(length)]).startswith(b"WARC/1.1\r\n")


# 3
def test_token_counts(docs, no_docs, clashing, rows):
    from orograph.llm import tokencounts, vocab

    first, later = map(set, tokencounts.word_pieces(vocab.VOCABULARY))

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = next((j for j in range(min(len(w), i + 20), i, -1) if w[i:j] in (later if i else first)), None)
            if j is None:
                return -1
            n, i = n + 1, j
        return n

    want = []
    for d, t, *_ in rows:
        n = [greedy(w) for w in split(t)]
        want.append((d, len(n), sum(map(abs, n)), sum(x < 0 for x in n)))
    same(tokencounts.token_counts(docs), want)
    same(tokencounts.token_counts(clashing), want)
    assert tokencounts.token_counts(no_docs).count() == 0


# 4
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def test_pii(docs, no_docs, clashing, rows):
    from orograph.llm.pii import ADDED, find

    want = []
    for d, t, *_ in rows:
        s = base_spans(t)
        want.append((d, *(sum(k == x[0] for x in s) for k in BASE), sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))))
    got = find(docs)
    same(got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), want)
    kinds = Counter(s.split(":")[0] for r in got.collect() if r.spans for s in r.spans.split(","))
    assert all(kinds[k] for k in BASE)
    assert sum(kinds[k] for k in ADDED) == got.agg(F.sum("n_added")).first()[0]
    assert find(clashing).count() == len(rows)
    assert find(no_docs).count() == 0


def test_pii_redacts(docs, rows):
    from orograph.llm.pii import redacted

    got = redacted(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[60] is None and texts[61] == "" and texts[3] == rows[3][1]
    assert not any(base_spans(t) for d, t in texts.items() if d == 73)
    assert "[EMAIL]" in texts[73] and "[CARD]" in texts[73]


def test_pii_reliabilities_favour_the_reliable():
    import random

    from orograph.llm import pii

    rng, counts = random.Random(1), Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = tuple(pii.NONE if rng.random() < 0.2 else int(truth if rng.random() < right else not truth) for right in (0.95, 0.9, 0.85, 0.6, 0.55))
        counts[5, votes, 2, 1] += 1
    _, chance, post = pii.reliabilities([(*k, n) for k, n in sorted(counts.items())])
    right = [(t[1][pii.YES] / (t[1][pii.YES] + t[1][pii.NO])) for t in chance]
    assert right[0] > right[3] and right[1] > right[4]
    assert post[5, (1, 1, 1, 1, 1)] > 0.9 and post[5, (0, 0, 0, 0, 0)] < 0.1


# 5
def vectors(spark):
    rng = np.random.default_rng(3)
    out = [(int(i), rng.normal(0, 0.1, 8).tolist()) for i in range(-100, 450)]
    out += [(500 + i, [0.5] * 8) for i in range(60)]  # a group of equal vectors
    out += [(600, None), (700, [float("nan")] * 8), (701, [float("inf")] + [0.0] * 7), (702, [None] + [0.1] * 7), (703, []), (None, [0.1] * 8), (300, [0.2] * 8)]
    return out, spark.createDataFrame(out, "vec_id long, embedding array<double>")


@pytest.mark.parametrize(("shard", "block"), [(8192, 1024), (17, 3)])
def test_top_k(spark, shard, block):
    from orograph.llm.topk import top_k

    data, df = vectors(spark)
    ok = [(i, np.floor(np.array(v, float) * 1024).astype(int)) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        v = min([tuple(v) for i, v in ok if i == q])
        best = sorted((-int(np.dot(v, u)), i) for i, u in ok if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    same(top_k(df.withColumn("shard", F.lit("x")).repartition(3), shard=shard, block=block), want)
    assert top_k(df.limit(0)).count() == 0


def test_top_k_of_few(spark):
    from orograph.llm.topk import top_k

    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    same(top_k(df), [(0, 1, 2, 3072 * 1024), (0, 2, 1, 2048 * 1024)])


# 6
def test_repeated_bytes(docs, no_docs, clashing, rows):
    from orograph.llm.suffixes import drop_repeated_bytes

    n = 400
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(b[i : i + n] for _, b in texts for i in range(len(b) - n + 1))
    want = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((d, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), sha(kept)))
    assert sum(x[2] for x in want) > 5000
    same(drop_repeated_bytes(docs).drop("kept"), want)
    same(drop_repeated_bytes(clashing).drop("kept"), want)
    assert drop_repeated_bytes(no_docs).count() == 0


@pytest.mark.parametrize(("window", "gram"), [(40, 8), (11, 11), (7, 1)])
def test_anchors_are_the_first_of_the_least_grams(monkeypatch, window, gram):
    import pyarrow as pa

    from orograph.llm import windows as w

    monkeypatch.setattr(w, "SEGMENT", 70)
    monkeypatch.setattr(w, "LOOKUP", 3)
    rng = np.random.default_rng(gram)
    texts = ["".join(rng.choice(list("ab"), n)) for n in (300, 5, 0, 90)] + ["a" * 200, "ab" * 100, None]
    plan = w.Plan("byte", window, gram, (1,), refine=True)
    got = {}
    for s, _, seg in w.segments(pa.array(texts), plan):
        for a, p1, p2 in zip(seg.anchor, seg.p1, seg.p2, strict=True):
            for p in range(p1, p2 + 1):
                assert s + p not in got
                got[s + p] = s + a
    values, offs = w.sequence(pa.array(texts), "byte")
    grams = w.rolling(values(0, int(offs[-1])), gram)
    assert grams.dtype == np.uint32
    want = {}
    for b, e in zip(offs[:-1], offs[1:], strict=True):
        for p in range(b, e - window + 1):
            want[p] = p + int(np.argmin(grams[p : p + plan.places]))
    assert got == want
    # texts larger than the processor's cache are taken in pieces
    monkeypatch.undo()
    assert max(len(seg.values) for _, _, seg in w.segments(pa.array(["ab" * (1 << 19)]), plan)) <= (1 << 18) + window


# 7
def test_mix(docs, no_docs, clashing, rows):
    from orograph.llm.mixing import mix

    got = mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(split(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    source = {}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(split(t))) for d, t, *_ in rows)
    for d, t, _, s, _ in rows:
        source[d, len(split(t))] = s
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size] if r.doc_id != 72 else "s0"
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(target[s] - 5 <= taken[s] <= target[s] for s in names)
    assert Counter(map(tuple, mix(clashing.repartition(5)).collect())) == Counter(map(tuple, got))
    assert mix(no_docs).count() == 0


def test_mixed_documents_hold_what_is_taken(docs):
    from orograph.llm.mixing import mix, mixed_documents

    got = mixed_documents(docs)
    assert got.columns == docs.columns
    assert sum(len(split(r.text)) for r in got.collect()) == mix(docs).agg(F.sum("taken")).first()[0]


# 8
def test_quality(docs, no_docs, clashing, rows):
    from orograph.llm.quality import COUNTS, quality

    want = []
    for d, t, *_ in rows:
        w, t = split(t), t or ""
        three = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    got = quality(docs)
    same(got.select("doc_id", *COUNTS[:5], "base_failed"), want)
    assert not got.filter("base_failed and kept").count()
    kept = {r.doc_id for r in got.filter("kept").collect()}
    assert set(range(52)) <= kept
    assert quality(clashing).count() == len(rows)
    assert quality(no_docs).count() == 0


def test_each_measure_rejects_junk(spark):
    """Planted junk goes by the measure that it is made for; ordinary documents stay."""
    from orograph.llm.quality import quality

    rng = np.random.default_rng(11)
    known = "the of and to in that was for with his had this from which they were have when there their time would people water after first made many long find work part place".split()
    plain = lambda n: [known[i] + known[j] for i, j in rng.integers(0, len(known), (n, 2))]
    rows = [(i, " ".join(plain(rng.integers(90, 110)))) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "#%&"[i % 3] * 3 for w in plain(60))) for i in range(8)]
    rows += [(2000 + i, " ".join([*plain(80), *("\U0001F9EA" for _ in range(6))])) for i in range(8)]
    few = known[:9]
    rows += [(3000 + i, " ".join(few[j] + few[k] for j, k in rng.integers(0, 3, (100, 2)))) for i in range(8)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")).collect()}
    assert sum(got[i].kept for i in range(400)) >= 392
    for start, measure in ((1000, "chars_per_token"), (2000, "byte_share"), (3000, "entropy")):
        planted = [got[start + i] for i in range(8) if not got[start + i].base_failed]
        assert planted and not any(r.kept for r in planted)
        assert sum(measure in r.rejected_by.split(",") for r in planted) >= len(planted) / 2


@pytest.mark.parametrize("name", ["good_documents", "distinct_documents", "redacted", "mixed_documents"])
def test_stages_carry_columns_of_any_name(clashing, docs, name):
    from orograph.llm import minhash, mixing, pii, quality

    stage = {"good_documents": quality.good_documents, "distinct_documents": minhash.distinct_documents, "redacted": pii.redacted, "mixed_documents": mixing.mixed_documents}[name]
    got, want = stage(clashing), stage(docs)
    assert got.columns == clashing.columns
    extra = [c for c in clashing.columns if c not in docs.columns]
    rows = got.collect()
    assert all(r[c] == f"x-{c}" for r in rows for c in extra)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in want.collect())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_good_documents(docs):
    from orograph.llm.quality import good_documents, quality

    got = good_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in quality(docs).filter("kept").collect())


# 9
@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, no_docs, clashing, rows, size):
    from orograph.llm.minhash import near_duplicates

    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t, *_ in rows:
        w = split((t or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        least[find(i)].append(d)
    want = []
    for i, (d, *_) in enumerate(rows):
        c = min((x for x in least[find(i)] if x is not None), default=None)
        want.append((d, len(sets[i]), c, c is None or c == d))
    same(near_duplicates(docs, shingle=size), want)
    same(near_duplicates(clashing, shingle=size), want)
    assert near_duplicates(no_docs).count() == 0


def test_dense_region_is_searched_until_connected(spark):
    """Wider rounds must find what direct neighbours leave apart."""
    from orograph.llm import minhash

    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(120):
        w = list(base)
        for k in range(4):
            w[(i * 37 + k * 91) % 400] = f"x{i}-{k}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0}


@pytest.mark.parametrize("per", [1000, 20])
def test_components(spark, per):
    from orograph.llm.components import components

    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (300, 200), (200, 250)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), len(links), per).collect()))
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 180)} == {100} and {got[i] for i in (200, 250, 300)} == {200}


# 10
def test_repeated_passages(docs, no_docs, clashing, rows):
    from orograph.llm.substrings import drop_repeated_passages

    n, first = 50, {}
    for d, t, *_ in rows:
        w = split(t)
        for i in range(len(w) - n + 1):
            if d is not None:
                k = tuple(w[i : i + n])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, t, *_ in rows:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = True
        want.append((d, len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    assert sum(x[2] for x in want) > 1000
    same(drop_repeated_passages(docs).drop("kept"), want)
    same(drop_repeated_passages(clashing).drop("kept"), want)
    assert drop_repeated_passages(no_docs).count() == 0


def test_a_sketch_loses_nothing(spark):
    from orograph.llm import sketch
    from orograph.llm.textnp import mix64

    h = mix64(np.arange(5000).astype(np.uint64))
    twice = spark.createDataFrame([(int(x),) for x in np.concatenate([h[:300], h[:100]]).view(np.int64)], "r long").repartition(3)
    got, bits = sketch.of_column(twice, "r", 400, 2)
    assert sketch.holds(got, bits, h[:300]).all()
    assert sketch.holds(got, bits, h[300:]).mean() < 0.05


def removed_by_rule(rows, n=50):
    """(doc_id, words removed) by brute force."""
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    want = []
    for d, t in rows:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = True
        want.append((d, int(gone.sum())))
    return want


def test_passages_twice_in_a_document_lose_what_an_earlier_near_copy_has(spark):
    from orograph.llm.substrings import drop_repeated_passages

    rng = np.random.default_rng(4)
    fresh = lambda k: [f"w{x}" for x in rng.integers(0, 1 << 40, k)]
    rows = []
    for i in range(0, 60, 6):
        q = fresh(300)
        near = list(q)
        for at in (70, 150, 230):
            near[at] = "changed"
        part = fresh(300)
        rows += [(i, " ".join(near)), (i + 1, " ".join(q + fresh(20) + q)), (i + 2, " ".join(part[:120])), (i + 3, " ".join(part + fresh(20) + part + fresh(5) + part))]
        same_id = fresh(200)
        rows += [(i + 4, " ".join(same_id[:90])), (i + 5, " ".join(same_id + fresh(10))), (i + 5, " ".join(fresh(10) + same_id))]
    want = removed_by_rule(rows)
    assert want[1][1] > 500
    got = drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.select("doc_id", "n_removed"), want)


def exact_components(sets):
    """Smallest member of each component of pairs of similarity 0.8 and more, by exact comparison of all."""
    to = list(range(len(sets)))

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                to[b] = a
    return [root(i) for i in range(len(sets))]


def test_links_within_a_family_of_many_components(spark):
    """A template's documents are alike at 0.77 or so; some pairs among them are links."""
    from orograph.llm import minhash

    rng = np.random.default_rng(8)
    fresh = lambda k: [f"w{x}" for x in rng.integers(0, 1 << 40, k)]
    frame, texts = fresh(400), []
    for _ in range(150):
        own = fresh(56)
        texts.append(frame + own)
        texts.append(frame + own[:9] + fresh(47))
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = exact_components(sets)
    assert 100 < len(set(want)) < 250
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("tasks", [1, 4, 40])
def test_neighbours_reach_over_short_partitions(spark, tasks):
    from orograph.llm import minhash

    n, near = 200, 150
    rows = [(t, bytes(4 * minhash.DEPTH), 1000 * t + i, i) for t in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "tree int, key binary, c long, comp long")
    got = [(r.a, r.b) for r in minhash.neighbours(df, near, 3, tasks).collect()]
    want = {(1000 * t + i, 1000 * t + j) for t in range(2) for i in range(n) for j in range(i + 1, min(n, i + near + 1))}
    assert len(got) == len(set(got)) and set(got) == want


def test_recall_of_links_just_above_the_threshold(spark):
    from orograph.llm import minhash

    rng = np.random.default_rng(12)
    fresh = lambda k: [f"w{x}" for x in rng.integers(0, 1 << 40, k)]
    texts, links = [], []
    for i in range(300):
        w = fresh(204)
        v = w[: 204 - 22] + fresh(22)
        x, y = ({tuple(t[k : k + 5]) for k in range(200)} for t in (w, v))
        share = len(x & y) / len(x | y)
        assert 0.79 < share < 0.82
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        links.append(share >= 0.8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    found = [got[2 * i + 1] == 2 * i for i in range(300)]
    assert not any(f and not t for f, t in zip(found, links, strict=True))
    assert sum(found) >= 0.98 * sum(links)


@pytest.mark.parametrize("most", [7, 4096])
def test_all_that_is_apart_in_a_region_is_compared(spark, most):
    from orograph.llm import minhash

    rng = np.random.default_rng(4)
    rows, sets = [], {}
    for g, n in enumerate((2, 3, 40, 61)):
        core = rng.integers(0, 1 << 60, 80)
        for i in range(n):
            c = 1000 * g + i
            own = sets[c - 1][-21:] if i % 4 == 1 else rng.integers(0, 1 << 60, 21)
            sets[c] = np.concatenate([core, own[: 21 - i % 3], rng.integers(0, 1 << 60, i % 3)])
            rows.append((g, -(-n // most), c, 1000 * g + i // 8 * 8 if i % 8 < 2 else c, bytes(192), sorted(map(int, sets[c]))))
    for c, size in ((9000, 3), (9001, 30)):  # of sizes too different for any link
        sets[c] = rng.integers(0, 1 << 60, size)
        rows.append((9, 1, c, c, bytes(192), sorted(map(int, sets[c]))))
    df = minhash.blocked(spark.createDataFrame(rows, "region long, nb int, c long, comp long, sketch binary, shingles array<long>"))
    similar = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))
    pairs = {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and a[3] != b[3]}
    assert {r.c for r in minhash.partners(df).collect()} == {c for p in pairs for c in p}
    got = [(r.a, r.b) for r in minhash.confirmed(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= {p for p in pairs if similar(*p)}

    def components(links):
        up = {r[2]: r[3] for r in rows}
        for _ in range(len(up)):
            for a, b in links:
                low = min(up[a], up[b])
                up = {c: low if x in (up[a], up[b]) else x for c, x in up.items()} if up[a] != up[b] else up
        return up

    assert components(got) == components({p for p in pairs if similar(*p)})
    assert len(got) < len(rows) * (1 if most > 99 else 9) < len(pairs) * 9


def test_pii_of_a_long_text_with_many_spans(spark):
    from orograph.llm import pii

    parts, spans, at = [], {"email": [], "ip": []}, 0
    for i in range(25_000):
        for kind, before, match in (("email", "é mail ", f"a{i}@ex{i % 70}.com"), ("ip", " host ", f"81.2.{i % 250}.{i % 199}")):
            spans[kind].append((at + len(before), at + len(before) + len(match)))
            parts += [before, match]
            at += len(before) + len(match)
    text = "".join(parts)
    assert len(text) > 900_000
    want = ",".join(f"{k}:{a}:{b}" for k in ("email", "ip") for a, b in spans[k])
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    got = pii.find(table).first()
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (25_000, 25_000, 0, 0) and got.base_sha256 == sha(want)
    clean = pii.redacted(table).first().text
    assert clean == "é mail [EMAIL] host [IP]" * 25_000
    assert time.time() - start < 120


def test_pii_running_folds_and_cuts(spark):
    from orograph.llm import pii

    rng = np.random.default_rng(8)
    rows = []
    for n in (0, 1, 2, 3, 7, 64, 65):
        text = "".join(rng.choice(list("ab é😀\n"), 9 * n + 300 * (n == 7)))
        spans = sorted((int(a), int(a) + int(w), int(k)) for a, w, k in zip(rng.integers(0, max(1, len(text)), n), rng.integers(1, 6, n), rng.integers(0, 9, n), strict=True) if a + w <= len(text))
        wide = sorted((int(a), int(a) + 3) for a in rng.integers(0, 5 * n + 1, n))
        rows.append((text, spans, wide, rng.integers(0, 9, n).tolist()))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int,kind:int>>, wide array<struct<start:int,end:int>>, xs array<int>")
    base = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    got = df.select(
        "text", "spans", "wide", "xs", pii.replaced(F.col("text"), F.col("spans")).alias("clean"), pii.running(F.col("xs"), lambda x, y: x + F.coalesce(y, F.lit(0))).alias("sums"),
        F.when((F.size("wide") > 0) & (F.size("spans") > 0), pii.clear_of(F.col("wide"), base)).otherwise(F.col("wide")).alias("clear"),
    )
    for r in got.collect():
        assert r.sums == np.cumsum(r.xs).tolist()
        out, at = "", 0
        for s in r.spans:
            if s.start >= at:
                out += r.text[at : s.start] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.end)
        if r.spans:
            assert r.clean == out + r.text[at:]
        clear = [(w.start, w.end) for w in r.wide if not any(s.start < w.end and w.start < s.end for s in r.spans)]
        assert sorted((w.start, w.end) for w in r.clear) == sorted(clear)
