"""Every operator on small awkward inputs, against brute force."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pytest

from gridfold.llm import ctw, exact_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, token_files, warc
from gridfold.llm._common import shared_dir
from gridfold.operators.components import components
from gridfold.llm.queries import tokenizer_path
from tests.llm.cases import SCHEMA, base, frame

ROWS = base()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return lambda text, end: [*tok.encode(text or "", add_special_tokens=False).ids, end]


def words(text):
    return (text or "").encode().split()


def test_packing(docs, empty, reference_ids):
    pieces = packing.pack(docs, tokenizer_path(), capacity=512, windows=8, piece=64).collect()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_doc[p.doc_id].append(p)
    for doc_id, text, *_ in ROWS:
        want = reference_ids(text, 2)
        copies = sum(r[0] == doc_id for r in ROWS)
        own = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert sum(p.length for p in own) == copies * len(want)
        for p in own:
            assert p.doc_tokens == len(want)
            assert np.frombuffer(p.ids, "<u4").tolist() == want[p.start : p.start + p.length]
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 512
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_differencing_beats_the_bound():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 400)
    window, sums = packing.differencing(sizes, 9)
    assert np.array_equal(np.bincount(window, sizes, 9).astype(int), sums)
    assert sums.max() - sums.min() <= 2
    full = packing.divide(np.array([5, 5, 5]), 7)
    assert len(set(full.tolist())) == 3  # two windows would do by their sum only: the count rises


def test_token_files(spark, docs, empty, reference_ids):
    folder = shared_dir(spark, "test-files")
    token_files.write(docs, folder, tokenizer_path(), shards=3)
    got = token_files.read(spark, folder).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for doc_id, text, *_ in order:
        ids = reference_ids(text, 1)
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    folder = shared_dir(spark, "test-files")
    assert token_files.write(empty, folder, tokenizer_path()) == []
    assert token_files.read(spark, folder).count() == 0


@pytest.mark.parametrize("digest", ["sha", "torn"])
def test_exact_dedup(docs, empty, digest):
    from pyspark.sql import functions as F

    kind = {} if digest == "sha" else {"digest": lambda c: F.pmod(F.length(c), F.lit(3)).cast("string")}
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    want = []
    for doc_id, text, *_ in ROWS:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text or "")
        keep = min(groups[body], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((doc_id, keep, len(groups[body]), doc_id == keep, hashlib.sha256(body.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs, **kind).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


def shingles(text):
    w = [x.lower() for x in words(text)]  # bytes.lower() lowers A-Z alone
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def near_by_force(rows, least=85):
    """Rows of one doc_id are one document; a link of any of its texts is its link."""
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if find(i) != find(j) and x and y and 100 * len(x & y) >= least * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(r[0], len(shingles(r[1])), None if r[0] is None else (find(r[0]) if shingles(r[1]) else r[0])) for r in rows]


def test_near_dedup(spark, docs, empty):
    got = near_dedup.near_dedup(docs).collect()
    assert sorted((tuple(r[:3]) for r in got), key=str) == sorted(near_by_force(ROWS), key=str)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_chains_and_stragglers(spark):
    """Copies that drift: the first and last are not similar, neighbours are; buckets need more than one star."""
    base_words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(40):
        w = list(base_words)
        for j in range(k):
            w[5 * j] = f"x{j}"
        rows.append((k, " ".join(w), "en", "s", 0, 1, False, "", 0.0))
    got = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert sorted((tuple(r[:3]) for r in got), key=str) == sorted(near_by_force(rows), key=str)


def test_near_dedup_texts_that_share_a_doc_id(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    texts = [(5, a), (5, b), (7, [*b[:-1], "other"]), (9, [*a, "q"]), (11, ["none", *a[:30]]), (5, b), (5, [])]
    rows = [(k, " ".join(w), "en", "s", 0, 1, False, "", 0.0) for k, w in texts]
    got = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert sorted(tuple(r[:3]) for r in got) == sorted(near_by_force(rows))
    assert {r.doc_id: r.component_id for r in got} == {5: 5, 7: 5, 9: 5, 11: 11}


@pytest.mark.parametrize("block, over", [(256, 8), (8, 0)])
def test_near_dedup_group_of_near_copies(spark, monkeypatch, block, over):
    """Copies about the threshold, a passage that many texts share, texts of one set; in one block and in many."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BEST_OVER", over)
    rng = np.random.default_rng(7)
    body = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(120):
        w = list(body)
        for j in rng.choice(120, rng.integers(0, 5), replace=False):
            w[j] = f"x{k}y{j}"
        rows.append((3 * k, " ".join(w)))
        own = [f"o{k}v{j}" for j in range(int(rng.integers(5, 200)))]
        rows.append((3 * k + 1, " ".join([*body[:40], *own])))
        if k % 3 == 0:
            rows.append((3 * k + 2, "  ".join(w).upper()))
    rows = [(k, text, "en", "s", 0, 1, False, "", 0.0) for k, text in rows]
    for least, more in ((85, {}), (80, {"similarity": 80, "bands": 110})):
        got = near_dedup.near_dedup(frame(spark, rows), **more).collect()
        want = near_by_force(rows, least)
        assert sorted(tuple(r[:3]) for r in got) == sorted(want)
        assert 60 < len({c for _, _, c in want}) < 240


def test_least_agreement_keeps_linked_pairs():
    rng = np.random.default_rng(11)
    least = near_dedup.least_agreement(700, 0.85)
    assert 500 < least < 560
    pool = rng.integers(0, 1 << 63, (200, 230)).astype(np.uint64)
    s = near_dedup.fast_similarity_sketch([x for p in pool for x in (p[:215], p[15:])], 700).astype(np.uint8)
    assert (s[::2] == s[1::2]).sum(axis=1).min() >= least


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:]
    s = near_dedup.fast_similarity_sketch([a, b, pool[:3]], 512)
    assert (s != ~np.uint64(0)).all()
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.07


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (8, 9)], "a long, b long")
    got = dict(map(tuple, components(edges, shared_dir(spark, "test-components")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def repeated_by_force(rows, w):
    seen = collections.Counter()
    for r in rows:
        t = words(r[1])
        seen.update(tuple(t[i : i + w]) for i in range(len(t) - w + 1))
    out = []
    for r in rows:
        t = words(r[1])
        gone = {j for i in range(len(t) - w + 1) if seen[tuple(t[i : i + w])] > 1 for j in range(i, i + w)}
        out.append((r[0], len(t), len(gone), b" ".join(x for j, x in enumerate(t) if j not in gone).decode()))
    return out


@pytest.mark.parametrize(("w", "k", "batches"), [(35, 8, 3), (9, 4, 5)])
def test_substring_dedup(docs, empty, w, k, batches):
    got = substring_dedup.substring_dedup(docs, w=w, k=k, batches=batches).collect()
    assert sorted(map(tuple, got), key=str) == sorted(repeated_by_force(ROWS, w), key=str)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_index_compacts(spark):
    folder = shared_dir(spark, "test-index")
    index = substring_dedup.FingerprintIndex(spark, folder, 2, fanout=1)
    for k in range(5):
        rows = spark.createDataFrame([(k, 1, 1), (100, 2, 1)], "fp long, block long, n long")
        assert sorted(r.fp for r in index.add(rows).distinct().collect()) == ([100] if k else [])
    assert len(index.runs()) <= 3
    kept = [r for name in index.runs() for r in spark.table(name).collect()]
    assert len(kept) < 10 and sum(r.n for r in kept) == 10


def test_quality_rules(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs, least=10).collect()}
    for doc_id, text, *_ in ROWS:
        w = words(text)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[doc_id, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_estimates(spark):
    """Concentration steps against numpy on one group, and an outlier that plain covariance would hide."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        n = int(rng.integers(60, 140))
        junk = k % 5 == 0
        text = " ".join(("$$$$$" if junk and j % 2 else "w" * int(rng.integers(2, 8)) + str(rng.integers(1000))) for j in range(n))
        rows.append((k, text, "en", "s", 0, 1, False, "", 0.0))
    out = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), least=50).collect()}
    assert not any(out[k].kept for k in range(0, 300, 5))
    assert np.mean([out[k].kept for k in range(300) if k % 5]) > 0.99


def test_quality_rules_reject_moderate_outliers(spark):
    """Outliers beyond the quantile 1 - 1e-4 but within 1 - 1e-7 go; the others of their group stay."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        words_ = ["w" * int(rng.integers(4, 8)) + str(rng.integers(100, 1000)) for _ in range(int(rng.integers(60, 140)))]
        # a bar after eight of ten words
        rows.append((k, " ".join(w + "|" * (k % 20 == 0 and j % 10 < 8) for j, w in enumerate(words_)), "en", "s", 0, 1, False, "", 0.0))
    out = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), least=50).collect()}
    lo, hi = (quality_rules.chi2_quantile(1 - q, 5) for q in (1e-4, 1e-7))
    assert all(lo < out[k].distance < hi for k in range(0, 300, 20))
    assert not any(out[k].kept for k in range(0, 300, 20))
    assert np.mean([out[k].kept for k in range(300) if k % 20]) > 0.99


def test_quality_rules_reject_copied_outliers(spark):
    """A third of a group: exact copies of one outlier (source s), near copies of it (source t)."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        source, junk = "st"[k % 2], k % 3 == 0
        n = 100 if junk and source == "s" else int(rng.integers(95, 105) if junk else rng.integers(60, 140))
        text = " ".join("$$$$$" if junk and j % 2 else "w" * (4 if junk else int(rng.integers(2, 8))) + str(j if junk else rng.integers(1000)) for j in range(n))
        rows.append((k, text, "en", source, 0, 1, False, "", 0.0))
    out = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), least=50).collect()}
    assert not any(r.base_failed for r in out.values())
    assert not any(out[k].kept for k in range(0, 600, 3))
    assert np.mean([out[k].kept for k in range(600) if k % 3]) > 0.99


def mcd_by_numpy(x):
    """Location and scatter by the docstring: starts, concentration steps, least determinant, reweighting."""
    q, p = quality_rules, x.shape[1]
    x, floors = np.unique(x, axis=0), np.array(quality_rules.FLOORS)
    share = lambda v, h: np.quantile(v, h, axis=0, method="inverted_cdf")
    correct = lambda h: h / q.chi2_cdf(q.chi2_quantile(h, p), p + 2)
    distance = lambda m, c: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)

    def fit(inner, h):
        c = np.cov(inner.T, bias=True) * correct(h)
        np.fill_diagonal(c, np.maximum(np.diag(c), floors**2))
        return inner.mean(axis=0), c

    centre, scale = share(x, 0.5), np.maximum((share(x, 0.75) - share(x, 0.25)) / 1.349, floors)
    z = (x - centre) / scale
    t, u = np.tanh(z), z / np.linalg.norm(z, axis=1, keepdims=True)
    sign = u.T @ u / len(u)
    fits = []
    for r in (np.eye(p), np.corrcoef(t.T), sign / np.sqrt(np.outer(np.diag(sign), np.diag(sign)))):
        m, c = centre, r * np.outer(scale, scale)
        for _ in range(q.START_STEPS):
            d = distance(m, c)
            m, c = fit(x[d <= share(d, q.H)], q.H)
        fits.append((np.linalg.slogdet(c)[1], m, c))
    before, m, c = min(fits, key=lambda f: f[0])
    for _ in range(q.START_STEPS, q.STEPS):  # the last step's estimates stay, still or not
        d = distance(m, c)
        m, c = fit(x[d <= share(d, q.H)], q.H)
        after = np.linalg.slogdet(c)[1]
        if abs(after - before) < q.STILL:
            break
        before = after
    return fit(x[distance(m, c) <= q.chi2_quantile(q.WITHIN, p)], q.WITHIN)


@pytest.mark.parametrize("few", [quality_rules.FEW, 0])
def test_quality_rules_distances_by_numpy(spark, few):
    """Every distance, verdict and level, where one source has enough rows and the other is judged by its language; by broadcast and by salted joins."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        long = int(rng.integers(2, 9))
        text = "\n".join(" ".join("".join(rng.choice(list("abcdE#"), int(rng.integers(1, 2 + long)))) for _ in range(int(rng.integers(3, 12)))) for _ in range(int(rng.integers(3, 12))))
        rows.append((k, text, "en", "s" if k % 4 else "t", 0, 1, False, "", 0.0))
    table = frame(spark, rows)
    got = {r.doc_id: r for r in quality_rules.quality_rules(table, least=150, few=few).collect()}
    stats = {r.doc_id: r for r in quality_rules._vector(quality_rules.counts(table)).collect() if not r.base_failed}
    vector = lambda r: [r[c] for c in quality_rules.VECTOR]
    all_ = np.array([vector(r) for r in stats.values()])
    own = np.array([vector(r) for k, r in stats.items() if k % 4])
    assert len(own) >= 150 and len(all_) - len(own) < 150
    fits = {2: mcd_by_numpy(own), 1: mcd_by_numpy(all_)}
    for k, r in stats.items():
        level = 2 if k % 4 else 1
        m, c = fits[level]
        d = np.array(vector(r)) - m
        want = d @ np.linalg.solve(c, d)
        assert got[k].level == level
        assert abs(got[k].distance - want) < 1e-6 * max(1, want)
        assert got[k].kept == (want <= quality_rules.chi2_quantile(quality_rules.CUT, 5))


def test_chi2():
    assert abs(quality_rules.chi2_quantile(0.75, 5) - 6.6257) < 1e-3
    assert abs(quality_rules.chi2_cdf(11.0705, 5) - 0.95) < 1e-5


def test_warc(spark, tmp_path):
    page = "<html>" + "long enough to be revisited " * 9 + "</html>"
    rows = [(k, f"http://h/{k}", page if k % 3 == 0 else f"<p>own {k} \r\n\r\n é", 1, "x") for k in range(1, 40)]
    rows += [(100, None, None, 1, None), (101, "u\r\nX: 1", "", 1, None), (102, "u", "short", 1, None), (103, "u", "short", 1, None), (104, "u", "x" * 900_000, 1, None), rows[2], rows[0], (None, "n", page, 1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int, first string").repartition(3)
    bundles = warc.write(pages, shared_dir(spark, "test-warc"), frame=2000)
    got = warc.read(spark, bundles).collect()
    first = {}
    for r in rows:
        if r[0] is not None and len((r[2] or "").encode()) >= 100:
            first[r[2]] = min(first.get(r[2], 1 << 60), r[0])
    want = []
    for r in rows:
        data = (r[2] or "").encode()
        f = first.get(r[2])
        again = f is not None and f != r[0]
        want.append((r[0], len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    assert sorted(((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got), key=str) == sorted(want, key=str)
    one = next(g for g in got if g.record_type == "response" and g.page_id == 4)
    reader = warc.BundleReader(one.bundle)
    one_bundle = next(b for b in bundles.collect() if b.bundle == one.bundle)
    headers, block = reader.record(4)
    assert headers["X-Page-ID"] == "4" and block.endswith("<p>own 4 \r\n\r\n é".encode())
    assert len(reader) > 1
    # any Zstandard reader passes over the map and the seek table
    import io

    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(one.bundle.removeprefix("file:"), "rb").read()), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == one_bundle.records >= len(reader.map)
    assert warc.read(spark, warc.write(pages.limit(0), shared_dir(spark, "test-warc"))).count() == 0


def test_mixing(docs, empty):
    from pyspark.sql import functions as F

    taken, sources = mixing.mix(docs, F.array("source"))
    got = taken.collect()
    assert len(got) == len(ROWS)
    for name, (size, target) in sources.items():
        own = [r for r in got if r.sources[0] == name]
        assert sum(r.size for r in own) == size
        assert abs(sum(r.taken for r in own) - target) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert abs(sum(t for _, t in sources.values()) - sum(r.size for r in got)) < 1e-6
    again = mixing.mix(docs.repartition(5), F.array("source"))[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    none, _ = mixing.mix(empty, F.array("source"))
    assert none.count() == 0


def test_mixing_overlapping_sources(docs):
    """A pattern's tokens reach whichever of its sources lacks them, at the least repetition."""
    from pyspark.sql import functions as F

    members = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(F.lit("a"), F.lit("b"))).when(F.pmod("doc_id", F.lit(3)) == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    taken, _ = mixing.mix(docs, members, weight_of=lambda names: [1.0] * len(names))
    rows = taken.collect()
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)
    assert mixing.route([(frozenset({0, 1}), 10), (frozenset({0}), 10)], [10, 10]) == [10, 10]
    assert mixing.route([(frozenset({0}), 10)], [25]) == [25]
    assert mixing.route([(frozenset({0}), 10)], [99]) == [30]
    assert mixing.share_targets([10, 100, 100], [5, 2, 1], 210) == [30, 120, 60]


def test_context_trees_against_sequential_weighting():
    """The closed form against the textbook recursion that codes bit by bit."""
    text = b"abracadabra abracadabra"
    depth = 2
    keys = []
    padded = bytes(depth) + text + b"\0"
    for i in range(depth, len(padded)):
        keys.append(padded[i] | padded[i - 1] << 8 | padded[i - 2] << 16)
    distinct, counts = np.unique(np.array(keys), return_counts=True)
    levels, above = ctw.subtree(distinct, counts, depth, 2)
    top = ctw.top_levels(*above)
    logs = ctw.gram_logs(top.below(*levels[2], 1), distinct)

    nodes = collections.defaultdict(lambda: [0, 0, 0.0, 0.0])  # zeros, ones, ln own, ln weighted

    def path(context, prefix):
        return [(context[len(context) - d :], prefix) for d in range(depth + 1)]

    def update(context, prefix, bit):
        for d, node in reversed(list(enumerate(path(context, prefix)))):
            n = nodes[node]
            n[2] += math.log((n[bit] + 0.5) / (n[0] + n[1] + 1))
            n[bit] += 1
            if d == depth:
                n[3] = n[2]
            else:
                below = sum(v[3] for (c, p), v in nodes.items() if p == prefix and len(c) == d + 1 and c[1:] == node[0])
                n[3] = np.logaddexp(n[2], below) - math.log(2)

    bits = lambda byte: [(byte >> (7 - k)) & 1 for k in range(8)]
    for i in range(depth, len(padded)):
        prefix = 1
        for bit in bits(padded[i]):
            update(padded[i - depth : i], prefix, bit)
            prefix = prefix << 1 | bit
    for key, got in zip(distinct.tolist(), logs, strict=True):
        context, byte = bytes([key >> 16 & 255, key >> 8 & 255]), key & 255
        total, prefix = 0.0, 1
        for bit in bits(byte):
            before = nodes[(b"", prefix)][3]
            saved = {k: list(v) for k, v in nodes.items()}
            update(context, prefix, bit)
            total += nodes[(b"", prefix)][3] - before
            nodes.clear()
            nodes.update(saved)
            prefix = prefix << 1 | bit
        assert abs(total / math.log(10) - got) < 1e-9


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 100.5, 1e6])
    assert np.allclose(ctw.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_lm_scoring_in_pieces_and_by_join(spark):
    """Small slices and chunks, and a joined model, score as one slice and a loaded model do."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 9)))
    texts = [" ".join(word() for _ in range(int(rng.integers(0, 300)))) for _ in range(60)] + ["x" * 5000, " ".join(word() for _ in range(4000)), None, ""]
    table = frame(spark, [(k, t, "en", "s", 0, 1, False, "", 0.0) for k, t in enumerate(texts)])
    want = {r.doc_id: r for r in ctw.score(table).collect()}
    for more in ({"held": 500, "most": 700}, {"mapped": 0, "held": 2000, "most": 3000}):
        got = ctw.score(table, **more).collect()
        assert len(got) == len(texts)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.n_bytes) == (w.held_out, w.n_tokens, w.n_known, w.train_tokens, w.n_bytes)
            assert r.n_bytes == len((texts[r.doc_id] or "").encode())
            assert abs(r.score - w.score) < 1e-3 and abs(r.base_score - w.base_score) < 1e-6 and abs(r.bits_per_byte - w.bits_per_byte) < 1e-3


def test_lm_places_keep_every_bit():
    keys = np.random.default_rng(1).integers(0, 1 << 48, 1000)
    assert (ctw.unplaced(ctw.placed(keys, 5), 5) == keys).all()
    assert (ctw.placed(keys, 5) >> 32 == keys >> 8 & 0xFFFF).all() and (ctw.placed(keys, 5) >> 24 & 255 == keys >> 24 & 255).all()


def test_lm_scoring(docs, empty):
    got = ctw.score(docs).collect()
    held = lambda r: zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2
    low = lambda text: [x.lower() for x in words(text)]
    counts = collections.Counter()
    for r in ROWS:
        if not held(r):
            counts.update([*low(r[1]), None])
    total, v = sum(counts.values()), len(counts)
    want = {}
    for r in ROWS:
        tokens = [*low(r[1]), None]
        base_score = sum(math.log10((counts[t] + 1) / (total + v + 1)) for t in tokens)
        want.setdefault((r[0], len(tokens)), (held(r), sum(counts[t] > 0 for t in tokens), total, base_score))
    assert len(got) == len(ROWS)
    for g in got:
        h, known, n, base_score = want[g.doc_id, g.n_tokens]
        assert (g.held_out, g.n_known, g.train_tokens) == (h, known, n)
        assert abs(g.base_score - base_score) < 1e-6
        assert g.score < 0
    assert ctw.score(empty).count() == 0


def test_lm_probabilities_add_up():
    """After any context the next byte's probabilities add up to one."""
    import pyarrow as pa

    keys, _ = ctw.grams(pa.array(["abab", "Abba", None]), 2)
    counts = np.ones(len(keys), np.int64)
    keys, counts = ctw._tally(keys, counts)
    every = np.concatenate([keys, (keys[0] & ~255) | np.arange(256)])
    n = np.concatenate([counts, np.zeros(256, np.int64)])
    every, n = ctw._tally(every, n)
    levels, above = ctw.subtree(every, n, 2, 2)
    logs = ctw.gram_logs(ctw.top_levels(*above).below(*levels[2], 1), every)
    own = (every >> 8) == keys[0] >> 8
    assert own.sum() == 256 and abs((10 ** logs[own]).sum() - 1) < 1e-9


def test_classifier(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(400):
        junk = k % 4 == 0
        text = " ".join(("w%d" % rng.integers(500)) + ("$$$" if junk and rng.random() < 0.7 else "") for _ in range(int(rng.integers(20, 60))))
        rows.append((k, text, "en", "s", 0, 1, False, "", 0.0))
        labels.append((k, 0 if junk else 1, 9))
    table, marks = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, n int")
    model = quality_classifier.train(table, marks)
    assert 0 < len(model.rules) < 60
    out = quality_classifier.classify(table, model).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.held_out for r in out) == len(held)
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in held]) > 0.95
    x = np.array([[r[c] for c in quality_classifier.NAMES] for r in quality_classifier.features(table).collect()])
    ids = [r.doc_id for r in quality_classifier.features(table).collect()]
    by_numpy = dict(zip(ids, model.predict(x), strict=True))
    assert all(abs(by_numpy[r.doc_id] - r.score) < 1e-9 for r in out)
    odd = quality_classifier.classify(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert quality_classifier.classify(empty, quality_classifier.train(table, marks.limit(0))).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in ROWS if r[0] is not None][:-2]
    stages = dict(corpus_pipeline.STAGES)
    table = frame(spark, rows)
    left = stages["quality rules"](spark, table, "")
    assert left.columns == table.columns
    kept = left.collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in quality_rules.quality_rules(table).collect() if r.kept}
    exact = stages["exact dedup"](spark, table, "").collect()
    bodies = [re.sub(r"\s", "", r.text or "") for r in exact]
    assert len(set(bodies)) == len(bodies) == len({re.sub(r"\s", "", r[1] or "") for r in rows})
    near = stages["near dedup"](spark, table, "").collect()
    assert {r.doc_id for r in near} == {c for _, _, c in near_by_force(rows)}
    mixed = stages["mixing"](spark, table, "")
    assert mixed.columns == table.columns and mixed.count() > 0
    (tmp_path / "sf").mkdir()
    table.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    assert packed and json.dumps([r.doc_id for r in packed])
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_near_stage_takes_pairs_from_80(spark):
    """Pairs at 79 to 86 hundredths, against brute force at 80."""
    import corpus_pipeline

    rows = []
    for k in range(30):
        w = [f"d{k}w{j}" for j in range(100 + k)]
        rows += [(2 * k, " ".join(w), "en", "s", 0, 1, False, "", 0.0), (2 * k + 1, " ".join(w[: len(w) - 8 - k % 15] + [f"x{k}"] * 3), "en", "s", 0, 1, False, "", 0.0)]
    want = {c for _, _, c in near_by_force(rows, 80)}
    assert len(want) < len({c for _, _, c in near_by_force(rows, 85)}) and len(want) > 30
    near = corpus_pipeline.near_stage(spark, frame(spark, rows), "").collect()
    assert {r.doc_id for r in near} == want


def test_pipeline_stages_decide_on_rows(spark):
    """Rows that share a doc_id or have none follow the verdict of their own text."""
    import corpus_pipeline

    texts = [(5, "one text"), (5, "one  text"), (6, "one text"), (5, "another text"), (4, "third"), (5, "third"), (7, None), (None, "no id"), (None, "no id"), (None, "one text")]
    rows = [(k, text, "en", "s", 0, 1, False, "", 0.0) for k, text in texts]
    left = corpus_pipeline.exact_stage(spark, frame(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(5, "one  text"), (5, "another text"), (4, "third"), (7, None), (None, "no id")], key=str)
    long = [f"w{k}" for k in range(80)]
    texts = [(5, "alone"), (5, " ".join(long)), (None, " ".join([*long, "x"])), (None, "none"), (3, " ".join([*long, "y"])), (5, "alone")]
    rows = [(k, text, "en", "s", 0, 1, False, "", 0.0) for k, text in texts]
    left = corpus_pipeline.near_stage(spark, frame(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(5, "alone"), (None, "none"), (3, texts[4][1])], key=str)


def test_pipeline_columns_with_clashing_names(spark):
    import corpus_pipeline

    names = ("copies", "copy", "row", "kept", "size", "taken", "key", "component_id")
    table = spark.createDataFrame([(k, f"w{k} " * 30, "en", "s", *range(8)) for k in range(20)] + [(3, "again " * 20, "en", "s", *range(8))], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "")
        assert out.columns == table.columns
        assert all(tuple(r)[4:] == tuple(range(8)) for r in out.collect())


def test_pipeline_mixing_stage_against_brute_force(spark, docs):
    """Copies of every row from quotas, the seeded order and rounding, worked out row by row."""
    import corpus_pipeline

    rows = [r for r in ROWS if r[0] is not None][:-2]
    size = {r[0]: len(words(r[1])) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[r[0]] for r in rows if r[3] == s) for s in names]
    targets = mixing.share_targets(sizes, [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))], sum(sizes))
    want = collections.Counter()
    for name, total, target in zip(names, sizes, targets, strict=True):
        whole, rest = divmod(round(target), total)
        for k in sorted((r[0] for r in rows if r[3] == name), key=lambda k: hashlib.md5(f"17:{k}".encode()).hexdigest()):
            part = min(size[k], rest)
            rest -= part
            if size[k]:
                want[k] = math.floor((whole * size[k] + part) / size[k] + 0.5)
    got = collections.Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, frame(spark, rows), "").collect())
    assert got == +want and sum(got.values()) > 20


def test_pipeline_packing_stage_against_brute_force(spark, reference_ids):
    """Each copy's ids lie in exactly one piece; sequences are gapless, within capacity and few."""
    import corpus_pipeline

    rows = [r for r in ROWS if r[0] is not None][:-2]
    rows += rows[3:9]
    pieces = corpus_pipeline.packing_stage(spark, frame(spark, rows), "").collect()
    ids = {r[0]: reference_ids(r[1], 2) for r in rows}
    want, got = collections.Counter(), collections.Counter()
    for r in rows:
        want.update((r[0], k) for k in range(len(ids[r[0]])))
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        got.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
    assert got == want
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096
    assert len(sequences) <= sum(want.values()) / 4096 + 4


def test_mixing_reruns_agree_on_rows_that_share_a_doc_id(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [(k // 5 if k % 4 else None, " ".join(f"w{k}" for _ in range(int(rng.integers(1, 40)))), "en", "ab"[k % 3 > 0], 0, 1, False, "", 0.0) for k in range(80)]
    one = mixing.mix(frame(spark, rows), F.array("source"))[0].collect()
    for n in (1, 7):
        again = mixing.mix(frame(spark, rows[::-1]).repartition(n), F.array("source"))[0].collect()
        assert sorted(map(str, again)) == sorted(map(str, one))


def test_mixing_shared_out_agrees_with_one_search():
    rng = np.random.default_rng(6)
    for _ in range(30):
        sets = list({frozenset(int(s) for s in rng.choice(6, int(rng.integers(1, 3)), replace=False)) for _ in range(6)})
        patterns = [(p, int(rng.integers(1, 50))) for p in sets]
        quotas = [int(rng.integers(0, 80)) for _ in range(6)]
        cost = lambda taken: sum(sum(min(size, max(0, t - c * size)) * (c * (c + 1) // 2) for c in range(3)) for (_, size), t in zip(patterns, taken, strict=True))  # noqa: B023, E731
        one, other = mixing.route(patterns, quotas), mixing.shared_out(patterns, quotas)
        assert sum(one) == sum(other) and cost(one) == cost(other)


def test_token_files_keep_null_ids(spark):
    folder = shared_dir(spark, "test-null-ids")
    rows = [(None, "a", "en", "s", 0, 1, False, "", 0.0), (-1, "b", "en", "s", 0, 1, False, "", 0.0), (2, None, "en", "s", 0, 1, False, "", 0.0)]
    token_files.write(frame(spark, rows), folder, tokenizer_path())
    assert sorted((str(r.doc_id) for r in token_files.read(spark, folder).collect())) == ["-1", "2", "None"]


def test_tokens_of_another_file_are_encoded_whole(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from gridfold.llm.tokens import TextEncoder

    spec = json.loads(open(tokenizer_path()).read())
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    texts = ["Some Words, here", "", "ÉTÉ  and 12"]
    ids, ends = TextEncoder(str(tmp_path / "other.json")).encode(pa.array(texts), 9)
    tok = Tokenizer.from_file(str(tmp_path / "other.json"))
    want = [[*tok.encode(t, add_special_tokens=False).ids, 9] for t in texts]
    assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert TextEncoder(tokenizer_path()).by_words


def test_warc_bundles_roll(spark):
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k}</p>" * 50) for k in (9, 3, 7, 1, 5, None)], "page_id long, url string, html string").coalesce(1)
    bundles = warc.write(pages, shared_dir(spark, "test-warc"), frame=600, most=1500)
    files = bundles.collect()
    assert len(files) > 2 and sum(r.records for r in files) == 6
    assert {r.page_id for r in warc.read(spark, bundles).collect()} == {1, 3, 5, 7, 9, None}
    found = 0
    for r in files:
        reader = warc.BundleReader(r.bundle)
        assert (np.diff(reader.map["record"]) > 0).all()
        for k in reader.map["record"].tolist():
            assert reader.record(k)[0]["X-Page-ID"] == str(k)
            found += 1
        with pytest.raises(KeyError):
            reader.record(100)
    assert found == 5


def test_classifier_features_by_brute_force(spark):
    """Every statistic from its definition, and a bounded training sample where labelled documents repeat."""
    texts = ["", None, "One two two.\nOne two two.\n\n", "A|b! 12 {x} é É", "word " * 50, "x,y;z:  \n end?"]
    rows = [(k, t, "en", "s", 0, 1, False, "", 0.0) for k, t in enumerate(texts)]
    count = lambda pattern, t: len(re.findall(pattern, t))
    for r in quality_classifier.features(frame(spark, rows)).collect():
        t = texts[r.doc_id] or ""
        w, lines, chars = words(t), t.split("\n"), max(len(t), 1)
        n, d = max(len(w), 1), len(set(w))
        want = (math.log1p(len(t)), math.log1p(len(w)), len(t) / n, d / n, math.log1p(d) / math.log1p(n), math.log1p(n / len(lines)), len(set(lines)) / len(lines), count(r"[#*$%&<>{}=_^~\\]", t) / chars, count(r"\|", t) / chars, count("!", t) / chars, sum(x.isupper() for x in t) / chars, count("[0-9]", t) / chars, count("[.!?]", t) / chars, count("[,;:]", t) / chars)
        assert np.allclose([r[c] for c in quality_classifier.NAMES], want, atol=1e-12), (r, want)
    many = frame(spark, [(k % 30, f"w{k} " * (5 + k % 7) + "$" * (k % 2), "en", "s", 0, 1, False, "", 0.0) for k in range(300)])
    marks = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    assert quality_classifier.train(many, marks) == quality_classifier.train(many.repartition(5), marks)


def test_substring_dedup_periodic_texts(spark):
    """Equal windows have equal anchors also where words repeat with a period: random periodic texts, against all windows."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(24):
        period = [f"p{int(rng.integers(3))}" for _ in range(int(rng.integers(1, 9)))]
        head = [f"h{int(rng.integers(40))}" for _ in range(int(rng.integers(0, 30)))]
        tail = [f"t{int(rng.integers(40))}" for _ in range(int(rng.integers(0, 30)))]
        rows.append((k, " ".join([*head, *(period * 30)[: int(rng.integers(20, 80))], *tail]), "en", "s", 0, 1, False, "", 0.0))
    runs = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("fp_")}
    before = runs()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    windows = collections.Counter()
    split = {r[0]: r[1].split() for r in rows}
    for w in split.values():
        windows.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for k, w in split.items():
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert got[k] == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert any(n for _, n, _ in got.values())
    assert runs() == before


def _cheapest(patterns, quotas, copies=3):
    """Most tokens at the least cost by Bellman-Ford paths, unit by unit of residual network: tokens, cost."""
    n, m = len(patterns), len(quotas)
    arcs = []  # from, to, room, cost; an arc and its reverse are neighbours

    def arc(a, b, room, cost):
        arcs.extend([[a, b, room, cost], [b, a, 0, -cost]])

    for k, (sources, size) in enumerate(patterns):
        for c in range(copies):
            arc(0, 1 + k, size, c * (c + 1) // 2)
        for s in sources:
            arc(1 + k, 1 + n + s, copies * size, 0)
    for s, q in enumerate(quotas):
        arc(1 + n + s, 1 + n + m, q, 0)
    total = cost = 0
    while True:
        best, via = {0: 0}, {}
        for _ in range(n + m + 2):
            for e, (a, b, room, c) in enumerate(arcs):
                if room and a in best and best[a] + c < best.get(b, 1 << 40):
                    best[b], via[b] = best[a] + c, e
        if 1 + n + m not in best:
            return total, cost
        path, x = [], 1 + n + m
        while x:
            path.append(via[x])
            x = arcs[via[x]][0]
        push = min(arcs[e][2] for e in path)
        for e in path:
            arcs[e][2] -= push
            arcs[e ^ 1][2] += push
        total, cost = total + push, cost + push * best[1 + n + m]


def test_mixing_route_against_bellman_ford():
    rng = np.random.default_rng(15)
    for _ in range(60):
        m = int(rng.integers(1, 5))
        patterns = [(frozenset(int(s) for s in rng.choice(m, int(rng.integers(1, m + 1)), replace=False)), int(rng.integers(0, 15))) for _ in range(int(rng.integers(1, 8)))]
        quotas = [int(q) for q in rng.integers(0, 50, m)]
        taken = mixing.route(patterns, quotas)
        cost = sum(sum(min(size, max(0, t - c * size)) * (c * (c + 1) // 2) for c in range(3)) for (_, size), t in zip(patterns, taken, strict=True))
        assert all(0 <= t <= 3 * size for (_, size), t in zip(patterns, taken, strict=True))
        assert (sum(taken), cost) == _cheapest(patterns, quotas)


def test_mixing_routes_many_connected_patterns():
    """More than 100,000 patterns in one connected group: quotas are met exactly."""
    rng = np.random.default_rng(16)
    sets = [frozenset(int(s) for s in rng.integers(0, 30, int(k))) for k in rng.integers(1, 5, 120_000)]
    patterns = [(s, int(n)) for s, n in zip(sets, rng.integers(1, 500, len(sets)), strict=True)]
    total = sum(n for _, n in patterns)
    quotas = [total * (5, 2, 1)[k % 3] // 80 for k in range(30)]
    taken = mixing.route(patterns, quotas)
    assert sum(taken) == sum(quotas) and all(0 <= t <= 3 * n for (_, n), t in zip(patterns, taken, strict=True))
