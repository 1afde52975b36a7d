import base64
import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import ngram_join as join
from wattline.llm import vptree, warc
from wattline.llm._common import work_folder

from .frames import AWKWARD, documents


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, AWKWARD).repartition(3)


# N-gram Jaccard join


def variants(seed=0, families=12, size=14):
    """Texts in families of edited copies, from one word to hundreds, with exact copies."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for f in range(families):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(1, 260)))]
        for _ in range(size):
            copy = list(words)
            for _ in range(int(rng.integers(0, 1 + len(copy) // 12))):
                copy[int(rng.integers(len(copy)))] = f"e{rng.integers(1000)}"
            rows.append((n, " ".join(copy)))
            n += 1
    return rows + [(n + i, rows[i * 3 % n][1]) for i in range(20)]


def brute(rows, num=75, den=100):
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    def shingles(text):
        w = [x for x in (text or "").encode().lower().split()]
        return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def linked_to(rows, num=75, den=100):
    """Id -> number of other documents whose shingles reach the threshold."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    reached = lambda a, b: a & b and den * len(a & b) >= num * len(a | b)
    return {i: sum(1 for j, b in sets.items() if j != i and reached(a, b)) for i, a in sets.items()}


@pytest.mark.parametrize(("num", "den", "block"), [(75, 100, 4), (50, 100, 1024)])
def test_components_and_links_equal_brute_force(spark, num, den, block):
    rows = variants()
    found = join.similar_components(spark, documents(spark, rows).repartition(3), num, den, block=block).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == brute(rows, num, den)
    expected = linked_to(rows, num, den)
    assert {r[0]: r[3] for r in found} == expected and max(expected.values()) > 12


def test_awkward_documents(spark, awkward):
    found = [tuple(r) for r in join.similar_components(spark, awkward).collect()]
    by = {r[0]: r for r in found}
    named = {i: t for i, t in AWKWARD if i is not None}
    expected = brute(list(named.items()))
    assert {i: (r[1], r[2]) for i, r in by.items() if i is not None} == expected
    assert len(found) == len(named) + 1 and by[None][2] is None and by[None][3] is None
    assert {i: r[3] for i, r in by.items() if i is not None} == linked_to(list(named.items()))
    assert by[6][2] == 5 and by[1][1] == 0 and by[1][2] == 1 and by[4][1] == 1
    assert join.similar_components(spark, awkward.where("false")).count() == 0


def near(words, at):
    return " ".join([*words[:at], "other", *words[at + 1 :]])


def counting(rows):
    """Of several texts under one id the one whose set has the smallest digest."""
    best = {}
    for i, text in rows:
        digest = join.set_digest(join.shingle_set(text or ""))
        if i not in best or digest < best[i][0]:
            best[i] = (digest, text)
    return [(i, text) for i, (_, text) in best.items()]


@pytest.mark.parametrize(("turned", "parts"), [(False, 1), (True, 4)])
def test_several_texts_under_one_id(spark, turned, parts):
    first, second, third = ([f"{x}{i}" for i in range(40)] for x in "abc")
    texts = [" ".join(first), " ".join(second)][:: -1 if turned else 1]
    rows = [(1, texts[0]), (1, texts[1]), (2, near(first, 3)), (3, near(second, 20)), (4, " ".join(third)), (5, " ".join(third)), (5, near(third, 1)), (6, near(third, 39)), (7, texts[0]), (7, texts[1]), (9, texts[1])]
    found = join.similar_components(spark, documents(spark, rows).repartition(parts)).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == brute(counting(rows)) and len(found) == 8
    assert {r[0]: r[3] for r in found} == linked_to(counting(rows))


def test_crowds_around_a_common_passage(spark):
    """Sets that share a passage, in one group each segment of it, are regrouped by rare tokens."""
    rng, rows = np.random.default_rng(8), []
    passage = [f"p{i}" for i in range(30)]
    for f in range(40):
        own = [f"w{f}x{i}" for i in range(int(rng.integers(4, 60)))]
        for _ in range(3):
            copy = list(own)
            copy[int(rng.integers(len(copy)))] = f"e{rng.integers(30)}"
            rows.append((len(rows), " ".join([*copy, *passage])))
    rows.append((len(rows), " ".join(passage)))
    found = join.similar_components(spark, documents(spark, rows).repartition(3), block=8, hot=3).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == brute(rows)
    assert {r[0]: r[3] for r in found} == linked_to(rows)
    assert len({r[2] for r in found}) > 20


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(4)
    for num in (75, 50):
        scheme = join.Scheme(join.Threshold(num, 100))
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop, add = rng.integers(0, 1 + len(a) // 3, 2)
            b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - drop], rng.integers(0, 2**63, add).astype(np.uint64)]))
            if len(b) and scheme.threshold.linked(a, b):
                assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size


def test_double_segments_are_allocated_where_they_pay():
    picked = {n: join.Scheme(join.Threshold(n, 100)).partition(6, 64, 127, False) for n in (90, 75, 50)}
    assert picked[75].doubles > 0 and all(p.segments + p.doubles >= p.needed(127) for p in picked.values())


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 500, int(rng.integers(1, 300))).astype(np.uint64)) for _ in range(2))
        ma, mb = join.parity_bitmap(a), join.parity_bitmap(b)
        size = min(len(ma), len(mb))
        assert int(np.bitwise_count(join.folded(ma, size) ^ join.folded(mb, size)).sum()) <= len(np.setxor1d(a, b))


def test_components_of_paths_and_cycles(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(500, int(x)) for x in rng.integers(501, 600, 80)]
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in rng.permutation(edges)], "a long, b long")
    found = {r["doc_id"]: r["comp"] for r in join.components(spark, frame, work_folder(spark, "cc")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[100 + i] == 100 for i in range(9))
    assert {v for k, v in found.items() if k >= 500} == {500}


def test_stage_keeps_one_of_each_group(spark, awkward):
    rows = variants(3, 4, 6)
    docs = documents(spark, rows)
    kept = join.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in brute(rows).values()}
    left = join.near_duplicate_stage(spark, awkward, "").select("doc_id").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in left) == sorted((i is None, i or 0) for i in ({i for i, _ in AWKWARD} - {6}))


def test_stage_with_several_texts_under_one_id(spark):
    a, b = ([f"{x}{i}" for i in range(40)] for x in "ab")
    rows = [(2, near(a, 3)), (1, " ".join(a)), (1, " ".join(b)), (1, " ".join(a)), (3, near(b, 20)), (None, " ".join(a)), (None, "alone with no id but with words"), (4, "")]
    docs = documents(spark, rows).withColumnRenamed("first", "__place").withColumnRenamed("kept", "component_id")
    kept = join.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, " ".join(a)), (1, " ".join(b)), (None, rows[6][1]), (4, "")], key=repr)
    assert join.near_duplicate_stage(spark, docs.where("false"), "").count() == 0


def test_work_tables_have_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, a work table is not cut into as many files."""
    files, written, rows = {}, join.saved, variants(3, 12, 6)

    def counted(session, frame, path):
        table = written(session, frame, path)
        files[path.rsplit("/", 1)[1]] = len(table.inputFiles())
        return table

    monkeypatch.setattr(join, "saved", counted)
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = join.similar_components(spark, documents(spark, rows).repartition(20, "doc_id")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {"grouped1", "named", "members", "pairs1", "links1", "edges0", "classes"} <= set(files)
    assert max(files.values()) <= 8, files  # two per core, or a quarter of the shuffle's partitions
    assert {r[0]: (r[1], r[2]) for r in found} == brute(rows)


# Vantage-point trees


def vectors(spark, n=700, dims=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    data = (centres[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32)
    data[50:120] = data[50]  # a large group of equal vectors
    data[-9] = data[-70]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(data)]
    odd = [(1000, None, 1), (1001, [0.0] * dims, 1), (1002, [float("nan")] * dims, 1), (1003, [1.0, None] + [0.0] * (dims - 2), 1), (1004, [float("inf")] * dims, 1), (None, [1.0] * dims, 1), (1100, [], 1), (1200, [1.0, 2.0], 1), (1300, [1.0, 3.0], 1)]
    return spark.createDataFrame(rows + odd + [rows[7]], "vec_id long, embedding array<float>, rank int"), data.astype(float)


def exact(data, q, k):
    away = np.sqrt(((data - data[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((np.arange(len(data)), away)) if i != q]
    return [(int(i), away[i]) for i in order[:k]]


def test_factor_one_is_exact(spark):
    frame, data = vectors(spark)
    found = defaultdict(list)
    for r in vptree.nearest(spark, frame, factor=1.0, least_rows=200, every=50).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {*range(0, 700, 50), 1200, 1300}
    for q in range(0, 700, 50):
        expected = exact(data, q, 10)
        assert [i for i, _ in found[q]] == [i for i, _ in expected]
        assert np.allclose([s for _, s in found[q]], [s for _, s in expected], rtol=0, atol=1e-12)
    assert found[1200] == [(1300, 1.0)]


def test_recall_of_the_default_factor(spark):
    frame, data = vectors(spark, 1500, 24, 3)
    found = defaultdict(set)
    for r in vptree.nearest(spark, frame, least_rows=400, every=25).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = [len(found[q] & {i for i, _ in exact(data, q, 10)}) / 10 for q in range(0, 1500, 25)]
    assert np.mean(hits) >= 0.9


def test_larger_factors_look_at_less():
    rng = np.random.default_rng(9)
    data = rng.normal(size=(3000, 4))
    tree = vptree.VpTree.load(vptree.VpTree.build(data, np.arange(3000), 5).dump())
    looked = {}
    for factor in (1.0, 3.0):
        seen = [0]
        original = tree._leaf
        tree._leaf = lambda q, own, k, best, ids, who, a, b: (seen.__setitem__(0, seen[0] + len(who) * (b - a)), original(q, own, k, best, ids, who, a, b))[1]
        tree.search(data[:50], np.arange(50), 5, factor)
        tree._leaf, looked[factor] = original, seen[0]
    assert looked[3.0] < looked[1.0] < 50 * 3000


def test_no_vectors(spark):
    frame, _ = vectors(spark, 150)
    assert vptree.nearest(spark, frame.where("false")).count() == 0
    assert vptree.nearest(spark, frame.where("vec_id = 100")).count() == 0


# WARC

PAGES = [
    (1, "http://a.example.org/x", "same"), (2, "http://b.example.org/", "same"), (3, None, None), (4, "http://a.example.org/x", ""), (5, "https://A.example.org:80/x?q=1#f", "é" * 5000),
    (6, "bad url with spaces\r\nX: y", "same"), (-7, "http://z.org", "only"), (None, "http://n.org/", "nobody"), (None, "http://n.org/", "same"), (8, "http://n.org/", "only"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, record_type string, offset long").repartition(3)


def archive(spark, rows=PAGES, **options):
    folder = work_folder(spark, "warctest")
    captures = warc.write_archives(spark, pages(spark, rows), folder, **options)
    return folder, captures, warc.write_index(spark, captures, folder, block_lines=2)


def test_round_trip(spark):
    folder, captures, parts = archive(spark)
    places = warc.lookup(spark, captures.select("url_key", "page_id"), parts, folder, whole_key=True).distinct()
    found = sorted((tuple(r) for r in warc.read_records(spark, places, folder).collect()), key=repr)
    whole = {r["page_id"]: r["payload"] for r in warc.read_records(spark, places, folder, payloads=True).where("record_type = 'response'").collect()}
    assert whole[5] == ("é" * 5000).encode() and whole[-7] == b"only"
    firsts = {}
    for i, _, h in PAGES:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    expected = []
    for i, _, h in PAGES:
        data, first = (h or "").encode(), firsts.get(h or "")
        again = first is not None and first != i
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert found == sorted(expected, key=repr)


def test_small_payloads_never_revisit(spark):
    folder, captures, _ = archive(spark, least_bytes=5)
    assert captures.where("record_type = 'revisit'").count() == 0
    _, captures, _ = archive(spark, least_bytes=4, archive_bytes=100)
    assert {r["page_id"] for r in captures.where("record_type = 'revisit'").collect()} == {2, 6, None, 8}


def test_lookup_of_one_url_reads_its_blocks_only(spark):
    rows = [(i, f"http://h{i % 40}.example.org/p{i % 7}", f"text {i}") for i in range(300)]
    folder, captures, parts = archive(spark, rows)
    wanted = pages(spark, [(0, "http://h3.example.org/p3", "")]).select(warc.url_key().alias("url_key"))
    found = {r["page_id"] for r in warc.read_records(spark, warc.lookup(spark, wanted, parts, folder), folder).collect()}
    assert found == {i for i in range(300) if i % 40 == 3 and i % 7 == 3}
    reader = warc.IndexReader(folder, [tuple(r) for r in parts.collect()])
    list(reader.find("org,example,h3)/p3 "))
    assert len(reader.known) <= 6
    assert list(reader.find("org,example,absent)/ ")) == []


def test_keys_and_records():
    data = warc.render(5, "http://x/ä\n", b"body", None)
    assert b"\nWARC-Type: response" in data and b"http://x/%E4%0A" not in data.split(b"\r\n")[0]
    assert warc.parse(data) == (5, 4, base64.b32encode(hashlib.sha1(b"body").digest()).decode(), "response", None, b"body")
    for i in (0, 7, -1, 2**63 - 1, -(2**63), None):
        assert warc.page_of(warc.record_id(i).encode()) == i
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"body", b"bodx"))


def test_no_pages(spark):
    folder, captures, parts = archive(spark, [])
    assert captures.count() == 0 and warc.read_records(spark, warc.lookup(spark, captures.select("url_key", "page_id"), parts, folder, True), folder).count() == 0
