import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from .frames import AWKWARD, LONG, documents

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from wattline.llm import bpe, langid, ordinal, packing, ppm, rules, urlfilter  # noqa: E402
from wattline.llm._common import crc_mod, work_folder  # noqa: E402


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, AWKWARD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [(1, "x")]).where("false")


# BPE


def library(name):
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path(name))


def test_bpe_equals_the_library(spark, awkward):
    reference = library("byte_bpe_50k.json")
    encoder = bpe.ByteBpe.load(bpe.tokenizer_path("byte_bpe_50k.json"))
    found = bpe.encoding_digests(awkward, encoder).collect()
    encoded = bpe.encode_texts(awkward, encoder)
    real = Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect())
    assert real == Counter((i, tuple(reference.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD)
    assert Counter(tuple(r) for r in bpe.decode_ids(encoded, encoder).collect()) == Counter((i, t or "") for i, t in AWKWARD)
    expected = Counter()
    for doc_id, text in AWKWARD:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        expected[(doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in found) == expected


def test_bpe_in_many_small_rounds(spark, awkward):
    encoder = bpe.ByteBpe.load(bpe.tokenizer_path("byte_bpe_50k.json"))
    one = sorted(map(tuple, bpe.encoding_digests(awkward, encoder).collect()), key=repr)
    many = sorted(map(tuple, bpe.encoding_digests(awkward, encoder, most_pieces=3, most_bytes=50).collect()), key=repr)
    assert one == many


def test_pair_index_merges_runs_and_ranks():
    encoder = bpe.ByteBpe.load(bpe.tokenizer_path("byte_bpe_50k.json"))
    reference = library("byte_bpe_50k.json")
    pieces = ["a" * n for n in range(1, 12)] + ["ababab", "banana", " the", "\n\n\n", "…", "zzzzzz9"]
    ids, starts = encoder.encode_pieces([p.encode() for p in pieces])
    for i, piece in enumerate(pieces):
        assert ids[starts[i] : starts[i + 1]].tolist() == reference.encode(piece, add_special_tokens=False).ids


def test_bpe_of_nothing(spark, empty):
    assert bpe.encode_texts(empty, bpe.ByteBpe.load(bpe.tokenizer_path("byte_bpe_50k.json"))).count() == 0


# Packing


def test_packing_places_every_id_once(spark, awkward):
    reference = library("word_bpe_49k.json")
    pieces = packing.pack(spark, awkward, packing.load_spec(), size=64).collect()
    digests = Counter(r["ids_crc32"] for r in packing.pack(spark, awkward, packing.load_spec(), size=64, digests=True).collect())
    assert digests == Counter(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in pieces)
    ids = defaultdict(list)
    for doc_id, text in AWKWARD:
        ids[doc_id].append(reference.encode(text or "", add_special_tokens=False).ids + [1])
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(p["length"] for p in pieces) == total
    for p in pieces:
        whole = ids[p["doc_id"]][0]
        part = np.array(whole[p["start"] : p["start"] + p["length"]], "<u4")
        assert len(part) == p["length"] and part.tolist() == p["ids"] and p["doc_tokens"] == len(whole)
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in by.values():
        spans.sort()
        used = sum(n for _, n in spans)
        assert [o for o, _ in spans] == list(np.cumsum([0] + [n for _, n in spans])[:-1])
        assert used == 64 or used & (used - 1) == 0


def test_hilbert_neighbours_touch():
    side, bits = 8, 3
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert_index(points, bits)
    assert sorted(keys) == list(range(side**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_similar_texts_lie_close_on_the_curve():
    texts = [b"the quick brown fox jumps over the lazy dog " * 20, b"the quick brown fox jumps over the lazy dog " * 19 + b"the quick brown cat ", b"\xc3\xa9\xc3\xa0\xc3\xb9 " * 200]
    v = packing.hashed_vectors(texts)
    assert v[0] @ v[1] > v[0] @ v[2]
    alone = packing.curve_keys([texts[1]])
    assert packing.curve_keys(texts)[1] == alone[0]


def test_packing_stage_delivers_ids(spark, awkward):
    found = packing.packing_stage(spark, awkward, "").collect()
    assert found and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in found)
    plain = packing.pack(spark, awkward, packing.load_spec()).drop("ids_crc32").collect()
    assert sorted((repr(r["doc_id"]), r["start"], tuple(r["ids"])) for r in plain) == sorted((repr(r["doc_id"]), r["start"], tuple(r["ids"])) for r in found)


def test_equal_keys_are_split(spark):
    """A text that all rows share spreads over the partitions; the key of a row is its text's."""
    docs = documents(spark, [(i, "the same words for all of them") for i in range(400)] + [(900, "other"), (None, None), (None, None)])
    ordered = packing.curve_ordered(spark, docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 4, 12)
    sizes = [r["n"] for r in ordered.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 403 and max(sizes) < 250
    assert {r["curve_key"] for r in ordered.where("doc_id < 400").collect()} == {int(packing.curve_keys([b"the same words for all of them"])[0])}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.load_spec(bpe.tokenizer_path("byte_bpe_50k.json"))


def test_packing_of_nothing(spark, empty):
    assert packing.pack(spark, empty, packing.load_spec()).count() == 0


# Language


LANGS = {"en": "the cat sat on the mat and looked at the other cats in the house", "de": "der hund und die katze sind nicht in dem haus sondern auf der wiese", "fr": "le chat est dans la maison avec les autres animaux de la ferme"}


def language_rows():
    rows, n = [], 0
    for lang, text in LANGS.items():
        words = text.split()
        for i in range(40):
            rows.append((n, " ".join(words[(i * 3 + j * (i % 5 + 1)) % len(words)] for j in range(12)), lang))
            n += 1
    return rows


def test_languages_on_held_out_rows(spark):
    docs = documents(spark, language_rows() + [(900, None), (901, "123 !!"), (902, "漢字漢字"), (903, "unlabelled", None)])
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held))
    found = {r["doc_id"]: r for r in langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()}
    inside = [r for i, r in found.items() if i < 900]
    assert np.mean([r["lang"] == r["lang_pred"] for r in inside]) > 0.95
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[900]["score"] == 0
    assert found[902]["lang_pred"] in LANGS and found[902]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_stage_rejects_junk_and_unlearned_languages(spark):
    rng = np.random.default_rng(3)
    junk = [(800 + i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)), None) for i in range(20)]
    strange = "kissa istui matolla ja katseli muita kissoja talossa ennen kuin aurinko laski"
    clean = language_rows()
    found = langid.language_stage(spark, documents(spark, clean + junk + [(850, strange, None)]), "")
    assert {r["doc_id"] for r in found.collect()} == {r[0] for r in clean}


def test_stage_keeps_documents_of_many_similar_languages(spark):
    base = LANGS["en"].split()
    rows = [(20 * k + i, " ".join([base[(i * 3 + j) % len(base)] for j in range(12)] + [f"zq{chr(97 + k)}x{chr(97 + k)}"] * 2), f"l{k}") for k in range(12) for i in range(20)]
    assert langid.language_stage(spark, documents(spark, rows), "").count() == len(rows)


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: letters[k % 26] + letters[k // 26]
    rows = [(10 * k + i, " ".join(f"{name(k)}q{name(k)}{c}" for c in letters[i : i + 12]), f"l{k:03}") for k in range(150) for i in range(3 if k >= 100 else 5)]
    model = langid.train(documents(spark, rows))
    assert len(model.languages) == 150
    assert langid.train(documents(spark, [(1, "123", "en")])).predict(["abc", "1"])[0] == ["en", "und"]
    assert model.predict([text for _, text, _ in rows])[0] == [lang for _, _, lang in rows]


def test_copies_weigh_once_in_training(spark):
    rows = [(i, f"{LANGS['en']} {'abcdefghij'[i] * 3}", "en") for i in range(10)]
    copies = [(100 + i, "zzyzx qqkvj " * 10, "en") for i in range(500)]
    alone, many = (langid.train(documents(spark, rows + extra), floor=0.002) for extra in (copies[:1], copies))
    assert (alone.slots == many.slots).all() and many.predict([LANGS["en"]])[1][0] == 1


def plain_grams(text, orders=(3, 4)):
    """Every n-gram of a text as a tuple of letters; a word may show one gap at either side."""
    letters = [c.lower()[0] if __import__("unicodedata").category(c)[0] == "L" else "" for c in "  " + (text or "") + "  "]
    found = []
    for n in orders:
        for i in range(len(letters) - n + 1):
            cut = letters[i : i + n]
            if cut[1] and all(cut[j] for j in range(2, n - 1)):
                found.append(tuple(cut))
    return found


def test_predictions_equal_plain_sets(spark):
    """Filters against sets of n-grams, with the false-positive share worked out from the slots."""
    rows = language_rows()
    docs = documents(spark, rows + [(900, "katze chat cat im dans the"), (901, "É漢字 \U0001f600 x"), (902, None)])
    model = langid.train(docs.where("doc_id < 900"), bits=16, hashes=2)
    counts = {lang: Counter(g for _, t, k in rows if k == lang for g in plain_grams(t)) for lang in LANGS}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {g: max(share[k].get(g, 0) for k in LANGS) for k in LANGS for g in share[k]}
    sets = {lang: {g for g, p in share[lang].items() if p >= 5e-6 and p >= 0.25 * top[g]} for lang in LANGS}
    key = lambda g: langid._grams(np.array([ord(c) if c else 0 for c in g], np.uint16), len(g))[0]
    slots = {lang: {int(s) for g in sets[lang] for h in range(2) for s in langid._slot(key(g), h, 16)} for lang in LANGS}
    assert set(model.languages) == set(LANGS)
    for i, lang in enumerate(model.languages):
        assert model.fill[i] == len(slots[lang]) / 2**16
    for r in langid.identify(docs, model, keep=("doc_id", "text")).collect():
        grams = plain_grams(r["text"])
        holds = lambda lang, g: all(int(s) in slots[lang] for h in range(2) for s in langid._slot(key(g), h, 16))
        corrected = {}
        for lang in model.languages:
            wrong = (len(slots[lang]) / 2**16) ** 2
            corrected[lang] = max(0.0, (sum(holds(lang, g) for g in grams) - len(grams) * wrong) / (1 - wrong))
            assert sum(holds(lang, g) for g in grams) >= sum(g in sets[lang] for g in grams)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        best = max(corrected.values())
        assert r["lang_pred"] == next(k for k in model.languages if corrected[k] == best)
        assert r["score"] == pytest.approx(best / sum(corrected.values()) if best else 0.0, abs=1e-9)


def test_training_sample_is_bounded(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} {i}", "en" if i % 3 else "de") for i in range(600)] + [(1000 + i, "copied text", "en") for i in range(500)]
    languages, drawn = langid.sampled(documents(spark, rows), 60, work_folder(spark, "sample") + "/near")
    found = [tuple(r) for r in drawn.collect()]
    assert languages == ["en", "de"] and len(found) == len(set(found)) and set(found) <= {(t, k) for _, t, k in rows}
    assert max(Counter(k for _, k in found).values()) <= 30 and len(found) > 40


def test_clashing_columns_of_the_stage(spark):
    docs = documents(spark, language_rows()).withColumnRenamed("first", "__language").withColumnRenamed("kept", "__text")
    found = langid.language_stage(spark, docs, "")
    assert found.columns == docs.columns and found.where("__language = 'x'").count() == docs.count()


def test_false_positives_are_corrected():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2**63, 4000).astype(np.uint64)
    masks = np.where(np.arange(4000) < 3900, 1, 2).astype(np.uint64)
    model = langid.LanguageFilter.build(("a", "b"), grams, masks, 13, 2, (3,))
    assert model.containing(grams).all() and model.fill[0] > 0.5 > model.fill[1]


def test_language_edges(spark, awkward, empty):
    assert langid.identify(awkward, langid.train(awkward.where("false"))).where("lang_pred <> 'und'").count() == 0
    model = langid.train(awkward)
    assert langid.identify(awkward, model).count() == len(AWKWARD) and langid.identify(empty, model).count() == 0
    stage = langid.language_stage(spark, awkward, "")
    assert stage.columns == awkward.columns and {r["doc_id"] for r in stage.collect()}.isdisjoint({1, 2, 3})


# Quality


def graded(spark):
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(300)]
    rows, grades = [], []
    for i in range(600):
        words = list(rng.choice(common, rng.integers(30, 120)))
        grade = i % 3
        if grade == 0:
            words[3:3] = ["awful", "insult"]
        if grade == 1:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
        grades.append((i, grade))
    return documents(spark, rows), spark.createDataFrame(grades, "doc_id long, grade int")


def test_ordinal_model_on_held_out_rows(spark):
    docs, grades = graded(spark)
    model = ordinal.train(docs, grades.where("doc_id % 4 <> 1"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    found = ordinal.grade_texts(docs.where("doc_id % 4 = 1"), model, 2).join(grades, "doc_id").collect()
    assert np.mean([(r["tail_probability"] >= 0.5) == (r["grade"] == 2) for r in found]) > 0.97
    by = [np.mean([r["expected_grade"] for r in found if r["grade"] == g]) for g in range(3)]
    assert by[0] < by[1] < by[2]


def test_ordinal_edges(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = ordinal.train(awkward, none, 3)
    assert ordinal.grade_texts(awkward, model, 2).where("tail_probability < 0.99").count() == 0
    docs, grades = graded(spark)
    model = ordinal.train(docs, grades.unionByName(spark.createDataFrame([(1, None), (None, 2)], "doc_id long, grade int")), 3)
    assert ordinal.grade_texts(awkward, model, 2).count() == len(AWKWARD) and ordinal.grade_texts(empty, model, 2).count() == 0


def test_ordinal_gradient_and_optimum():
    """The fit stops where the penalised likelihood, written out plainly, is flat."""
    rng = np.random.default_rng(1)
    features = [np.unique(rng.integers(0, 8, 4)).astype(np.int32) for _ in range(400)]
    truth = rng.normal(size=8)
    grades = np.digitize([truth[f].sum() + rng.logistic() for f in features], [-1.0, 1.0])
    model = ordinal.fit(features, grades, 3, 3, rounds=3000, penalty=0.05, least_z=0.0)

    def loss(weights, cuts):
        total = 0.0
        for f, g in zip(features, grades, strict=True):
            edges = [0.0, *(1 / (1 + math.exp(weights[f].sum() - c)) for c in cuts), 1.0]
            total -= math.log(edges[g + 1] - edges[g])
        return total / len(features) + 0.05 * (weights**2).sum() / 2 / 8**0.5

    weights, cuts, step = model.weights.astype(float), model.thresholds, 1e-5
    for i in range(8):
        shift = np.eye(8)[i] * step
        assert abs(loss(weights + shift, cuts) - loss(weights - shift, cuts)) / (2 * step) < 2e-3
    for i in range(2):
        shift = np.eye(2)[i] * step
        assert abs(loss(weights, cuts + shift) - loss(weights, cuts - shift)) / (2 * step) < 2e-3


def test_grades_equal_plain_arithmetic(spark, awkward):
    """Few buckets, so that many words collide: each bucket counts once, as in training."""
    rng = np.random.default_rng(2)
    model = ordinal.OrdinalModel(rng.normal(size=64).astype(np.float32), np.array([-0.5, 0.75]))
    for r in ordinal.grade_texts(awkward, model, 2, keep=("doc_id", "text")).collect():
        words = (r["text"] or "").split()
        names = [w.strip(ordinal.EDGES).lower().encode() for w in words] + ordinal._shape(r["text"] or "", words, set(words))
        latent = sum(float(model.weights[b]) for b in {zlib.crc32(n) & 63 for n in names})
        at_most = [1 / (1 + math.exp(latent - c)) for c in (-0.5, 0.75)]
        assert r["expected_grade"] == pytest.approx(2 - sum(at_most), abs=1e-6) and r["tail_probability"] == pytest.approx(1 - at_most[1], abs=1e-6)


def test_repeated_labels_and_texts_of_one_id(spark):
    docs, grades = graded(spark)
    model = ordinal.train(docs, grades, 3)
    more = spark.createDataFrame([(1, 2), (2, 2), (3, 1)] * 3, "doc_id long, grade int").where("doc_id <> 1 or grade = 2")
    again = ordinal.train(docs.unionByName(docs), grades.unionByName(more), 3)
    assert (again.weights == model.weights).all() and (again.thresholds == model.thresholds).all()
    turned = documents(spark, [(1, "one text"), (1, "another")]), documents(spark, [(1, "another"), (1, "one text")])
    one, two = (ordinal.train(d, grades, 3) for d in turned)
    assert (one.weights == two.weights).all()


def test_sample_of_labels_is_bounded(spark):
    docs, grades = graded(spark)
    seen = []
    original, ordinal.fit = ordinal.fit, lambda features, *rest: (seen.append(len(features)), original(features, *rest))[1]
    try:
        ordinal.train(docs, grades, 3, max_rows=50)
    finally:
        ordinal.fit = original
    assert 30 < seen[0] <= 50


# Scores


def test_scores_equal_a_trie_walk(spark, tmp_path):
    base = [(200 + i, " ".join(f"ab{(i * 7 + j) % 13}c" for j in range(30 + i % 9)) + " Tail.") for i in range(60)]
    path = str(tmp_path / "docs")
    documents(spark, base + AWKWARD).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    found = ppm.score_documents(spark, docs, crc_mod(F.col("doc_id"), 5) == 1, limit=100_000).collect()
    rows = base + AWKWARD
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: (t or "").encode().lower().split()
    counts, contexts, total = Counter(), [defaultdict(Counter) for _ in range(ppm.ORDER + 1)], 0
    pad = ppm.END * ppm.ORDER
    for i, t in rows:
        if not out(i):
            counts.update(words(t))
            counts[b"\n"] += 1
            total += len(words(t)) + 1
            line = pad + b" ".join(words(t)) + ppm.END
            for j in range(ppm.ORDER, len(line)):
                for k in range(ppm.ORDER + 1):
                    contexts[k][line[j - k : j]][line[j]] += 1

    def log_p(context, byte):
        ruled, cost = set(), 0.0
        for k in range(ppm.ORDER, -1, -1):
            left = {b: n for b, n in contexts[k].get(context[ppm.ORDER - k :], {}).items() if b not in ruled}
            if not left:
                continue
            size = sum(left.values())
            if byte in left:
                return cost + math.log10((left[byte] - 0.5) / size)
            cost += math.log10(0.5 * len(left) / size)
            ruled |= set(left)
        return cost - math.log10(256 - len(ruled))

    expected = Counter()
    for i, t in rows:
        if t == LONG:
            continue
        line, w = pad + b" ".join(words(t)) + ppm.END, [*words(t), b"\n"]
        score = sum(log_p(line[j - ppm.ORDER : j], line[j]) for j in range(ppm.ORDER, len(line)))
        basic = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (len(counts) + 1))) for x in w)
        expected[(i, out(i), len(w), sum(counts[x] > 0 for x in w), total, round(basic, 4), round(score, 4))] += 1
    given = Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 4), round(r[6], 4)) for r in found if r["doc_id"] != 7)
    assert given == expected and len(found) == len(rows)


def test_probabilities_of_a_context_sum_to_one():
    texts = [b"abracadabra\n", b"abrakadabra\n", b"banana\n"]
    key, count = np.unique(ppm.context_keys(texts)[0], return_counts=True)
    pairs = np.zeros((256, 256), np.int64)
    for k, n in zip(key.tolist(), count.tolist(), strict=True):
        pairs[k >> 8 & 255, k & 255] += n
    contexts = np.unique(key >> np.uint64(8))

    def second_order(keys, counts):
        of = defaultdict(Counter)
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            of[k >> 8 & 0xFFFF][k & 255] += n
        rows = []
        for k in keys.tolist():
            known = {b: n for b, n in of[k >> 8 & 0xFFFF].items() if n}
            rows.append((known.get(k & 255, 0), sum(known.values()), len(known), sum(int(pairs[k >> 8 & 255, b]) for b in known)))
        return np.array(rows, np.int64)

    for context in contexts[:6]:
        asked = (context << np.uint64(8)) + np.arange(256, dtype=np.uint64)
        every = np.union1d(key, asked)
        counts = np.zeros(len(every), np.int64)
        counts[np.searchsorted(every, key)] = count
        logs = np.zeros(len(every))
        family, second = every >> np.uint64(8) & np.uint64(0xFFFFFF), second_order(every, counts)
        for f in np.unique(family):
            logs[family == f] = ppm.code_lengths(every[family == f], counts[family == f], second[family == f], pairs)
        assert (10 ** logs[np.searchsorted(every, asked)]).sum() == pytest.approx(1)


def test_scores_without_training_or_rows(spark, tmp_path, empty):
    assert ppm.score_documents(spark, empty, F.lit(False), from_files=False).count() == 0
    docs = documents(spark, [(1, "ab"), (2, None)]).repartition(2, "doc_id")  # one chunk without a word
    found = {r["doc_id"]: r for r in ppm.score_documents(spark, docs, F.lit(True), from_files=False).collect()}
    assert found[1]["score"] == pytest.approx(-3 * math.log10(256)) and found[2]["n_tokens"] == 1 and found[1]["n_known"] == 0


# Rules


def measured(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, awkward):
    more = documents(spark, [(100, "a b c d a b c\nx # | y\nx # | y\n\n\n"), (101, "q w e " * 40), (102, " ".join(f"{i % 7} {i % 3}" for i in range(300)))])
    rows = awkward.unionByName(more)
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.ledger(rows).collect())
    assert found == Counter((r["doc_id"], *measured(r["text"])) for r in rows.collect())


def test_policies_and_ablations(spark):
    good = " ".join(f"plain{i}" for i in range(80))
    docs = documents(spark, [(1, good), (2, "short"), (3, " ".join(f"x{i}***" for i in range(80))), (4, " ".join(f"X{i}!!" for i in range(80))), (5, "short***")])
    book = rules.ledger(docs).cache()
    kept = {v: {r["doc_id"] for r in rules.apply_policy(book, v).where("kept").collect()} for v in rules.POLICIES}
    assert kept == {"base": {1, 3, 4}, "v1": {1}, "v2": {1}}
    found = {r["rule"]: (r["failing"], r["only_this"], r["kept_without"]) for r in rules.ablations(book, "v1").collect()}
    assert found["few_words"] == (2, 1, 2) and found["symbols"] == (2, 1, 2) and found["shouting"] == (1, 1, 2)


def test_rules_on_nothing_and_beside_other_columns(spark, awkward, empty):
    assert rules.ledger(empty).count() == 0 and rules.ablations(rules.ledger(empty), "v1").count() == 0
    clash = awkward.withColumnRenamed("first", "__words").withColumnRenamed("lang", "__text")
    found = rules.ledger(clash, keep=("doc_id", "__words", "__text"))
    assert found.where("__words = 'x' and __text = 'en'").count() == len(AWKWARD) == rules.ledger(awkward).count()
    assert rules.ledger(awkward).select("doc_id", "failed_bits").exceptAll(found.select("doc_id", "failed_bits")).count() == 0


def test_rules_stay_in_the_jvm(spark, awkward):
    plan = rules.ledger(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan


# Urls


def test_urls(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, "http://A.B.NET/x?q#f"), (4, "http://www.example.net/en/1"), (5, "https://example.com/de/x"), (6, "http://deep.sub.org/fr/"), (7, "http://host.org"),
        (8, "http://anet/x"), (9, "http://net/"), (10, "http://www.cheap-pills.example.org/en/3"), (11, "ftp://x?y/z"), (12, "http://exämple.ORG/FR/"), (13, "a://b://c/d"), (None, "http://x.net/"),
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, rule string")
    found = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    assert len(found) == len(rows)
    for i, url in rows:
        assert (found[i]["host"], found[i]["path"]) == urlfilter.url_parts(url)
    assert found[3]["rule"] == "net/" and found[3]["verdict"] == "block" and found[4]["rule"] == "example.net/en/" and found[4]["verdict"] == "allow"
    assert found[5]["verdict"] == "block" and found[6]["rule"] == "org/fr/" and found[9]["rule"] == "net/" and found[8]["rule"] is None
    assert found[7]["rule"] is None and found[10]["verdict"] == "block" and found[1]["verdict"] == "allow" and found[1]["host"] == ""
    plan = urlfilter.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and urlfilter.judge(pages.where("false")).count() == 0
    assert urlfilter.judge(pages.withColumnRenamed("host", "__rule"), keep=("page_id", "__rule")).where("__rule = 'x'").count() == len(rows)


def test_url_scores_equal_plain_arithmetic(spark):
    values, constant = urlfilter.default_weights()
    urls = [u for u, _ in urlfilter.labelled_urls()[::37]]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in urlfilter.judge(pages).collect():
        grams = urlfilter.ngrams(*urlfilter.url_parts(urls[r["page_id"]]))
        assert r["score"] == constant + sum(values[b] for b in {urlfilter._bucket(g) for g in grams})


def test_url_filter_on_held_out_urls():
    rows = urlfilter.labelled_urls()
    fold = lambda url: int(hashlib.md5(url.encode()).hexdigest(), 16) % 4
    blocked = {0: [], 1: []}
    for f in range(4):
        values, constant = urlfilter.fit([r for r in rows if fold(r[0]) != f])
        for url, label in rows:
            if fold(url) == f:
                buckets = {urlfilter._bucket(g) for g in urlfilter.ngrams(*urlfilter.url_parts(url))}
                blocked[label].append(constant + sum(values[b] for b in buckets) > urlfilter.block_above())
    assert len(blocked[0]) == len(blocked[1]) > 80
    assert np.mean(blocked[1]) > 0.7 and np.mean(blocked[0]) < 0.05


def test_url_table_by_path_and_its_bound(tmp_path):
    path = tmp_path / "urls.csv"
    path.write_text("url,label\nhttp://bad.example/,1\nhttp://good.example/,0\nhttp://bad.example/,1\n,0\n")
    rows = urlfilter.read_labelled(str(path))
    assert len(rows) == 4 and rows[3] == (None, 0) and len(urlfilter.drawn(rows, 10)) == 3
    assert urlfilter.drawn(rows, 2) == urlfilter.drawn(rows[::-1], 2) and len(urlfilter.drawn(rows, 2)) == 2
    assert urlfilter.fit(rows) == urlfilter.fit(rows[::-1])
    assert urlfilter.fit([("http://x/", 1)] * 10) == urlfilter.fit([]) == ([0] * urlfilter.BUCKETS, 0)
