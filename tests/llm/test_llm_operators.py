"""Operators for training text against brute force on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from llm import decontaminate, language, line_templates, mixing, neighbours, ngram_join, packing, quality, token_counts, toxicity
from llm.boosting import fit
from llm.common import components, remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, key string, row string, part int"


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of every odd kind; the last columns have names that operators use themselves."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "Iota", "kappa"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    long = text(3000)
    base = text(60)
    near = base.split()
    near[5] = "changed"
    far = base.split()
    far[::7] = ["other"] * len(far[::7])
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, " ".join(far)), (5, None), (6, ""), (7, "   \n\t "), (8, "one two"), (9, "ONE two"),
        (10, long), (10, long), (11, long + " end"), (None, base), (12, "日本語 の テキスト 😀"), (13, "a" * 5000), (14, text(40)), (15, text(40) + "\n" + text(12)),
    ]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None if i == 4 else f"s{(i or 0) % 3}", 0, 9.0, 7, "k", "r", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- graphs ---


def test_components_of_chain_and_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)], "a long, b long")
    assert collected(components(edges), "node", "label") == sorted([(i, 10) for i in range(10, 41)] + [(i, 100) for i in range(100, 130)], key=repr)


# --- 1 language ---


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(0)
    for _ in range(100):
        labels, kinds, penalty = rng.integers(2, 5), rng.integers(1, 8), float(rng.choice([0.5, 2, 4]))
        scores, lengths = rng.normal(size=(kinds, labels)) * 3, rng.integers(0, 9, size=4)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        at = rng.integers(0, kinds, size=offsets[-1])
        found = language.viterbi(scores, at, offsets, penalty)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            value = np.zeros(labels)
            for k, w in enumerate(at[a:b]):
                value = (np.maximum(value, value.max() - penalty) if k else value) + scores[w]
            own = found[a:b]
            path = sum(scores[w, s] for w, s in zip(at[a:b], own, strict=True)) - penalty * np.sum(own[1:] != own[:-1])
            assert abs(path - value.max()) < 1e-9


def test_language_of_mixed_and_odd_texts(spark, docs, nothing):
    german, english = "der und die nicht mit einer schule straße " * 20, "the and with this house which water " * 20
    known = spark.createDataFrame([(1, german, "de"), (2, english, "en"), (3, "привет как дела " * 9, "ru"), (4, None, "en"), (5, "x", None)], "doc_id long, text string, lang string")
    model = language.learn(known, F.col("lang"))
    assert model.langs == ["de", "en", "ru"]
    mixed = "the house with water and this nicht mit einer schule und die straße der schule nicht einer"
    asked = spark.createDataFrame([(1, mixed), (2, "дела"), (3, "12 !! 34"), (4, None), (5, ""), (6, "😀 😀"), (7, "the " * 5000)], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(asked, model).collect()}
    assert [s.lang for s in found[1].spans] == ["en", "de"] and found[1].lang_pred == "de" and 0.5 < found[1].score < 1
    assert found[2].lang_pred == "ru" and found[7].lang_pred == "en"
    assert all(found[k].lang_pred == "und" and found[k].score == 0 and found[k].spans == [] for k in (3, 4, 5, 6))
    assert language.identify(docs, model).count() == docs.count()
    empty = language.learn(nothing, F.col("lang"))
    assert {r.lang_pred for r in language.identify(asked, empty).collect()} == {"und"}
    assert language.identify(nothing, model).count() == 0


# --- 2 neighbours ---


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 20)).astype(np.float32)
    points[50:120] = points[50]  # copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(7, [float(x) for x in points[7]])]
    odd = [(400, None), (420, [0.0] * 20), (440, [1.0] * 19 + [None]), (460, [1.0] * 19 + [float("nan")]), (480, [1.0] * 19 + [float("inf")]), (500, [1.0] * 3), (None, [1.0] * 20), (520, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("list", F.lit("x"))
    found = neighbours.neighbours(table, share=1.0)
    exact = points.astype(np.float64)
    own = {}
    for r in found.collect():
        own.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(own) == list(range(0, 300, 20))
    hits = 0
    for query, got in own.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        product = exact @ exact[query]
        assert all(abs(s - product[v]) < 1e-9 for _, v, s in got)
        best = sorted((i for i in range(300) if i != query), key=lambda i: (-round(float(product[i]), 9), i))[:20]
        hits += len(set(best) & {v for _, v, _ in got})
    assert hits >= 0.95 * 20 * len(own)
    assert neighbours.neighbours(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert collected(neighbours.neighbours(few), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 0.5)]


def test_scan_without_rejections_is_exact():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(9, 33)), rng.normal(size=(70, 33))
    least = np.sort(q @ x.T, axis=1)[:, -5] - 1e-9
    a, b, _ = neighbours.scan(q, least, x, np.linalg.qr(rng.normal(size=(33, 33)))[0], caution=50.0)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(q @ x.T >= least[:, None])), strict=True))


def test_scan_with_rising_thresholds_keeps_the_best():
    rng = np.random.default_rng(3)
    q, x = np.round(rng.normal(size=(40, 24)), 1), np.round(rng.normal(size=(1500, 24)), 1)
    x[700:760] = x[3]  # ties
    lists, chosen = rng.integers(0, 3, size=1500), rng.random((40, 3)) < 0.7
    least = np.full(40, -np.inf)
    a, b, score = neighbours.scan(q, least, x, np.linalg.qr(rng.normal(size=(24, 24)))[0], 50.0, 5, lists, chosen)
    exact = np.einsum("id,jd->ij", q, x)
    for i in range(40):
        reach = np.flatnonzero(chosen[i][lists])
        last = np.sort(exact[i, reach])[-6] if len(reach) else np.inf
        assert set(b[a == i]) >= {j for j in reach if exact[i, j] > last + 1e-9}
        assert set(b[a == i]) <= set(reach)
        assert all(score[a == i] >= last - 1e-9)


def test_a_full_block_is_scanned_in_bounded_memory():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(neighbours.PART_ROWS, 64)), rng.normal(size=(neighbours.PACK_ROWS, 64))
    tracemalloc.start()
    neighbours.scan(q, np.full(len(q), -np.inf), x, np.eye(64), 3.0, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_packs_hold_short_lists_together():
    found = neighbours.packs(np.array([3000, 1000, 500, 9000, 10, 0, 20]))
    assert found.tolist() == [0, 0, 1, 2, 3, 3, 3]


# --- 3 mixing ---


def test_targets_are_shared_again_until_none_is_above(spark):
    sized = spark.createDataFrame([(i, s, 0, n) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 50), (None, 400), ("d", 0)])], "doc_id long, source string, row_key long, size long")
    found = {r.source: (r.source_size, r.target) for r in mixing.targets(sized, [3, 1, 2], 1.5, 2.0).collect()}
    sources = ["a", "b", "c", "d", None]
    weight, size = dict(zip(sources, [3, 1, 2, 3, 1], strict=True)), {s: found[s][0] for s in sources}
    full, left = set(), dict(weight)
    while True:
        share = (1.5 * 1460 - sum(2 * size[s] for s in full)) / sum(left.values())
        over = {s for s in left if share * left[s] > 2 * size[s]}
        if not over:
            break
        full |= over
        left = {s: w for s, w in left.items() if s not in over}
    assert {s: round(found[s][1], 6) for s in sources} == {s: round(2.0 * size[s] if s in full else share * left[s], 6) for s in sources}


def test_mixing_takes_each_source_near_its_target(spark, docs, nothing):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 200), "hot" if i % 3 else f"s{i % 4}") for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(table, [3, 1, 2]).collect()
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in own) - own[0].target) <= 200
        assert all(0 <= r.copies <= 2 for r in own)
    assert found and collected(mixing.mix(table.repartition(7), [3, 1, 2]), "doc_id", "copies") == sorted(((r.doc_id, r.copies) for r in found), key=repr)
    assert mixing.mix(docs, [3, 1, 2]).count() == docs.count()
    taken = mixing.mixed(docs, [3, 1, 2])
    assert taken.columns == docs.columns
    assert mixing.mix(nothing, [3, 1, 2]).count() == 0 and mixing.mixed(nothing, [3, 1, 2]).count() == 0


# --- 4 packing ---


def test_best_fit_decreasing_against_brute_force():
    rng = random.Random(7)
    for _ in range(100):
        length = rng.randint(1, 50)
        sizes = np.array([rng.randint(1, length) for _ in range(rng.randint(0, 60))], dtype=int)
        rooms = []
        for size in sorted(sizes.tolist(), reverse=True):
            fits = [r for r in rooms if r >= size]
            rooms.append(min(fits) - size if fits else length - size)
            if fits:
                rooms.remove(min(fits))
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(length - sum(sizes[p] for p in row) for row in rows) == sorted(rooms)
        assert sorted(p for row in rows for p in row) == list(range(len(sizes)))


def test_packed_rows_give_the_texts_back(spark, docs, nothing, tmp_path):
    length = 64
    coder = packing.encoder(open(packing.VOCABULARY, "rb").read())
    pieces = {}
    for r in packing.pack(docs, length).collect():
        assert len(r.ids) == len(r.position_ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert set(r.ids[r.n_tokens :]) <= {packing.END_OF_TEXT}
        for doc, start, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert r.position_ids[a:b] == list(range(b - a))
            pieces.setdefault(doc, []).append((start, r.ids[a:b]))
    want = {}
    for name, text in texts_of(docs):
        want.setdefault(name, []).append(coder.encode_ordinary(text or "") + [packing.END_OF_TEXT])
    for name, ids in want.items():
        assert sum(len(p) for _, p in pieces[name]) == sum(map(len, ids))
        if len(ids) == 1:
            assert [i for _, p in sorted(pieces[name]) for i in p] == ids[0]
    packing.write_packed(packing.pack(docs, length), str(tmp_path / "packed"))
    raw = spark.read.parquet(str(tmp_path / "packed")).orderBy("pack_id").first()
    same = packing.pack(docs, length).orderBy("pack_id").first()
    assert np.frombuffer(raw.ids, "<i4").tolist() == same.ids and np.frombuffer(raw.cu_seqlens, "<i4").tolist() == same.cu_seqlens
    assert packing.pack(nothing).count() == 0


def test_cut_texts_have_the_tokens_of_whole_ones():
    ranks = open(packing.VOCABULARY, "rb").read()
    texts = ["", " ", "a b", "  a  b ", "a  b c", "x\n y", "é é é", " a", "a ", "1 2 3 !! ?", "it's I'll  we", "a b c", "don't  \t stop"]
    ids, offsets = packing.Coder(ranks).encode(pa.array(texts), 7)
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*packing.encoder(ranks).encode_ordinary(text), 7]


def test_cuts_never_change_tokens():
    rng, ranks = random.Random(6), open(packing.VOCABULARY, "rb").read()
    signs = [" ", "\n", "\t", "'", ".", ",", "a", "b", "s", "1", "é", "×", "ß", "я", "日", "😀", "\u00a0", "\u2003", "\u0085", "'s", "don't", " the", "))", "’"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(4000)]
    coder, whole = packing.Coder(ranks), packing.encoder(ranks)
    for start in (0, 2000):
        ids, offsets = coder.encode(pa.array(texts[start : start + 2000]), 7)
        for k, text in enumerate(texts[start : start + 2000]):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == [*whole.encode_ordinary(text), 7], repr(text)


# --- 5 line templates ---


def test_line_templates(spark, docs, nothing):
    same = "contact the office on floor {} for any further question"
    rows = [(i, f"{'xyz' * (i + 1)} own words {'abc' * (i + 1)} alone here\n{same.format(i * 17)}\nshort line\n") for i in range(6)]
    table = spark.createDataFrame([*rows, (6, "nothing here recurs at all in others"), (7, None), (8, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in line_templates.drop_recurring(table).collect()}
    assert all(found[i].n_dropped == 1 and found[i].n_lines == 4 and "contact" not in found[i].text and "short line" in found[i].text for i in range(6))
    assert found[6].n_dropped == 0 and found[6].text == "nothing here recurs at all in others"
    assert (found[7].text, found[7].n_lines, found[7].n_dropped) == (None, 0, 0) and (found[8].text, found[8].n_dropped) == ("", 0)
    _, templates = line_templates.recurring(table)
    assert {(r.template, r.documents) for r in templates.collect()} == {("contact the office on floor <*> for any further question", 6)}
    assert line_templates.drop_recurring(docs).count() == docs.count()
    assert line_templates.drop_recurring(nothing).count() == 0


@pytest.mark.parametrize(("documents", "values"), [(100, 100), (10_000, 100)])
def test_templates_of_word_fields_do_not_depend_on_size(spark, documents, values):
    word = lambda i: "abcdefghij"[i // 10 % 10] + "klmnopqrst"[i % 10]
    lines = [f"Report filed by {word(i)} in {word(i // values + i)} office today" for i in range(documents)]
    table = spark.createDataFrame([(i, f"{line}\n{'own' * (i % 7)}{word(i)} text") for i, line in enumerate(lines)], "doc_id long, text string")
    assert len(set(lines)) == documents
    found = line_templates.drop_recurring(table).groupBy("n_dropped").count().collect()
    assert [(r.n_dropped, r["count"]) for r in found] == [(1, documents)]


def test_templates_of_several_forms_in_one_leaf(spark):
    word = lambda i: "abcdefghij"[i // 10 % 10] + "klmnopqrst"[i % 10]
    forms = ["Report filed by {} in {} office today", "Report filed by {} for {} branch yesterday", "Report filed by {} about {} matters again"]
    table = spark.createDataFrame([(i, forms[i % 3].format(word(i // 3), word(i // 300 + i // 3))) for i in range(9_000)], "doc_id long, text string")
    assert line_templates.drop_recurring(table).filter("n_dropped = 1").count() == 9_000


@pytest.mark.parametrize(("documents", "holders", "gone"), [(500, 500, True), (500, 20, True), (500, 19, False), (5_000, 24, False), (5_000, 25, True)])
def test_short_lines_recur_in_a_share_of_the_table(spark, documents, holders, gone):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"{word(i)} only\n" + ("All\t rights reserved\n" if i < holders else "") + "\n \n") for i in range(documents)]
    rows[-1] = rows[0]  # a repeated row is one document
    held = sum("rights" in text for _, text in rows)
    holders = len({i for i, text in rows if "rights" in text})
    assert gone == (holders >= max(20, documents / 200))
    found = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.filter("n_dropped > 0").count() == (held if gone else 0)
    assert found.filter("text LIKE '%rights%'").count() == (0 if gone else held)
    assert found.filter("n_lines - n_dropped < 4").count() == 0


# --- 6 quality ---


def test_trees_learn_a_threshold_and_its_opposite():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    model = fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    plain = np.full(20, model.base)
    binned = model.bins(x[:20])
    for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):
        for k in range(20):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(binned[k, feature[node]] > cut[node])
            plain[k] += value[node - len(feature)]
    assert np.allclose(1 / (1 + np.exp(-plain)), model.predict(x[:20]))
    assert fit(np.zeros((0, 1)), np.zeros(0)).predict(np.zeros((2, 1))).tolist() == [0.5, 0.5]


def test_quality_on_held_out_documents(spark, sf_dir, docs, nothing):
    table, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.learn(table, labels, "quality", remainder(F.col("doc_id"), 4) != 2)
    both = quality.score(table, model).join(labels, "doc_id").filter(remainder(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in both]) > 0.85
    kept = quality.keep(docs, model)
    good = [r.doc_id for r in quality.score(docs, model).collect() if r.score >= quality.THRESHOLD]
    assert kept.columns == docs.columns and sorted(map(repr, good)) == sorted(repr(r.doc_id) for r in kept.collect())
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    none = quality.learn(table, labels.limit(0), "quality", F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0


def plain_statistics(text):
    """The numbers of one text, counted one by one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 24
    held = lambda chars: sum(b in chars for b in raw)
    upper, beyond = held(range(65, 91)), held(range(128, 256))
    letters = max(held(range(97, 123)) + upper + beyond, 1)
    words = re.findall("[^ \\t\\n\\v\\f\\r]+", text)
    n, some = len(words), max(len(words), 1)
    pairs = [(a, b) for a, b in zip(words, words[1:], strict=False) if a != b]
    lines = text.split("\n")
    repeated = 1 - len(set(words)) / some
    share = lambda pattern: sum(bool(re.search(pattern, w)) for w in words) / some
    return [
        math.log1p(len(raw)), math.log1p(n), sum(len(w.encode()) for w in words) / some, upper / letters, held(range(48, 58)) / len(raw), beyond / letters,
        held(b" \t\r\x0b\x0c") / len(raw), held(b"\n") / some, held(b".!?") / some, held(b"!") / some, held(b",;:'\"()-") / some,
        held(b"#$%&*+/<=>@[\\]^_`{|}~") / some, repeated, repeated / math.log1p(some), max(collections.Counter(words).values(), default=0) / some,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / some, 1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
        1 - len(set(lines)) / len(lines), len(lines) / some, share(r"[#$%&*+/<=>@\[\]^_`{|}~\\]\Z"), share(r"\A[^0-9A-Za-z\u0080-\U0010FFFF]+\Z"),
        share(r"\A[A-Z]"), share(r"\A[^a-z]*[A-Z][^a-z]+\Z"), share(r"\A.{1,3}\Z"),
    ]


def test_statistics_against_one_by_one_counts():
    rng = random.Random(9)
    pieces = ["the", "The", "THE", "ab", "x1", "42", "--", "!!", "über", "ÄÖ", "日本", "end.", "a#", "~", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", ", ", "WoW!", "A1-B"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += ["", None, " ", "\n", "one", "same same same", "a b a b a b", "word " * 50_000, "\n" * 1000, "é" * 3]
    found = quality.statistics(pa.array(texts, pa.string()))
    assert np.allclose(found, [plain_statistics(t) for t in texts], rtol=1e-5, atol=1e-6)
    assert np.array_equal(quality.statistics(pa.array(texts, pa.string()).slice(5, 20)), found[5:25])
    assert quality.statistics(pa.array([], pa.string())).shape == (0, found.shape[1])


# --- 7 n-gram join ---


def brute_components(texts):
    sets = {}
    for k, (name, text) in enumerate(texts):
        words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and texts[a][0] is not None and texts[b][0] is not None and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    smallest = {}
    for k, (name, _) in enumerate(texts):
        if name is not None:
            smallest[find(k)] = min(smallest.get(find(k), name), name)
    return sorted(((name, len(sets[k]), smallest.get(find(k)) if name is not None else None) for k, (name, _) in enumerate(texts)), key=repr)


@pytest.mark.parametrize("block", [ngram_join.BLOCK_ELEMENTS, 200])
def test_join_finds_every_component(spark, docs, nothing, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ELEMENTS", block)
    rng = random.Random(11)
    rows = []
    for group in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 90))]
        for _ in range(rng.choice([1, 3, 15])):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
            rows.append((len(rows) + 100, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(ngram_join.near_duplicates(table), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    if block != 200:
        assert collected(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == brute_components(texts_of(docs))
        left = ngram_join.one_of_each(docs)
        # Every row is a document of its own here: of a group the smallest id stays, once; texts without words all stay.
        texts = texts_of(docs)
        groups = {}
        for k, size, c in brute_components([(k, t) for k, (_, t) in enumerate(texts)]):
            groups.setdefault(c if size else (c, k), []).append((texts[k][0] is None, texts[k][0] or 0, k))
        assert left.columns == docs.columns and collected(left, "doc_id") == sorted(((texts[min(g)[2]][0],) for g in groups.values()), key=repr)
        assert ngram_join.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("paired", [2, ngram_join.PAIRED])
def test_join_of_sets_of_many_sizes(spark, monkeypatch, paired):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    rng = random.Random(23)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 8, 12, 30, 80, 200]))]
        for _ in range(rng.choice([2, 4, 12])):
            start, short = (rng.randrange(0, len(base) // 4 + 1) for _ in "ab")
            words = base[start : len(base) - short * rng.choice([0, 0, 1])]
            for _ in range(rng.randrange(0, 2 + len(base) // 40)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            rows.append((len(rows), " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(ngram_join.near_duplicates(table), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_sets_that_cannot_link_share_no_cluster(spark):
    # Each set shares one element with each of its 28 neighbours in a ring, so that all of them hang together.
    ring, reach = 3000, 14
    rows = [(k, 10 * k, 2 * reach, ring * step + (k - step * back) % ring) for k in range(ring) for step in range(1, reach + 1) for back in (0, 1)]
    schema = "c long, fa long, n long, g long"
    elements = spark.createDataFrame(rows, schema)
    assert ngram_join.clustered(elements).count() == 0
    # Two of them with a copy that lacks one element are a cluster each.
    more = [(ring + k, 7, 2 * reach - 1, g) for k in (5, 900) for c, _, _, g in rows if c == k and g != ring + k]
    found = ngram_join.clustered(elements.unionByName(spark.createDataFrame(more, schema)))
    assert {(r.cluster, r.c) for r in found.collect()} == {(5, 5), (5, ring + 5), (900, 900), (900, ring + 900)}


def test_trie_links_are_those_of_all_pairs():
    rng = random.Random(1)
    for _ in range(60):
        kinds = rng.choice([20, 60, 200])
        bases = [rng.sample(range(kinds), rng.randint(5, min(kinds, 40))) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(1, 25)):
            own = set(rng.choice(bases))
            for _ in range(rng.randint(0, 5)):
                own.add(rng.randrange(kinds))
            sets.append(np.array(sorted(own)))
        full = np.array([len(s) + rng.randint(0, 2) for s in sets])
        trie = ngram_join.Trie(sets, full)
        for k, own in enumerate(sets):
            shared = [len(set(own.tolist()) & set(s.tolist())) for s in sets]
            want = [j for j, o in enumerate(shared) if 100 * o >= 75 * (full[k] + full[j] - o)]
            assert sorted(trie.linked(own, int(full[k]), kinds)) == want


def test_only_probes_that_may_link_go_down_a_trie():
    rng = random.Random(8)
    passed = 0
    for _ in range(80):
        base = rng.sample(range(50, 90), rng.randint(4, 30))
        sets = [sorted((set(base) - set(rng.sample(base, rng.randint(0, len(base) // 3)))) | set(rng.sample(range(50), rng.randint(0, 6)))) for _ in range(rng.randint(1, 15))]
        full = np.array([len(s) + rng.randint(0, 1) for s in sets])
        asking = np.array([rng.random() < 0.5 for _ in sets])
        offsets = np.cumsum([0, *map(len, sets)])
        found = ngram_join.hopeful(np.concatenate(sets), offsets, full, asking)
        linked = [any(100 * len(set(a) & set(b)) >= 75 * (full[j] + full[k] - len(set(a) & set(b))) for k, b in enumerate(sets) if not asking[k]) for j, a in enumerate(sets)]
        assert not (found & ~asking).any() and all(found[k] for k in range(len(sets)) if asking[k] and linked[k])
        passed += int(found.sum())
    assert passed
    apart = np.concatenate([[0, *range(100 * k, 100 * k + 27)] for k in range(1, 5)])
    assert not ngram_join.hopeful(apart, np.arange(5) * 28, np.full(4, 28), np.array([True, False, True, False])).any()


def test_documents_of_few_entries_take_few_bytes():
    rng = np.random.default_rng(4)
    for n, entries in [(1, 0), (1, 1), (3, 3), (700, 5), (30_000, 40), (32_768, 1), (300, 300), (2, 70_000), (30_000, 29_000)]:
        docs = np.sort(rng.integers(0, n, entries))
        raw = ngram_join.counts_of(np.append(docs, [n, n]), n)
        assert ngram_join.from_counts(raw, entries + 2).tolist() == [*docs.tolist(), -1, -1]
        assert len(raw) <= max(entries + n // 255, 0 if entries < n else 4 * n) + 1


def test_slices_are_large(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2500)) for _ in range(100)] * 2
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sent = ngram_join.send(table, 5, 8).groupBy((F.col("bucket") < 0).alias("own")).agg(F.count("*").alias("rows"))
    assert collected(sent, "own", "rows") == [(False, 8), (True, 1)]  # 3.9 MB of texts


def test_one_row_of_each_text_stays(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, one), (2, one), (2, two), (None, one), (3, three), (3, three), (4, None), (4, None), (5, ""), (None, None), (None, three + " end"), (6, "x y")]
    table = spark.createDataFrame([(i, t, "k", k, k, 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, text_key string, times int, row int, component int")
    kept = ngram_join.one_of_each(table)
    assert kept.columns == table.columns
    found = collected(kept, "doc_id", "text")
    assert found == sorted([(1, one), (2, two), (3, three), (4, None), (4, None), (5, ""), (None, None), (6, "x y")], key=repr)
    nameless = spark.createDataFrame([(None, one), (None, one), (None, two)], "doc_id long, text string")
    assert collected(ngram_join.one_of_each(nameless), "text") == sorted([(one,), (two,)])
    assert ngram_join.one_of_each(table.limit(0)).count() == 0


# --- 8 toxicity ---


def test_disguised_words_are_restored(spark):
    plain = spark.createDataFrame([(i, "the idiot said stupid things about the moron and other people in the house " * 20) for i in range(20)], "doc_id long, text string")
    model = toxicity.learn_characters(plain)
    for disguise, word in [("1d10t", "idiot"), ("idiooot", "idiot"), ("st.u.p.i.d", "stupid"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("i-d-i-o-t", "idiot")]:
        assert toxicity.suspicious(disguise) and word in toxicity.restore(model, [disguise])[0]
    assert not toxicity.suspicious("house") and not toxicity.suspicious("2024") and not toxicity.suspicious("x" * 500)
    asked = spark.createDataFrame([("1d10t",), ("house",), (None,)], "word string")
    assert {r.word: r.readings[0] for r in toxicity.deobfuscate(asked, model).collect()} == {"1d10t": "idiot", "house": "house", None: ""}


def channel_model(spark):
    plain = spark.createDataFrame([(i, "you are an idiot and full of shit said the moron in the house " * 20) for i in range(20)], "doc_id long, text string")
    return toxicity.learn_characters(plain)


def read_in(text, model):
    """All readings of all words of one text, the words as they are among them."""
    words = toxicity.Words(pa.array([text], pa.large_string()))
    return toxicity.restored(model, words.kinds, {})[0] + pc.utf8_trim(words.kinds, toxicity.EDGE).to_pylist()


def every_reading(model, word):
    """The cost of every path through a word's lattice, by its reading; the cheapest of equal readings."""
    log = lambda *x: float(model.log(*(np.array([ord(c)]) for c in x))[0])
    found = {}
    for path in itertools.product(*(toxicity.readings_of(*step) for step in toxicity.lattice(word))):
        text, value = "", 0.0
        for letters, cost in path:
            value += cost
            for x in letters:
                value, text = value + log(*("\0\0" + text)[-2:], x), text + x
        if len(text) >= 3:
            found[text] = max(found.get(text, -math.inf), value + log(*("\0\0" + text)[-2:], "\0"))
    return found


def test_decoder_finds_the_best_paths_of_all(spark):
    rng = random.Random(4)
    model = channel_model(spark)
    signs = "aeioustmdhl" * 3 + "".join(toxicity.CHANNEL) + toxicity.JOINTS
    words = ["".join(rng.choice(signs) * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(2, 7)))[:8] for _ in range(400)]
    for word, own in zip(words, toxicity.restore(model, words), strict=True):
        every = every_reading(model, word)
        assert len(own) == len(set(own)) and len(own) >= min(2, len(every))
        best = sorted(every.values(), reverse=True)
        assert all(abs(every[reading] - value) < 1e-9 for reading, value in zip(own[:2], best, strict=False)), word
        assert sorted((every[r] for r in own), reverse=True) == [every[r] for r in own]


def test_short_runs_of_letters_are_read(spark):
    model = channel_model(spark)
    assert "ass" in toxicity.Words(pa.array(["you a s s there", "a", "s s"])).kinds.to_pylist()
    assert "hit" in read_in("s h i t h i t", model) or "shithit" in read_in("s h i t h i t", model)
    assert toxicity.Words(pa.array(["x x x", "a", "b"])).kinds.to_pylist() == ["x", "a", "b"]  # one letter only, and runs end with their text


def test_long_runs_and_words_are_read_whole(spark):
    model = channel_model(spark)
    run = " ".join("youarethehouse" * 5 + "1d10t" + "youarethehouse" * 5)
    assert any("idiot" in r for r in read_in(run, model))
    assert any("idiot" in r for r in read_in(".".join("youarethehouse" * 3 + "idiot" + "saidthehouse" * 3), model))
    assert any(r == "idiot" for r in read_in("i" * 40 + "diot", model))
    word = "".join(chr(ord("a") + i * 7 % 26) for i in range(313))
    parts = toxicity.windows(word)
    assert all(any(word[k : k + toxicity.LONGEST] in p for p in parts) for k in range(len(word)))


def test_signs_at_the_ends_are_read_both_ways(spark):
    model = channel_model(spark)
    for disguise, word in [("sh!+", "shit"), ("!d!0t", "idiot"), ('"sh!+!".', "shit"), ("s h ! t", "shit"), ("! d i 0 t", "idiot"), ("m0ron!", "moron")]:
        assert word in read_in(f"the {disguise} house", model), disguise
    asked = spark.createDataFrame([("sh!+",)], "word string")
    assert "shit" in toxicity.deobfuscate(asked, model).first().readings


def test_words_of_few_or_doubled_letters_are_decoded(spark):
    model = channel_model(spark)
    for disguise, word in [("5h17", "shit"), ("1d107", "idiot"), ("5#17", None), ("4$$", None), ("iiddiioott", "idiot"), ("mm0r0nn", "moron")]:
        assert toxicity.suspicious(disguise) and (word is None or word in read_in(f"the {disguise} house", model)), disguise
    assert not toxicity.suspicious("1234567") and not toxicity.suspicious("3.14")
    assert {"4$$", "ass"} <= set(read_in("4$$", model)) and "house" in read_in("house", model)


def test_toxicity_of_disguised_texts(spark, docs, nothing):
    rng = random.Random(9)
    clean = ["river", "house", "garden", "window", "people", "summer", "letter", "market", "morning", "evening"]
    bad = ["idiot", "moron", "stupid"]
    rows = [(i, " ".join(rng.choice(clean) for _ in range(rng.randrange(5, 60))) + (" " + " ".join(rng.choice(bad) for _ in range(4)) if i % 4 == 0 else "")) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.learn(table, labels, "toxic", F.lit(True))
    asked = [(1, "river house garden 1d10t window m0ron letter st.u.p.i.d"), (2, "i d i o t people of s t u p i d summer market"), (3, "river house garden window people"), (4, None), (5, "")]
    found = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert found[1] >= 0.7 and found[2] >= 0.7 and max(found[3], found[4], found[5]) < 0.5
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(nothing, model).count() == 0
    none = toxicity.learn(nothing, labels.limit(0), "toxic", F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


# --- 9 decontamination ---


def brute_leaks(texts, items, size=10):
    cut = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c > "\x7f" or c.isdigit() or "a" <= c <= "z" else " " for c in t or "").split(" ") if w]
    out = []
    for name, text in texts:
        words, hit, found = cut(text), set(), set()
        for item, body in items:
            own = cut(body)
            n = min(size, len(own))
            for k in range(len(own) - n + 1) if own and item is not None else []:
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out.append((name, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_leaks_against_brute_force(spark, docs, nothing):
    texts = texts_of(docs)
    long = next(t for n, t in texts if n == 10).split()
    items = [(1, " ".join(long[100:130])), (2, "ONE, two"), (3, "never seen anywhere in any of these texts at all really"), (4, None), (5, " !! "), (None, "one two"), (2, "one two"), (6, " ".join(long[2990:]) + " end"), (7, "テキスト 😀")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, len int")
    found = decontaminate.decontaminate(docs, bench)
    assert collected(found, "doc_id", "n_words", "n_hit", "items") == brute_leaks(texts, items)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert collected(clean, "doc_id") == sorted(((n,) for n, _, h, _ in brute_leaks(texts, items) if h == 0), key=repr)
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(nothing, bench).count() == 0


def test_proximity_matches(spark):
    table = spark.createDataFrame([(1, "the rare fox jumps over one odd dog"), (2, "rare " + "the " * 30 + "odd"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the odd the rare the"), (2, "the"), (3, None)], "item_id long, text string")
    assert collected(decontaminate.proximity_matches(table, bench, slop=10), "doc_id", "item_id") == [(1, 1)]


def brute_near(texts, items, slop):
    counts = collections.Counter(w for _, words in texts for w in words)
    out = set()
    for item, body in items:
        two = sorted((counts[w], w) for w in set(body) if counts[w])[:2]
        for name, words in texts:
            out |= {(name, item, p, q) for p, x in enumerate(words) for q, y in enumerate(words) if len(two) == 2 and x == two[0][1] and y == two[1][1] and abs(p - q) <= slop}
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_intersected_lists_against_brute_force(spark, seed):
    """Few different words, so that windows repeat within a text, overlap, and meet on many shifts."""
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcde") for _ in range(n)]
    texts = [(i, text(rng.randrange(60))) for i in range(20)]
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)] + [(12, ["a"]), (13, ["b", "b", "b"]), (14, ["a", "unseen", "b"]), (15, texts[3][1][2:12])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontaminate.decontaminate(table, bench, size=4, slop=3)
    assert collected(found, "doc_id", "n_words", "n_hit", "items") == brute_leaks([(i, " ".join(w)) for i, w in texts], [(i, " ".join(w)) for i, w in items], 4)
    near = brute_near(texts, [i for i in items if i[1]], 3)
    assert collected(decontaminate.proximity_matches(table, bench, slop=3), "doc_id", "item_id", "first", "second") == sorted(near, key=repr)
    names = {i: sorted({str(item) for name, item, _, _ in near if name == i}) for i, _ in texts}
    assert {r.doc_id: r.near for r in found.collect()} == names


# --- 10 token counts ---


def brute_tokens(word, pieces):
    longest, at, n = max(map(len, pieces)), 0, 0
    while at < len(word):
        for k in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + k] in pieces:
                at, n = at + k, n + 1
                break
        else:
            n += len(word[at].encode())
            at += 1
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(13)
    for _ in range(100):
        pieces = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 20))}
        words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 90))) for _ in range(30)]
        found = token_counts.Automaton(sorted(pieces)).count_words(pa.array(words, pa.large_string()))
        assert found.tolist() == [brute_tokens(w, pieces) for w in words]


def test_token_counts_of_documents(docs, nothing):
    pieces = token_counts.load_pieces()
    known = set(pieces)
    want = []
    for name, text in texts_of(docs):
        words = [w for w in __import__("re").split(r"[\x09-\x0D ]+", text or "") if w]
        want.append((name, len(words), sum(brute_tokens(token_counts.WORD_START + w, known) for w in words)))
    assert collected(token_counts.count_tokens(docs, pieces), "doc_id", "n_words", "n_tokens") == sorted(want, key=repr)
    assert token_counts.count_tokens(nothing, pieces).count() == 0


def test_texts_are_encoded_and_rows_made_in_slices(monkeypatch):
    """Slices give the same ids as one; what is derived from a text at once is bounded by a slice, not by a block."""
    with open(packing.VOCABULARY, "rb") as file:
        ranks = file.read()
    rng = random.Random(5)
    texts = pa.array(["".join(rng.choice(["word ", "é ", "12, ", "\n", "don't ", ""]) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", "x" * 5000])
    whole = packing.Coder(ranks).encode(texts, packing.END_OF_TEXT)
    monkeypatch.setattr(packing, "SLICE_BYTES", 700)
    seen = []
    one = packing.Coder.encode_slice
    monkeypatch.setattr(packing.Coder, "encode_slice", lambda self, part, end: seen.append(part) or one(self, part, end))
    sliced = packing.Coder(ranks).encode(texts, packing.END_OF_TEXT)
    assert all(a.tolist() == b.tolist() for a, b in zip(whole, sliced, strict=True))
    assert pa.concat_arrays(seen).equals(texts) and all(len(p) == 1 or pc.sum(pc.binary_length(p)).as_py() <= 700 for p in seen)
