"""WARC archives, lexical search and whitening against brute force on small tables of every odd kind."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import lexical_search, warc, whitening

# --- 11 WARC ---

PAGES = "page_id long, url string, html string, payload string, digest int, first long, n int"


@pytest.fixture(scope="module")
def pages(spark):
    """Repeated, null, empty and long pages; the last columns have names that the operator uses itself."""
    html = "<html>schön\r\n\r\nWARC/1.0\r\n" + "x" * 500
    rows = [(5, "http://a/ b\r\nc", html), (3, None, html), (9, "http://b", html), (4, "u", None), (2, "u", ""), (7, "u", ""), (8, "v", "ab"), (10, "w", "ab")]
    rows += [(11, "x", "é" * 3_000_000), (12, "x", "one"), (12, "x", "one"), (None, "y", "two"), (13, "y", "two"), (None, "z", "alone"), (14, "WARC/1.1", "\x1f\x8b\x08 <")]
    return spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], PAGES)


def base32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected_pages(rows, least):
    groups = {}
    for r in rows:
        groups.setdefault(r.html or "", []).append(r.page_id)
    found = []
    for r in rows:
        text = r.html or ""
        first = min((i for i in groups[text] if i is not None), default=None)
        again = len(groups[text]) > 1 and r.page_id != first and len(text.encode()) >= least
        found.append((r.page_id, len(text.encode()), base32(text), "revisit" if again else "response", first if again else None))
    return sorted(found, key=repr)


@pytest.mark.parametrize("least", [0, 3])
def test_archives_round_trip(spark, pages, tmp_path, least):
    path = f"{tmp_path}/archives"
    warc.write_archives(pages.repartition(3), path, least)
    read = warc.read_archives(spark, path)
    found = [tuple(r) for r in warc.pages_of(read, "bigint").collect()]
    assert sorted(found, key=repr) == expected_pages(pages.collect(), least)
    assert read.filter("gap is not null").count() == 0
    payloads = {r.html or "" for r in pages.collect()}
    assert {bytes(r.payload).decode() for r in read.filter("record_type = 'response'").collect()} == payloads
    # Any gzip reader takes the files, and the records cover every byte but the separators.
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") for f in (tmp_path / "archives").glob("*.txt")) == pages.count()


def test_archives_of_nothing_and_of_text_keys(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0
    odd = spark.createDataFrame([("a b/%>é+", "x"), ("a", "x"), ("", "y")], "page_id string, html string")
    warc.write_archives(odd, f"{tmp_path}/odd")
    found = warc.pages_of(warc.read_archives(spark, f"{tmp_path}/odd"), "string").select("page_id", "refers_to").collect()
    assert sorted(map(tuple, found), key=repr) == [("", None), ("a b/%>é+", "a"), ("a", None)]


def made(n, plain=False):
    raw = [warc.record(i, f"http://h/{i}", bytes(random.Random(i).randbytes(300 + i)), None, False, "2020-01-01T00:00:00Z") for i in range(n)]
    return raw if plain else [warc.member(r) for r in raw]


@pytest.mark.parametrize("plain", [True, False])
def test_salvage_finds_all_other_records_and_names_each_gap(plain):
    parts = made(12, plain)
    starts = np.concatenate([[0], np.cumsum([*map(len, parts)])])
    rng = random.Random(1)
    for _ in range(150):
        hit = sorted(rng.sample(range(12), rng.randrange(1, 4)))
        data = bytearray(b"".join(parts))
        for k in hit:
            at = rng.randrange(starts[k], starts[k + 1])
            data[at] ^= 1 << rng.randrange(8)
        found = [*warc.salvage(bytes(data))]
        records = [r for r in found if isinstance(r, warc.Record)]
        ids = {int(r.fields["warc-record-id"][10:-1]) for r in records if re.fullmatch(r"<urn:page:\d+>", r.fields.get("warc-record-id", ""))}
        assert set(range(12)) - set(hit) <= ids
        # Records and gaps cover the archive without overlap.
        spans = sorted([(r.offset, r.offset + r.length) for r in records] + [r[:2] for r in found if not isinstance(r, warc.Record)])
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_salvage_of_cut_inserted_and_foreign_bytes(spark, tmp_path):
    parts, raw = made(4), made(4, True)
    whole = b"".join(parts)
    assert [*warc.salvage(b"")] == []
    assert [*warc.salvage(b"no archive")] == [(0, 10, "no version line or no end of the fields")]
    cut = [*warc.salvage(whole[:-5])]
    assert len(cut) == 4 and cut[-1][:2] == (len(whole) - len(parts[3]), len(whole) - 5) and "cut off" in cut[-1][2]
    junk = b"\x00junk\x1f\x8b\x08" * 9
    inside = [*warc.salvage(parts[0] + junk + parts[1])]
    assert inside[1][:2] == (len(parts[0]), len(parts[0]) + len(junk)) and inside[2].payload_bytes == 301
    assert sum(isinstance(r, warc.Record) for r in warc.salvage(warc.member(b"".join(raw)) + raw[0] + parts[1])) == 6
    wrong = raw[0].replace(b"Content-Length: 300\r\n\r\n", b"Content-Length: 300\r\n\r\n\x00", 1)[:-5] + b"\r\n\r\n"
    assert [r[2] for r in warc.salvage(warc.member(wrong) + parts[1]) if not isinstance(r, warc.Record)] == ["warc-block-digest differs"]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + junk + parts[1])
    read = warc.read_archives(spark, str(tmp_path))
    warc.log_gaps(read, f"{tmp_path}/log/gaps")
    logged = spark.read.json(f"{tmp_path}/log/gaps").collect()
    assert [(r.offset, r.length) for r in logged] == [(len(parts[0]), len(junk))]


# --- 12 lexical search ---

TEXTS = "doc_id long, text string, key string, n long, score long, part int, row long, terms string"


def brute_force(docs, items, best=10):
    split = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(split(t)), len(split(t))) for i, t in docs if split(t)]
    words, n = sum(x[2] for x in held), len(held)
    df = Counter(t for _, c, _ in held for t in c)
    found = []
    for item, text in items:
        asked = Counter(split(text))
        scored = []
        for i, c, length in held:
            m = 100 - 75 + (75 * length * n) // words
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        found += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:best], 1)]
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["the", "a1", "Été", "日本", "x_y", "ein", "Wort", "of", "q9", "rare"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([6, 20, 50])]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 30, 300]))) for i in range(150)] + [(200 + i, "the same text of the copies") for i in range(30)]
    docs += [(7, "repeated id"), (None, "the same text of the copies"), (None, None), (400, ""), (401, " \n- "), (402, text(20000))]
    items = [(i, text(rng.choice([1, 4, 15, 60]))) for i in range(25)] + [(3, "repeated item the"), (50, None), (51, "..."), (None, "rare w1"), (52, "nowhere"), (53, "The the THE same"), (54, text(3000))]
    return docs, items


@pytest.mark.parametrize("parts", [1, 7])
def test_search_is_exact(spark, corpus, parts, monkeypatch):
    docs, items = corpus
    table = spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, "t") for i, t in docs], TEXTS).repartition(parts)
    asked = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    assert sorted(map(tuple, lexical_search.search(table, asked).collect()), key=repr) == brute_force(docs, items)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 400)
    assert sorted(map(tuple, lexical_search.search(table, asked, best=3).collect()), key=repr) == brute_force(docs, items, 3)


def test_search_of_nothing(spark, corpus):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert lexical_search.search(docs, none).count() == 0
    asked = spark.createDataFrame([("a", "a b"), ("b", "a")], "item_id string, text string")
    assert lexical_search.search(docs.limit(0), asked).count() == 0
    assert sorted(map(tuple, lexical_search.search(docs, asked).collect())) == brute_force([(1, "a"), (2, None)], [("a", "a b"), ("b", "a")])


def test_pieces_of_a_long_text_count_the_same(monkeypatch):
    import pyarrow as pa

    texts, vocabulary = pa.array(["ab cd ab" * 50, "", "x" * 100, "cd " * 40 + "ab"]), pa.array(["ab", "cd", "abab"], pa.large_string())
    whole = lexical_search.counted(texts, vocabulary)
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 7)
    assert all((a == b).all() for a, b in zip(whole, lexical_search.counted(texts, vocabulary), strict=True))


# --- 13 whitening ---


def check_whitening(rows, found, most=16):
    kept = [(i, np.array([math.floor(64 * c) + 1000000 for c in v])) for i, v in rows]
    x = np.array([v for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(most, int((values > values[0] * 1e-12).sum()))
    expected = ((n * x - sums) / n) @ vectors[:, :count] / np.sqrt(values[:count])
    table = {}
    for r in found:
        table.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(found) == len(kept) * count and all(r.n == n and r.identity_error < 1e-9 for r in found)
    for c in range(count):
        own = sorted((r.vec_id or -1, r.deviation, r.whitened, r.explained) for r in found if r.component == c + 1)
        wanted = [(i or -1, int(((n * v - sums) ** 2).sum()), y) for (i, v), y in zip(kept, expected[:, c], strict=True)]
        sign = np.sign(sum(a[2] * b[2] for a, b in zip(own, sorted(wanted), strict=True)))
        wanted = sorted((i, d, y * sign) for i, d, y in wanted)
        assert [a[:2] for a in own] == [b[:2] for b in wanted]
        assert max(abs(a[2] - b[2]) for a, b in zip(own, wanted, strict=True)) < 1e-8
        assert all(abs(a[3] - values[c] / np.trace(covariance)) < 1e-9 for a in own)


VECTORS = "vec_id long, embedding array<float>, key string, x int, n long, number int"


@pytest.mark.parametrize("dims", [3, 24])
def test_whitening_is_exact(spark, dims, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 7 * dims)
    rng = np.random.default_rng(dims)
    vectors = (rng.normal(size=(120, dims)) * np.linspace(3, 0.2, dims)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(500 + i, vectors[0].tolist()) for i in range(60)] + [(3, vectors[4].tolist()), (None, vectors[5].tolist())]
    odd = [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [float("inf")] + [0.0] * (dims - 1)), (904, []), (905, [1.0])]
    table = spark.createDataFrame([(i, v, "k", 1, 2, 3) for i, v in rows + odd], VECTORS).repartition(4)
    check_whitening(rows, whitening.whiten(table).collect())


def test_whitening_without_variance(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(table.limit(0)).count() == whitening.whiten(table).count() == 0
    rows = [(i, [float(i % 7), 5.0, 2.0 * (i % 7)]) for i in range(40)]  # one direction only
    check_whitening(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit(1))).count() == 40
