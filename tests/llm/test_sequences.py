"""Encoding, periodic runs and importance resampling: against the public library and brute force, and on odd rows."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stavelake.llm import bpe, importance, periodic_runs, queries

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def odd_rows(prose):
    return [(None, prose(1), "a"), (1, None, "a"), (2, "", None), (3, prose(2), None), (3, prose(2), None), (4, prose(2), "b"), (5, "one two", "b"), (6, prose(3, 30_000), "a")]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def tables(spark, path, docs, bench=((1, "x"),)):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


# -- byte-pair encoding ----------------------------------------------------------------------------
TEXTS = [
    "Hello  World's 'quoted' don't WE'LL 12345 cafe\u0301 CAFÉ ΣΊΣΥΦΟΣ Straße İstanbul ﬁne", "<|endoftext|>a<|startoftext|><|endoftext|> <|ENDOFTEXT|>",
    "日本語のテキスト 한국어 العربية עברית हिन्दी ไทย", "👩‍👩‍👧‍👦 emoji 🏳️‍🌈!!! ***___###", "\x00\x1c\x1f\x85\u00a0\u2028\u3000end", "a" * 5000, "ab" * 3000,
    "\u088f\u1c89\ua7dc unassigned \U00010d50 letters", "x\ny\tz\r\nw", " ", "'", "''s't", "é" * 999, "\ud7ff\ue000\uffff\U0010ffff",
]


def test_bpe_equals_the_library(spark, prose):
    rng = random.Random(5)
    alphabet = "abcdeé'ßΣ12 <|>\n\u0301\u3042!?" + "".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(40))
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + [prose(i, 50) for i in range(20)]
    library = Tokenizer.from_file(VOCABULARY)
    vocabulary = bpe.shared(spark, VOCABULARY)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    df = df.select("i", bpe.encode(df["text"], vocabulary).alias("ids"))
    rows = df.select("i", bpe.unpacked(df["ids"]).alias("list"), bpe.decode(df["ids"], vocabulary).alias("decoded"), bpe.n_tokens(df["ids"]).alias("n")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r["i"]], add_special_tokens=False).ids
        assert r["list"] == want and r["n"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_bpe_single_code_points():
    """The front end and the merges agree with the library on every assigned or unassigned character."""
    vocabulary, library = bpe.Vocabulary.read(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}1{c}a{c} " for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert vocabulary.encode(text) == struct.pack(f"<{len(want.ids)}I", *want.ids)


def test_bpe_query_and_odd_rows(spark, documents, prose, tmp_path):
    rows = odd_rows(prose)
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False))] += 1
    df = queries.op11_bpe(spark, tables(spark, tmp_path / "a", documents(rows, clash=True)))
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, df.collect())) == want
    assert queries.op11_bpe(spark, tables(spark, tmp_path / "b", documents([]))).count() == 0


def test_bpe_forgets_and_refuses(tmp_path, monkeypatch):
    vocabulary = bpe.Vocabulary.read(VOCABULARY)
    whole = vocabulary.encode("some words to be encoded twice")
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    vocabulary = bpe.Vocabulary.read(VOCABULARY)
    for _ in range(3):
        assert vocabulary.encode("some words to be encoded twice") == whole
    assert len(vocabulary.by_stretch) <= 2
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(bpe, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(VOCABULARY)


# -- periodic runs ---------------------------------------------------------------------------------
def brute_runs(words, least=6, exponent=4):
    """Compares the words with themselves shifted by every period; the smallest period of a stretch is met last."""
    names = {w: i for i, w in enumerate(words)}
    ids, best = np.array([names[w] for w in words], np.int32), {}
    for p in range(len(words) // exponent, 0, -1):
        same = np.flatnonzero(np.diff(np.concatenate([[False], ids[p:] == ids[:-p], [False]]).astype(np.int8)))
        for i, j in zip(same[::2].tolist(), same[1::2].tolist()):
            if j + p - i >= max(least, exponent * p):
                best[i, j + p] = p
    return sorted((s, e - s, p) for (s, e), p in best.items())


def brute_collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plant(doc_id, words):
    h = crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("chunk", [40, 1 << 18])
def test_runs_match_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
    monkeypatch.setattr(periodic_runs, "SLICE", 64)
    rng = random.Random(3)
    texts = []
    for k in range(300):
        words = []
        while len(words) < rng.randrange(1, 120):
            piece = [rng.choice("abcd"[: 1 + k % 4]) for _ in range(rng.randrange(1, 9))]
            words += piece * rng.choice([1, 1, 2, 4, 5, 9]) + piece[: rng.randrange(len(piece))]
        texts.append(words)
    texts += [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 400, ["a", "b"] * 200, (["a", "b"] * 5 + ["c"]) * 9]
    for least, exponent in ((6, 4), (2, 2), (9, 3)):
        for chunk_of in periodic_runs._chunks([" ".join(t).encode() for t in texts]):
            got = list(periodic_runs._searched(chunk_of, least, exponent))
            for data, (start, length, period, kept) in zip(chunk_of, got):
                words = data.decode().split()
                want = brute_runs(words, least, exponent)
                assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want
                assert kept == brute_collapsed(words, want)


def test_extensions_match_comparison():
    rng = random.Random(8)
    for size, letters in ((50, 2), (400, 2), (3000, 3)):
        text = [rng.randrange(letters) for _ in range(size)]
        text += text[: size // 2] + [0] * 70 + text[size // 3 :] + [1, 0] * 40
        symbols = np.array([0, *(c + 2 for c in text), 1])
        levels = periodic_runs.compressed(symbols, 2)
        back = [level.mirrored() for level in levels]
        x = np.array([rng.randrange(1, len(text)) for _ in range(300)])
        y = np.array([rng.randrange(a + 1, len(text) + 1) for a in x])
        whole = symbols.tolist()
        for a, b, ahead, behind in zip(x.tolist(), y.tolist(), periodic_runs.extensions(levels, x, y).tolist(), periodic_runs.extensions(back, len(whole) - y, len(whole) - x).tolist()):
            assert ahead == next(k for k in range(len(whole)) if whole[a + k] != whole[b + k])
            assert behind == next(k for k in range(len(whole)) if whole[a - 1 - k] != whole[b - 1 - k])


def test_runs_query_and_odd_rows(spark, documents, prose, tmp_path):
    rows = odd_rows(prose) + [(100 + i, prose(i, 30 + i), "s") for i in range(120)] + [(300, "x " * 900, "s"), (301, "a b c " * 50 + "d d d d d d d", "s")]
    want = Counter()
    for doc_id, text, _ in rows:
        words = plant(doc_id, SPACES.findall(text or ""))
        found = brute_runs(words)
        top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want[(doc_id, len(found), *best, sha("".join("%d,%d,%d\n" % r for r in found)), sha(brute_collapsed(words, found)))] += 1
    df = queries.op12_periodic_runs(spark, tables(spark, tmp_path / "a", documents(rows, clash=True)))
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, df.collect())) == want
    assert sum(n for row, n in want.items() if row[1]) > 8
    assert queries.op12_periodic_runs(spark, tables(spark, tmp_path / "b", documents([]))).count() == 0


# -- importance resampling -------------------------------------------------------------------------
def brute_resampled(docs, bench, buckets=10_000, percent=25):
    def grams(text):
        found = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        return found, [crc32(g) % buckets for g in found + [a + b" " + b for a, b in zip(found, found[1:])]]

    raw, target = Counter(), Counter()
    for text in docs:
        raw.update(grams(text[1])[1])
    for _, text in bench:
        target.update(grams(text)[1])
    S, T = sum(raw.values()), sum(target.values())
    rows = []
    for doc_id, text in docs:
        found, hashed = grams(text)
        gain = [math.floor(1000 * math.log((target[b] + 1.0) * (S + buckets) / ((raw[b] + 1.0) * (T + buckets)))) for b in hashed]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        rows.append((doc_id, len(hashed), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(found) >= 20))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    last = percent * len(order) // 100
    return Counter([(*r[:4], k + 1 if k < last else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in rows if not r[4]])


def test_resampling_query_matches_brute_force(spark, documents, prose, tmp_path):
    bench = [(1, prose(1, 60)), (2, prose(5, 300)), (3, None), (4, "")]
    rows = odd_rows(prose) + [(50 + i, prose(i % 40, 5 + i % 60) + " Ünïcode A-b_c 3,14", "s") for i in range(400)]
    sf = tables(spark, tmp_path / "a", documents(rows, clash=True).repartition(7), bench)
    df = queries.op13_importance_resampling(spark, sf)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, df.collect())) == brute_resampled([r[:2] for r in rows], bench)
    empty = queries.op13_importance_resampling(spark, tables(spark, tmp_path / "b", documents([]), bench))
    assert empty.count() == 0
    alone = queries.op13_importance_resampling(spark, tables(spark, tmp_path / "c", documents(rows), []))
    assert Counter(map(tuple, alone.collect())) == brute_resampled([r[:2] for r in rows], [])


def test_ranks_with_ties_and_few_samples(spark, monkeypatch):
    monkeypatch.setattr(importance, "SAMPLES", 64)
    rng = random.Random(2)
    rows = [(None if i % 50 == 0 else 7 if i % 3 == 0 else i, rng.randrange(4) if i % 3 else 2, i % 7 > 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, score long, may boolean").repartition(9)
    ranks, n = importance.ranked(df, "may")
    got = [tuple(r) for r in ranks.collect()]
    assert n == sum(r[2] for r in rows) and Counter(r[:2] for r in got) == Counter(r[:2] for r in rows)
    placed = sorted((r[2], -r[1], r[0] is None, r[0] or 0) for r in got if r[2] is not None)
    assert [r[0] for r in placed] == list(range(1, n + 1))
    assert [r[1:] for r in placed] == sorted(r[1:] for r in placed)


def test_resampling_keeps_columns(documents, prose, spark):
    df = documents([(i, prose(i, 30), "s") for i in range(20)], clash=True).selectExpr("*", "7 AS Rank", "8 AS importance_may", "9 AS rank_place", "10 AS `a.b`")
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    out = importance.drawn(df, bench)
    assert out.columns == [c for c in df.columns if c != "Rank"] + ["n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] for r in out.collect()) == [1, 2, 3, 4, 5]
    assert {r["importance_may"] for r in out.collect()} == {8}
