"""Document operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from stavelake.llm import decontaminate, license_scan, line_dedup, quality_rules, simhash_dedup, source_mix, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def odd_rows(prose):
    return [(None, prose(1), "a"), (1, None, "a"), (2, "", None), (3, prose(2), None), (3, prose(2), None), (4, prose(2), "b"), (5, "one two", "b"), (6, prose(3, 30_000), "a")]


# -- suffix dedup ----------------------------------------------------------------------------------
def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            gram = data[p : p + length]
            if gram in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(gram)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[doc_id] = (spans, bytes(b for b, g in zip(data, gone) if not g))
    return out


def suffix_results(df):
    return {r["doc_id"]: ([(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.deduplicated(df).collect()}


def test_suffix_dedup_matches_brute_force(documents, prose, monkeypatch):
    passage = prose(50, 60)
    docs = [(i, prose(100 + i, 60) + " " + (passage if i % 2 else passage[: 90 + i]) + " é" * (i % 3) + prose(i % 4, 40), "s") for i in range(40)]
    docs += [(50, "a" * 700, "s"), (51, "ab" * 300 + "a" * 300, "s"), (52, docs[3][1], "s"), (53, "x" * 99, "s"), (54, "", "s"), (55, None, "s")]
    want = brute_repeats([(i, t) for i, t, _ in docs])
    assert suffix_results(documents(docs)) == want
    assert any(spans for spans, _ in want.values())


def test_suffix_dedup_segments_and_hot_contexts(prose):
    """Phrases cut at a segment's end and right contexts that are only marked give the same classes."""
    import numpy as np

    data = (prose(7, 3000) * 2).encode()
    whole = suffix_dedup.triggers(data)
    parts = []
    for at, part in suffix_dedup.segments(data):
        first, n, _, _ = suffix_dedup.phrases(part)
        parts.append((first + at, n))
    starts = np.concatenate([np.arange(a, a + b) for f, n in parts for a, b in zip(f, n)])
    assert (starts == np.arange(len(whole))).all()


def test_suffix_dedup_many_phrases_of_one_context(documents, prose, monkeypatch):
    passage = prose(9, 40)
    docs = [(i, prose(200 + i, 25) + passage + prose(300 + i, 25), "s") for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "MOST_PHRASES", 2)
    assert suffix_results(documents(docs)) == brute_repeats([(i, t) for i, t, _ in docs])


def test_suffix_dedup_odd_rows(documents, prose):
    rows = suffix_dedup.deduplicated(documents(odd_rows(prose), clash=True)).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append((r["n_bytes"], r["n_removed"], bytes(r["kept"])))
    assert len(rows) == 8
    assert by_id[1] == [(0, 0, b"")] and by_id[2] == [(0, 0, b"")]
    assert len(set(by_id[3])) == 1 and by_id[3][0][1] == 0  # equal rows are one text
    assert by_id[4][0][2] == b""  # the copy goes
    assert by_id[None][0][1] == 0
    assert suffix_dedup.deduplicated(documents([])).count() == 0


# -- decontamination -------------------------------------------------------------------------------
def brute_leaks(docs, items):
    words = lambda t: (t or "").lower().encode().translate(decontaminate._TABLE).split()
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    out = {}
    for doc_id, text in docs:
        hashed = grams(words(text))
        for item_id, item in items:
            wanted = grams(words(item))
            n = len(wanted)
            for s in range(len(hashed) - n + 1 if n else 0):
                a, b = Counter(hashed[s : s + n]), Counter(wanted)
                shared = sum((a & b).values())
                similarity = shared / (2 * n - shared)
                if similarity >= 0.8 and (similarity, -s) > out.get((doc_id, item_id), (0, 0)):
                    out[doc_id, item_id] = (similarity, -s)
    return out


def leak_results(df, bench):
    return {(r["doc_id"], r["item_id"]): (r["similarity"], -r["start_word"]) for r in decontaminate.matches(df, bench).collect()}


def test_decontaminate_matches_brute_force(spark, documents, prose, monkeypatch):
    items = [(i, prose(500 + i, 12 + 3 * i)) for i in range(12)] + [(90, "short item"), (91, ""), (92, None)]
    docs = []
    for i in range(36):
        item = items[i % 12][1].split()
        if i >= 24:
            item[len(item) // 2] = "changed"  # five shingles of the item go
        if 12 <= i < 24:
            item = [w.upper() + "," for w in item[:-1]] + item[-1:]
        docs.append((i, prose(i, 40) + " " + " ".join(item) + ". " + prose(60 + i, 40), "s"))
    docs += [(90, "Short item!", "s"), (91, prose(91), "s"), (92, "", "s"), (93, None, "s"), (94, " ".join([items[4][1]] * 3), "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks([(i, t) for i, t, _ in docs], items)
    got = leak_results(documents(docs), bench)
    assert set(got) <= set(want)
    assert all(got[k] == want[k] for k in got)
    sure = {k for k, (s, _) in want.items() if s > 0.82}
    assert sure and sure <= set(got)
    monkeypatch.setattr(decontaminate, "ITEMS", 4)  # several blocks give the same
    assert leak_results(documents(docs), bench) == got


def brute_short_leaks(docs, items):
    """As ``brute_leaks`` for items longer than the document, which is then the window."""
    words = lambda t: (t or "").lower().encode().translate(decontaminate._TABLE).split()
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    out = {}
    for doc_id, text in docs:
        for item_id, item in items:
            a, b = grams(words(text)), grams(words(item))
            shared = (a & b).total()
            if a.total() < b.total() and 9 * shared >= 4 * (a.total() + b.total()):
                out[doc_id, item_id] = (shared / (a.total() + b.total() - shared), 0)
    return out


def test_decontaminate_compares_documents_shorter_than_an_item(spark, documents, prose):
    items = [(i, prose(700 + i, 56 - i)) for i in range(6)]
    docs = []
    for i, text in items:
        w = text.split()
        docs += [(10 * i, " ".join(w[:-1]), "s"), (10 * i + 1, " ".join(w[4:]), "s"), (10 * i + 2, " ".join(w[: len(w) * 3 // 5]), "s"), (10 * i + 3, prose(i, 50), "s")]
    docs += [(90, " ".join(items[0][1].split()[:3]), "s"), (91, "", "s"), (92, None, "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = [(i, t) for i, t, _ in docs]
    want = brute_leaks(pairs, items) | brute_short_leaks(pairs, items)
    assert len(want) == 12
    assert leak_results(documents(docs), bench) == want
    n_words = {r["doc_id"]: r["n_words"] for r in decontaminate.matches(documents(docs), bench).collect()}
    assert n_words[0] == 55 and n_words[1] == 52
    assert decontaminate.clean(documents(docs), bench).count() == len(docs) - 12


def test_decontaminate_loses_nothing_at_the_limit():
    """Windows of similarity 0.8 and a little more are found whatever their distance."""
    far = 0
    for i in range(600):
        item = [f"i{i}w{k}" for k in range(49)]
        window = [*item[:-5], *(f"x{i}w{k}" for k in range(5))]  # 40 of 45 shingles: 40 / 50
        found = decontaminate.Index([(i, " ".join(item).encode())]).hits(decontaminate.word_hashes(" ".join(["a b c", *window, "d e"]).encode()))
        best = {hit[0]: hit for hit in found}
        assert best[i][4] == pytest.approx(0.8)
        far += best[i][3] > decontaminate.RADIUS
    assert far


def test_decontaminate_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20)).encode()) for i in range(50)]
    index = decontaminate.Index(items)
    prints = []
    for p in index.prints.tolist():
        for distance in (0, 7, 15):
            flips = rng.choice(64, distance, replace=False)
            prints.append(p ^ sum(1 << int(b) for b in flips))
    found = index.candidates(np.array(prints, np.uint64), 16)
    brute = {(w, i, (p ^ int(q)).bit_count()) for w, p in enumerate(prints) for i, q in enumerate(index.prints.tolist()) if (p ^ int(q)).bit_count() <= 15}
    assert found == brute


def test_decontaminate_odd_rows(spark, documents, prose):
    bench = spark.createDataFrame([(7, " ".join(prose(2).split()[10:40])), (None, " ".join(prose(3, 30_000).split()[-30:]))], "item_id long, text string")
    df = documents(odd_rows(prose), clash=True)
    assert sorted((r["doc_id"], r["item_id"] or -1) for r in decontaminate.matches(df, bench).collect()) == [(3, 7), (3, 7), (4, 7), (6, -1)]
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == 4
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(df, empty).count() == 0 and decontaminate.clean(df, empty).count() == 8
    assert decontaminate.matches(documents([]), bench).count() == 0


# -- SimHash ---------------------------------------------------------------------------------------
def brute_classes(docs):
    prints = {}
    for doc_id, text in docs:
        words = [w.decode() for w in WORD.findall((text or "").encode().lower())]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        counts = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g, 42)
            for b in range(64):
                counts[b] += h >> b & 1
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (f"{prints[d]:016x}", find(d)) for d in prints}


def test_simhash_matches_brute_force(documents, prose):
    docs = []
    for i in range(30):
        base = prose(i % 10, 400).split()
        for k in range(i // 10):
            base[50 * k + i % 7] = f"edit{k}"
        docs.append((i, " ".join(base), "s"))
    docs += [(40, "", "s"), (41, None, "s"), (42, "  \n ", "s"), (43, "Word", "s"), (44, "wORD", "s"), (45, prose(3, 40_000), "s")]
    rows = simhash_dedup.classes(documents(docs, clash=True)).select("doc_id", "fp", "first.doc_id").collect()
    got = {r[0]: (f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in rows}
    assert got == brute_classes([(i, t) for i, t, _ in docs])


def test_simhash_tree_finds_every_link(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    values = set(base.tolist())
    for v in base.tolist():
        for _ in range(12):
            flips = rng.choice(64, int(rng.integers(1, 4)), replace=False)
            values.add(int(np.int64(np.uint64((v & (1 << 64) - 1) ^ sum(1 << int(b) for b in flips)).astype(np.int64))))
    values = sorted(values)
    edges = simhash_dedup.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert e["u"] in root and e["v"] in root
        root[find(e["u"])] = find(e["v"])
    bits = np.array(values).view(np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 2):
            assert find(v) == find(values[j])


def test_simhash_odd_rows(documents, prose):
    df = documents(odd_rows(prose), clash=True)
    kept = simhash_dedup.survivors(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 6), (True, None)]
    assert simhash_dedup.classes(documents([])).count() == 0 and simhash_dedup.survivors(documents([])).count() == 0


def brute_near(docs):
    sets = {}
    for doc_id, text in docs:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    first = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) and first[a] != first[b]:
                low, high = sorted((first[a], first[b]))
                first = {d: low if f == high else f for d, f in first.items()}
    return first


def near_docs(prose):
    passage, docs = prose(77, 30), []
    for i in range(60):
        base = prose(i % 12, 120 + i % 12).split()
        for k in range(i // 12):
            base[(17 * k + i) % 100] = f"edit{i % 5}"  # similarity falls below 0.8 as the edits grow
        docs.append((i, " ".join(base) + (" " + passage if i % 3 == 0 else ""), "s"))
    docs += [(100, "", "s"), (101, None, "s"), (102, "One two", "s"), (103, "one  two", "s"), (104, "one two three", "s"), (105, docs[3][1].upper(), "s")]
    base = prose(300, 400).split()
    return docs + [(200 + i, " ".join(base[10 * i : 10 * i + 120]), "s") for i in range(8)]  # a chain


def test_pipeline_near_duplicates_match_brute_force(spark, documents, prose, monkeypatch):
    import corpus_pipeline
    from stavelake.llm import near_dedup

    docs = near_docs(prose)
    want = brute_near([(i, t) for i, t, _ in docs])
    df = documents(docs, clash=True)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert 20 < len(set(want.values())) < 50
    # another order of the shingles, small blocks, dealt shingles and wide bitmaps give the same
    for name, value in (("HOT", 5), ("BLOCK", 3), ("DEALT", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    assert {r["doc_id"]: r["first"]["doc_id"] for r in near_dedup.classes(df).collect()} == want


def test_pipeline_near_duplicates_go_through_the_simhash_tree(spark, documents, prose, monkeypatch):
    """Texts that the tree links are offered as pairs, and verified; the tree sees a fingerprint of every distinct set."""
    import corpus_pipeline
    from stavelake.llm import near_dedup

    base = prose(9, 400).split()
    docs = [(i, " ".join(base[:399] + [f"end{i}"]), "s") for i in range(6)] + [(10 + i, prose(20 + i), "s") for i in range(4)]
    seen, verified = [], []
    tree, verify = simhash_dedup.links, near_dedup.verified
    monkeypatch.setattr(simhash_dedup, "links", lambda values: seen.append(values.count()) or tree(values))
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *rest: verified.append(pairs.count()) or verify(pairs, *rest))
    kept = corpus_pipeline.near_duplicates(spark, documents(docs), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10, 11, 12, 13]
    assert len(seen) == 1 and 4 < seen[0] <= 10
    assert verified[0] > 0


def test_near_duplicates_offer_a_row_per_component_not_per_pair():
    """Two components of many members under one shingle: a round offers few pairs, and bounds leave out unlike ones."""
    import numpy as np
    import pyarrow as pa
    from stavelake.llm import near_dedup

    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    families = [np.concatenate([common[:150], rng.integers(0, 1 << 63, 150, dtype=np.uint64)]) for _ in range(2)]
    rows = []
    for i in range(400):
        own = np.append(families[i % 2][: 295 + i % 5], rng.integers(0, 1 << 63, 3, dtype=np.uint64))
        rows.append((1, i, len(own), i % 2 if i < 300 else i, near_dedup.folded(near_dedup.parities(np.unique(own)), near_dedup.BITS)))
    columns = list(zip(*rows))
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())], ["cell", "fp", "n", "root", "bits"])
    offered = [b.to_pydict() for b in near_dedup._candidates("nearest")(iter([batch]))]
    assert sum(len(o["a"]) for o in offered) <= 2 * 102
    whole = [b.to_pydict() for b in near_dedup._candidates("all")(iter([batch]))]
    assert {(a + b) % 2 for o in whole for a, b in zip(o["a"], o["b"])} == {0}


def test_parity_bound_never_exceeds_the_difference():
    import numpy as np
    from stavelake.llm import near_dedup

    rng = np.random.default_rng(2)
    for n in (1, 30, 900, 1100, 5000):
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(base[: n + n // 7]), np.unique(base[n // 9 : n + n // 3])
        whole = [near_dedup.parities(a), near_dedup.parities(b)]
        near, wide = near_dedup._bitmaps([near_dedup.folded(w, near_dedup.BITS if len(x) < near_dedup.LARGE else near_dedup.WIDE) for w, x in zip(whole, (a, b))])
        differ = len(np.setxor1d(a, b))
        assert near_dedup.may_be_similar(9 * differ, 0, *whole)
        at = np.array([0]), np.array([1])
        assert near_dedup._apart(near, *at)[0] <= differ
        if min(len(a), len(b)) >= near_dedup.LARGE:
            assert near_dedup._apart(near, *at)[0] <= near_dedup._apart(wide, *at)[0] <= differ


def test_near_duplicates_odd_rows(documents, prose):
    from stavelake.llm import near_dedup

    kept = near_dedup.survivors(documents(odd_rows(prose), clash=True))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 6), (True, None)]
    assert near_dedup.survivors(documents([])).count() == 0


def test_long_chain_is_one_component(spark):
    from stavelake.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


# -- line dedup ------------------------------------------------------------------------------------
def brute_lines(docs, min_sites):
    sites, first = defaultdict(set), {}
    bare = lambda line: line.strip(" \t\n\v\f\r")
    for doc_id, text, site in docs:
        for k, line in enumerate((text or "").split("\n")):
            if bare(line):
                sites[bare(line)].add(site)
                place = (doc_id is not None, doc_id or 0, k)
                first[bare(line)] = min(first.get(bare(line), place), place)
    out = []
    for doc_id, text, _ in docs:
        kept = [line for k, line in enumerate((text or "").split("\n"))
                if not bare(line) or len(sites[bare(line)]) < min_sites or first[bare(line)] == (doc_id is not None, doc_id or 0, k)]
        out.append((doc_id, None if text is None else "\n".join(kept)))
    return out


def test_line_dedup_matches_brute_force(documents, prose):
    docs = []
    for i in range(60):
        lines = [prose(i, 8), "  Cookie notice here " if i % 2 else "Cookie notice here", prose(1000 + i % 25, 6), "", prose(2000 + i % 3, 5)]
        docs.append((i, "\n".join(lines), f"site{i % 30}" if i % 9 else None))
    docs += [(None, "Cookie notice here\nrest", "x"), (70, None, "x"), (71, "", "x"), (5, docs[5][1], docs[5][2]), (72, "Cookie notice here\n" * 3000, "x")]
    got = line_dedup.cleaned(documents(docs, clash=True), min_sites=10).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(brute_lines(docs, 10), key=key)


@pytest.mark.parametrize("sites", [9, 10, 11, 300])
def test_line_dedup_counts_near_the_limit_exactly(documents, prose, sites):
    docs = [(i, f"{prose(i, 5)}\nshared line", f"s{i % sites}") for i in range(2 * sites)]
    removed = line_dedup.cleaned(documents(docs), min_sites=10).agg({"ld_removed": "sum"}).first()[0]
    assert removed == (2 * sites - 1 if sites >= 10 else 0)


def test_line_dedup_empty(documents):
    assert line_dedup.cleaned(documents([])).count() == 0


# -- quality rules ---------------------------------------------------------------------------------
def test_quality_counts_match_brute_force(documents, prose):
    docs = [(1, prose(1, 80), "s"), (2, "a b c " * 60, "s"), (3, "x\n\nx\n y\n y\ny #*$%&|<> é€\u00a0z", "s"), (4, None, "s"), (5, "", "s"), (6, prose(2, 30_000), "s")]
    df = documents(docs, clash=True)
    got = {r["doc_id"]: r["v"] for r in df.select("doc_id", quality_rules.verdict(df["text"]).alias("v")).collect()}
    for doc_id, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        v = got[doc_id]
        assert (v["n_words"], v["word_chars"], v["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (v["n_dup_lines"], v["n_repeat_words"]) == (len(lines) - len(set(lines)), len(cover))
        assert v["base_failed"] == (len(words) < 50 or 100 * len(cover) > 50 * len(words))
    assert got[1]["kept"] and got[6]["kept"] and not got[2]["kept"] and not got[4]["kept"]


def test_quality_bands_reject_both_sides(documents, prose):
    import base64
    import random

    noise = base64.b85encode(random.Random(1).randbytes(9000)).decode()
    noise = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))
    repeated = "\n".join(" ".join(f"{w}{i % 7}" for w in ("alpha", "beta", "gamma", "delta")) for i in range(900))
    half = prose(4, 1500) + " " + "".join(f"k{i % 50} " for i in range(6000))
    df = documents([(1, prose(1, 3000), "s"), (2, noise, "s"), (3, repeated, "s"), (4, half, "s")])
    rules = quality_rules.Rules(max_repeat_percent=100)
    assert [r["doc_id"] for r in quality_rules.filtered(df, rules).collect()] == [1]
    assert quality_rules.filtered(documents([])).count() == 0


# -- source mix ------------------------------------------------------------------------------------
def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_meets_its_targets(documents, prose):
    docs = [(i, prose(i, 5 + (i * 37) % 200), ["a", "b", "c", "d", None][min(4, i % 11)]) for i in range(900)]
    df = documents(docs, clash=True)
    rows = source_mix.decisions(df, source_mix.Mix(block=50)).collect()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["copies"] <= 2
        low = math.floor(r["target"] / r["source_size"] + 1e-9)
        assert r["copies"] in (low, low + 1)
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in sizes)
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, source_mix.decisions(df.repartition(7), source_mix.Mix(block=50)).collect()))
    mixed = source_mix.mixed(df.drop("mix_size"), source_mix.Mix(block=50))
    assert sum(r["mix_copies"] * r["mix_size"] for r in mixed.collect()) == sum(taken.values())


def test_flight_keeps_both_totals():
    import random

    rng = random.Random(3)
    chance = [rng.random() for _ in range(500)]
    size = [float(rng.randint(0, 1000)) for _ in chance]
    before = sum(chance), sum(c * s for c, s in zip(chance, size))
    source_mix.fly(chance, size, random.Random(1), land=False)
    assert sum(0 < c < 1 for c in chance) <= 2
    assert math.isclose(sum(chance), before[0], abs_tol=1e-6) and math.isclose(sum(c * s for c, s in zip(chance, size)), before[1], rel_tol=1e-9)


def test_mix_keeps_large_ids_beside_a_null(documents, prose):
    """Ids past 2**53 survive a null among them; one giant document and a source without words change nothing."""
    rows = [((1 << 60) + i, prose(i, 5 + i % 9), f"s{i % 3}") for i in range(200)]
    rows += [(None, prose(900, 8), "s1"), ((1 << 60) + 500, prose(901, 60_000), "s0"), ((1 << 60) + 501, None, "none"), ((1 << 60) + 502, "", "none")]
    df = documents(rows).selectExpr("*", "1 AS MIX_SIZE", "2 AS Ld_Removed")
    decided = source_mix.decisions(df, source_mix.Mix(block=16)).collect()
    sizes = {(r["doc_id"], r["source"]): (r["size"], r["copies"]) for r in decided}
    assert sizes.keys() == {(i, s) for i, _, s in rows}
    assert all(sizes[i, s][0] == len((t or "").split()) for i, t, s in rows)
    mixed = [(r["doc_id"], r["mix_copies"]) for r in source_mix.mixed(df, source_mix.Mix(block=16)).collect()]
    assert sorted(mixed, key=str) == sorted(((i, n) for (i, _), (_, n) in sizes.items() if n), key=str)


def test_mix_odd_rows(documents, prose):
    df = documents(odd_rows(prose), clash=True)
    rows = source_mix.decisions(df).collect()
    assert sum(r["rows"] for r in rows) == 8
    assert {r["rows"] for r in rows if r["doc_id"] == 3} == {2}
    assert all(r["copies"] * r["size"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert source_mix.decisions(documents([])).count() == 0 and source_mix.mixed(documents([])).count() == 0
    assert source_mix.decisions(documents([(1, "", "a"), (2, None, None)])).count() == 2


# -- licenses --------------------------------------------------------------------------------------
def brute_licenses(docs, least=0.8):
    def grams(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    out = Counter()
    for doc_id, text in docs:
        mine = grams(text)
        for k, (_, template) in enumerate(license_scan.TEMPLATES):
            wanted = grams(template)
            if len(wanted & mine) / len(wanted) >= least:
                out[doc_id, k] += 1
    return out


def test_license_scan_matches_brute_force(documents, prose):
    docs = [(i, f"{prose(i, 30)}\n{text}\n{prose(90 + i, 9 + i)}", "s") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    docs += [(100 + i, prose(i, 20) + " " + text.upper()[: int(len(text) * 0.9)], "s") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    docs += [(200, None, "s"), (201, "", "s"), (202, "mit", "s"), (203, prose(5, 30_000) + " Released under the MIT License.", "s"), (3, docs[3][1], "s"), (None, docs[0][1], "s")]
    got = Counter((r["doc_id"], r["template"]) for r in license_scan.matches(documents(docs, clash=True)).collect())
    assert got == brute_licenses([(i, t) for i, t, _ in docs])
    assert license_scan.matches(documents([])).count() == 0


# -- pipeline --------------------------------------------------------------------------------------
def test_pipeline_on_odd_tables(spark, documents, prose, tmp_path):
    """Null ids, repeated rows, clashing and missing columns end to end; an empty table."""
    import corpus_pipeline

    rows = [((1 << 60) + i, prose(i, 60), f"s{i % 4}") for i in range(12)] + [(None, prose(50, 60), "s1"), (7, prose(3, 60), "s2"), (7, prose(3, 60), "s2"), (8, None, "s1")]
    spark.createDataFrame([(1, prose(99, 30)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = documents(rows, clash=True).drop("n_chars").withColumn("ld_removed", F.lit(99))
    spark.createDataFrame([(1, prose(99, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    documents([]).write.parquet(f"{tmp_path}/e/documents.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert ids <= {i for i, _, _ in rows} - {8, (1 << 60) + 3} and len(out) == len(ids)
    assert {r["ld_removed"] for r in out} == {99} and {len(r["text"].split()) for r in out} == {60}
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0


def test_pipeline_matches_brute_force(spark, documents, prose, tmp_path):
    import corpus_pipeline

    notice = "Accept all cookies to go on reading"
    leak = prose(777, 40)
    rows = [(i, prose(i, 200) + "\n" + notice, f"s{i % 12}") for i in range(48)]
    rows += [(100, rows[0][1], "s1"), (101, rows[1][1].replace(prose(1, 200)[:6], "Xy"), "s2"), (102, "a b " * 400, "s3"), (103, prose(103, 100) + " " + leak, "s4"),
             (104, None, "s5"), (105, "too short", "s6"), (106, notice, "s7")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        df = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r["text"] for r in df.collect()}
    after = [i for i, t, _ in rows if t and len(t.split()) >= 50 and i != 102]
    assert sorted(kept["quality rules"]) == sorted(after)
    lines = {i: t for i, t in brute_lines([r for r in rows if r[0] in after], 10)}
    assert kept["line dedup"] == {i: t for i, t in lines.items() if t.strip()}
    firsts = set(brute_near(list(kept["line dedup"].items())).values())
    assert set(kept["near dedup"]) == firsts and 100 not in firsts
    assert set(kept["decontamination"]) == firsts - {103}
    assert set(kept["source mix"]) <= set(kept["decontamination"]) and kept["source mix"]
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["mix_copies"]) for r in ran.collect()) == sorted((r["doc_id"], r["mix_copies"]) for r in df.collect())
