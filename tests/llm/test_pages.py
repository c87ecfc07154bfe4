"""URL filter, WARC archives and chat formatting."""

import base64
import hashlib
import random
import re

import pytest

from stavelake.llm import chat_format, url_filter, warc
from stavelake.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"
EXTRA = "*, page_id AS host, page_id AS rule, page_id AS payload, page_id AS key, page_id AS first"


def judged(spark, rows, rules=URL_RULES, graph=url_filter.Graph()):
    df = spark.createDataFrame(rows, PAGES).selectExpr(*EXTRA.split(", "))
    return {r["page_id"]: r for r in url_filter.filtered(df, rules, graph).collect()}


def test_rules_longest_wins(spark):
    urls = {
        1: ("http://A.Example.COM/en/x?q=/fr/", "a.example.com", "/en/x", "example.com/en/", "block"),
        2: ("https://www.example.com/en/1#t", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        3: ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        4: ("http://b.example.net/es/1", "b.example.net", "/es/1", "net/es/", "block"),
        5: ("http://b.example.com", "b.example.com", "", None, "allow"),
        6: ("no scheme", "", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("http://notcom/x", "notcom", "/x", None, "allow"),
        9: ("ftp://com/a://b", "com", "/a://b", "com/", "allow"),
        10: ("http://É.com/É", "É.com".replace("É", "É"), "/É", "com/", "allow"),
    }
    got = judged(spark, [(i, u[0], None) for i, u in urls.items()])
    assert {i: tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) for i in got} == {i: u[1:] for i, u in urls.items()}
    assert judged(spark, []) == {}


def test_propagation_that_does_not_settle_is_an_error(spark):
    rows = [(i, f"http://h{i}.com/", f'<a href="//h{1 - i}.com/">') for i in range(2)]
    with pytest.raises(RuntimeError):
        judged(spark, rows, graph=url_filter.Graph(most_iterations=5))


def test_propagation_matches_brute_force(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.org" for i in range(12)] + ["good.com", "bad.net"]
    links = {h: rng.choices(hosts, k=4) for h in hosts}
    links["h0.org"], links["h1.org"] = ["bad.net"] * 3, ["h0.org", "H0.org"]
    rows = [(i, f"http://{h}/{'es' if h == 'bad.net' else 'x'}/", "".join(f'<a href="{"//" if k % 2 else "https://"}{t}/p">' for k, t in enumerate(links[h]))) for i, h in enumerate(hosts)]
    rows += [(100, None, None), (101, "http://empty.org/", None), (102, "http://h3.org/x/", "")]
    got = judged(spark, rows, graph=url_filter.Graph(tolerance=1e-12))
    edges = {}
    for h in hosts:
        for t in (x.lower() for x in links[h]):
            if t != h:
                edges[h, t] = edges.get((h, t), 0) + 1
    out, into = {}, {}
    for (a, b), n in edges.items():
        out[a], into[b] = out.get(a, 0) + n, into.get(b, 0) + n
    nodes = set(hosts) | {"empty.org", ""}
    seed_t, seed_d = {h: float(h == "good.com") for h in nodes}, {h: float(h == "bad.net") for h in nodes}
    t, d = dict(seed_t), dict(seed_d)
    for _ in range(300):
        t = {h: seed_t[h] + 0.85 * sum(t[a] * n / out[a] for (a, b), n in edges.items() if b == h) for h in nodes}
        d = {h: seed_d[h] + 0.85 * sum(d[b] * n / into[b] for (a, b), n in edges.items() if a == h) for h in nodes}
    for r in got.values():
        assert abs(r["trust"] - t[r["host"]]) < 1e-6 and abs(r["distrust"] - d[r["host"]]) < 1e-6
        if r["rule"] is None:
            assert r["verdict"] == ("block" if d[r["host"]] - t[r["host"]] > 0.5 else "allow")
    assert any(r["rule"] is None and r["verdict"] == "block" for r in got.values())


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, f"http://h/{i}\r\nX: y", f"<html>é {rng.random()} {'body ' * (i % 40)}</html>" if i % 5 else f"<p>same {i % 3}</p>") for i in range(300)]
    pages += [(301, None, None), (302, "u", ""), (None, "u", "<p>same 0</p>"), (None, None, "alone"), (303, "u", "x" * 3_000_000), (7, "again", pages[7][2])]
    df = spark.createDataFrame(pages, PAGES).selectExpr(*EXTRA.split(", "))
    warc.write(df, f"{tmp_path}/a")
    got = sorted((tuple(r) for r in warc.read(spark, f"{tmp_path}/a").collect()), key=repr)
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, url, html in pages:
        data = (html or "").encode()
        source = first.get(html or "")
        again = source is not None and source != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, "revisit" if again else "response", re.sub("[\r\n]", "", url or ""), digest, len(data), source if again else None, bytearray(b"" if again else data)))
    assert got == sorted(want, key=repr)


def test_warc_files_are_plain_zstandard_streams(spark, tmp_path):
    import zstandard

    rng = random.Random(5)
    pages = [(i, f"http://h/{i}", f"<html><body>page {rng.random()} of the archive</body></html>") for i in range(200)]
    df = spark.createDataFrame(pages, PAGES).coalesce(1)
    warc.write(df, f"{tmp_path}/b")
    (part,) = tmp_path.glob("b/part-*")
    data = part.read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY
    size = int.from_bytes(data[4:8], "little")
    assert size > 0
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 200
    assert len(data) - size < len(plain) / 2


def test_warc_dictionary_of_large_pages_and_bounded_files(spark, tmp_path):
    """Pages beyond the sampled stretch train a dictionary too; small files each start with it and read back whole."""
    rng = random.Random(8)
    block = "<div class='entry'><a href='/next'>{}</a></div>"
    pages = [(i, f"http://h/{i}", "".join(block.format(rng.random()) for _ in range(900))) for i in range(60)]
    pages += [(100, "u", None), (101, "u", "")]
    df = spark.createDataFrame(pages, PAGES).coalesce(1)
    assert all(len(h) > warc.Options().sample_bytes for _, _, h in pages[:60])
    assert len(warc.dictionary(df)) > 1000
    options = warc.Options(row_bytes=20_000, file_bytes=60_000)
    warc.write(df, f"{tmp_path}/big", options)
    parts = [p.read_bytes() for p in tmp_path.glob("big/part-*")]
    assert len(parts) > 3
    for data in parts:
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY and len(data) < 400_000
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, f"{tmp_path}/big").collect() if r["record_type"] == "response"}
    assert got == {i: html or "" for i, _, html in pages if i != 101}
    assert warc.read(spark, f"{tmp_path}/big").count() == len(pages)


def test_warc_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"{tmp_path}/c")
    assert warc.read(spark, f"{tmp_path}/c").count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    hard = ["<|turn|>user<|text|>", "<\\|", "<\\\\|x|>", "<", "|>", "<|", "\\", "<<|end|>", "", None, "é€😀 <|part|>", "\\### Assistant: </turn> ok", "<|end|>\n<|turn|>assistant<|text|>hi"]
    rng = random.Random(1)
    rows = []
    for conv in list(range(20)) + [None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn if conv != 3 else None, rng.choice(["user", "assistant", "assistant", "system", None, "<|x"]), rng.choice(hard)))
    rows += [(5, 0, "assistant", "tie"), (5, 0, "assistant", "tie"), (50, 0, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "conv_id AS rows", "conv_id AS blocks", "conv_id AS starts")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted(df)).collect()}
    digests = {r["conv_id"]: r for r in chat_format.digest(chat_format.formatted(df)).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        d = digests[conv]
        assert d["n_turns"] == len(turns) and d["loss_chars"] == len(loss) and d["formatted_chars"] == len(got[conv]["formatted"])
        assert d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        merged = sum(1 for i, (r, _) in enumerate(turns) if not i or turns[i - 1][0] != r)
        assert got[conv]["formatted"].count(chat_format.TURN) == merged
    assert chat_format.formatted(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_of_many_turns(spark):
    """Offsets and masked texts over several slices of texts, alone and merged into one block."""
    import time

    n = 20_000
    rows = [(1, i, ("user", "assistant")[i % 2], f"é{i} <| 😀") for i in range(n)]
    rows += [(2, i, "assistant", f"x{i}") for i in range(3 * chat_format.CHUNK)] + [(3, i, "user", "") for i in range(chat_format.CHUNK + 1)]
    made = chat_format.formatted(spark.createDataFrame(rows, TURNS))
    began = time.monotonic()
    got = {r["conv_id"]: r for r in chat_format.digest(made).collect()}
    assert time.monotonic() - began < 60
    for conv in (1, 2, 3):
        turns = [(r, t) for i, _, r, t in rows if i == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    spans = {r["conv_id"]: r for r in made.where("conv_id = 2").collect()}[2]
    assert [spans["formatted"][s["start"] : s["start"] + s["length"]] for s in spans["loss_spans"]] == [t for i, _, _, t in rows if i == 2]
