"""Personal data, vector codes and fill-in-the-middle against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import fill_in_middle as fim
from gleaner.llm import pii, vector_codes

# Fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m


def test_fim_rows(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "ab", "<P>", "x<S>", "<", "<S", "P>", ">M<", "M>" * 40, "😀é" * 300, "word " * 30_000, "\x00\n\r" * 9, "x" * 256, "y" * 257, "<<<S" * 70]
    texts += ["".join(rng.choice("<PSM> aé😀\n") for _ in range(rng.randint(0, 700))) for _ in range(80)]
    rows = [(i - 3, t, 1, "b") for i, t in enumerate(texts)] + [(None, "no id at all", 1, "b"), (7, "same id", 1, "b"), (7, "same id", 1, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    out = fim.fill_in_middle(df).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in out)
    assert got == Counter((i, *brute_fim(i, t), t or "") for i, t, _, _ in rows)
    assert {"plain", "psm", "spm"} == {r["form"] for r in out}
    assert fim.fill_in_middle(df.where("false")).count() == 0


def test_fim_query(spark, tmp_path):
    rows = [(i, None if i == 3 else f"text {i} " * i) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in fim.op13_fill_in_middle(spark, str(tmp_path)).collect()}
    want = {i: brute_fim(i, t) for i, t in rows}
    assert got == {i: (*want[i][:4], sha(want[i][4]), sha(t or "")) for i, t in rows}


@pytest.mark.parametrize("unit", [fim.CODE_POINT, fim.WORD, fim.LINE])
def test_fim_units_tile(unit):
    matcher = fim.Matcher(unit)
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "é😀 "]) for _ in range(rng.randint(0, 1500)))
        starts = [m.start() for m in re.finditer(unit, text)] + [len(text)]
        n = matcher.count(text)
        assert n == len(starts) - 1 and "".join(m.group() for m in re.finditer(unit, text)) == text
        a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
        assert matcher.cuts(text, a, b) == ((starts[a] if a else 0), (starts[b] if b else 0))
    with pytest.raises(ValueError):
        fim.Matcher("a*")


# Vector codes


def brute_codes(rows, entries=256, rounds=4, parts=4):
    """Plain Lloyd in whole numbers: every part against every entry in every round."""
    kept = sorted((i, v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all())
    x = np.floor(1024 * np.array([v for _, v in kept])).astype(object).reshape(len(kept), parts, -1)
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))

    for r in range(rounds + 1):
        best = [[nearest(v[p], books[p]) for v in x] for p in range(parts)]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [v[p] for v, (_, at) in zip(x, best[p]) if at == e]
                    if mine:
                        books[p][e] = [int(sum(c)) // len(mine) for c in zip(*mine)]
    codes = ["".join(f"{best[p][k][1]:02x}" for p in range(parts)) for k in range(len(kept))]
    return {(i, c, int(sum(best[p][k][0] for p in range(parts)))) for k, ((i, _), c) in enumerate(zip(kept, codes))}, books


@pytest.mark.parametrize("scale, n, entries, block", [(1.0, 400, 16, 64), (0.01, 300, 8, 1000), (1.0, 5, 256, 3), (300.0, 120, 4, 50)])
def test_codes_are_plain_lloyds(spark, scale, n, entries, block):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(6, 8))
    rows = [(i * 7 % 1009, [float(c) for c in np.round((centres[i % 6] + 0.3 * rng.normal(size=8)) * scale, 2)]) for i in range(n)]
    rows += [(5000 + k, list(rows[0][1])) for k in range(9)]  # ties and repeated rows
    bad = [(9001, None), (9002, [1.0, None] * 4), (9003, [float("nan")] + [0.0] * 7), (9004, [float("inf")] + [0.0] * 7), (9005, []), (9006, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, i % 3 or None, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    coded, books = vector_codes.compress(df, entries=entries, block_rows=block, label_col="label")
    want, want_books = brute_codes([r for r in rows + bad if r[0] < 9005], entries)
    assert books.astype(int).tolist() == want_books
    got = vector_codes.with_label_error(coded).collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in got} == want and len(got) == len(rows)
    sums = Counter()
    for i, _, e in want:
        sums[i % 3 or None] += e
    assert all(r["label_error"] == sums[r["label"]] for r in got)
    one = got[0]
    assert ((vector_codes.decode(one["code"], books) - np.floor(1024 * np.array(dict(rows)[one["vec_id"]]))) ** 2).sum() == one["error"]


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0, 3.0])]):
        coded, books = vector_codes.compress(spark.createDataFrame(rows, kind))
        assert coded.count() == 0 and books.shape[1] == 0
    big = [(None, [3e30, -3e30, 1.0, 0.5]), (2, [1.0, 1.0, 1.0, 1.0]), (2, [0.0, 1.0, 1.0, 1.0])]
    coded, books = vector_codes.compress(spark.createDataFrame(big, kind), rounds=1)
    assert sorted(r["code"] for r in coded.collect()) == ["00000000", "01010101", "02020202"] or coded.count() == 3
    assert np.abs(books).max() == 1 << 24


def test_heaps_spare_parts():
    """Parts whose slack holds are not looked at again, and what is popped includes every part that changes its entry."""
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] * 300 + rng.normal(size=(4000, 8)) * 40)  # in clumps, so that entries come to rest
    book = x[:32].copy()
    heaps = vector_codes.Heaps(np.zeros(len(x), np.int64), np.zeros(len(x)), None, len(book))
    drift = np.zeros((1, len(book)))
    heaps.rescan(np.arange(len(x)), x, book, drift[0])
    popped = []
    for _ in range(12):
        sums = np.zeros((1, len(book), 9), np.int64)
        np.add.at(sums[0, :, 0], heaps.codes, 1)
        np.add.at(sums[0, :, 1:], heaps.codes, x.astype(np.int64))
        new, drift = vector_codes._moved(book[None], sums, drift)
        book = new[0]
        again = vector_codes.Heaps(heaps.codes, heaps.keys, heaps.order(), len(book))  # as it is written and read
        which = again.violated(drift[0])
        popped.append(len(which))
        again.rescan(which, x, book, drift[0])
        assert (again.codes == vector_codes.nearest(x, book)[0]).all()
        heaps = again
    assert 0 < popped[0] and popped[-1] < len(x) / 2


# Personal data


def brute_base(text):
    out = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = [int(c) for c in m.group() if c in "0123456789"]
            check = sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(reversed(d)))
            if (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and check % 10 == 0, 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_patterns():
    rng = random.Random(5)
    bits = ["1", "2", "55", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "%", "x", "4111 1111 1111 1111", "é", "\n", "256", "00255", "+1 (509) 555-6973", "a.b@c.de"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert sorted((s, k, e) for s, e, k, ok in pii.base_matches(text) if ok) == brute_base(text)


def test_pii_reads_in_linear_time():
    began = time.perf_counter()
    for text in ("1" * 300_000, "1." * 300_000, "a" * 300_000, "+1" + " " * 300_000, "(1" * 200_000, "a@" * 200_000, "at dot " * 50_000, "a:" * 200_000, "1 " * 300_000, "01 " + "7" * 200_000 + ")"):
        base = pii.base_matches(text)
        for s, e, k in pii.candidates(text, text.lower(), base):
            pii.describe(text, s, e, k)
    assert time.perf_counter() - began < 30


def test_pii_expectation_maximisation_learns_reliabilities():
    """Votes drawn from labelers of known quality: estimates come near them, and posteriors beat every single labeler."""
    rng = np.random.default_rng(2)
    n, truth = 20_000, np.array([[[0.2, 0.75, 0.05], [0.4, 0.5, 0.1], [0.5, 0.48, 0.02], [0.3, 0.6, 0.1]], [[0.3, 0.1, 0.6], [0.4, 0.4, 0.2], [0.6, 0.05, 0.35], [0.3, 0.3, 0.4]]])
    y = (rng.random(n) < 0.4).astype(int)
    digits = np.array([[rng.choice(3, p=truth[1 - c, k]) for k in range(4)] for c in y])
    counts = Counter(map(int, (digits * 3 ** np.arange(4)).sum(1)))
    votes, weight = np.array(list(counts)), np.array(list(counts.values()))
    post, rel, share = pii.posteriors(votes, weight, np.full(len(votes), -1))
    assert abs(share - 0.4) < 0.06 and np.abs(rel - truth).max() < 0.08
    of = dict(zip(votes.tolist(), post))
    right = np.mean([(of[v] >= 0.5) == c for v, c in zip((digits * 3 ** np.arange(4)).sum(1).tolist(), y)])
    assert right > max(np.mean((digits[:, k] == 1) == y) for k in range(4))


def test_pii_rows(spark):
    say = {
        1: "Call me at (415) 555-2671 today", 2: "write to jane dot doe at example dot com. The end", 3: "mail jürgen.müller@example.de now", 4: "ipv6 2001:db8::8a2e:370:7334 host",
        5: "order no 4155552671", 6: "on 2024-01-15 10:30 it was version 10.20.30 of 2 parts", 7: "look at example.com for dot com news", 8: None, 9: "", 10: "7567553925670233 12 34 56 78 90 11 12",
        11: "a.b@c.example.org 4111 1111 1111 1111 or +1 (509) 555-6973 at 10.0.0.255 and 300.1.1.1", 12: "plain words only", 13: "+49 30 1234567 & +49 (0) 30 / 1234567",
    }
    rows = [(i, t, "x", 1) for i, t in say.items()] + [(11, say[11], "x", 1), (None, "me@home.example", "x", 1), (14, "7 " * 60_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int").repartition(3)
    found = pii.find_pii(df)
    got = {r["doc_id"]: [(s["kind"], (say.get(r["doc_id"]) or "me@home.example")[s["start"] : s["end"]], s["base"]) for s in r["spans"]] for r in found.collect()}
    assert got[1] == [("phone", "(415) 555-2671", False)] and got[2] == [("email", "jane dot doe at example dot com", False)]
    assert ("email", "jürgen.müller@example.de", False) in got[3] and ("email", "ller@example.de", True) in got[3] and got[4] == [("ip", "2001:db8::8a2e:370:7334", False)]
    assert got[5] == got[6] == got[7] == got[8] == got[9] == got[10] == got[12] == got[14] == []
    assert got[11] == [("email", "a.b@c.example.org", True), ("card", "4111 1111 1111 1111", True), ("phone", "+1 (509) 555-6973", True), ("ip", "10.0.0.255", True)]
    assert got[None] == [("email", "me@home.example", True)] and found.count() == len(rows)
    clean = df.where("doc_id = 11").drop("spans").join(found.where("doc_id = 11").limit(1), "doc_id").select(pii.redact(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert clean == "[email] [card] or [phone] at [ip] and 300.1.1.1"
    assert pii.find_pii(df.where("false")).count() == 0


def test_pii_query(spark, tmp_path):
    texts = ["a.b@c.example.org, +1 (509) 555-6973 and 4111111111111111 from 10.0.0.1", None, "none here", "x@y.zz 1.2.3.4.5.6.7.8"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op11_pii(spark, str(tmp_path)).collect():
        base = brute_base(texts[r["doc_id"]] or "")
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["spans"] == said
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in base) for k in range(4)]
