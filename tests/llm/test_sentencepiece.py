import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import sentencepiece_lattice as S

TEXTS = [
    "Hello world, this is a test.", None, "", " ", "  two  spaces ", "naïve Ünïcode 漢字 😀", "line\nbreak\ttab", "Tiontion therhaing enlichung ciónmente", "x" * 60 + " end", "1234 5.6",
    "a▁b", "\n", "x" * 5000, "漢字かな交じり文" * 40, "e" * 61 + "\n" + "e" * 70, "don't stop; f(x)=y_1->z" * 9, " " * 200, "Hello world, this is a test.",
]


def test_equals_the_library(spark):
    sp = S._processor(S.default_model())
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string")
    rows = S.encode(df, unit_bytes=3000)
    got = {r["doc_id"]: r["ids"] for r in rows.collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(TEXTS)}
    for col in ("ids", "viterbi_ids"):
        back = {r["doc_id"]: r["text"] for r in S.decode(rows, col).collect()}
        assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}
    assert S.encode(df.where("false")).count() == 0


def test_query_decodes_every_document(spark, tmp_path):
    sp = S._processor(S.default_model())
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (0, "y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op4_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == len(TEXTS) + 2 and all(r["round_trip"] for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    for i, t in list(enumerate(TEXTS))[1:]:
        assert (by[i]["ids"], by[i]["decoded"]) == (sp.encode(t or ""), (t or "").replace("▁", " "))


def test_texts_longer_than_a_run_are_cut_between_words():
    near = S.Neighbours([p for p, _, _ in S.Pieces(S.default_model()).rows])
    rng = random.Random(5)
    texts = [S.marked(" ".join(rng.choice(["alpha", "beta", "x1,y", "漢字"]) for _ in range(n))) for n in (3, 400, 0, 30)] + [S._MARK + "x" * 3000]
    runs = list(S._runs(texts, near, 100))
    for i, t in enumerate(texts):
        own = "".join(r for lo, hi, r in runs if lo == i and hi == i + 1)
        assert own in (t, "") or len(t) <= 100
    assert "".join(r for _, _, r in runs) == "".join(texts)
    words, index, counts = S.split(texts, near)
    assert "".join(words[i] for i in index) == "".join(texts) and counts.sum() == len(index) and len(set(words)) == len(words)


def test_viterbi_is_best(spark):
    score = {"a": -3.0, "b": -3.5, "ab": -4.0, "aba": -9.0, "ba": -4.2, "bb": -3.0}
    ids = {p: i for i, p in enumerate(score)}
    pieces = spark.createDataFrame([(p, ids[p], s) for p, s in score.items()], "piece string, id int, score double")
    words = ["".join(w) for n in (1, 3, 5, 7) for w in itertools.product("ab", repeat=n)] + ["abéb"]
    lat = S.lattice(spark.createDataFrame([(w,) for w in words], "word string"), pieces, 3)
    path = S.viterbi_fold(F.col("edges"), [S._UNKNOWN, *score.values()])
    got = {r["word"]: r["ids"] for r in lat.select("word", S.ids_of(F.col("word"), path, list(range(1000, 1256))).alias("ids")).collect()}
    assert set(got) == set(words) and got.pop("abéb") == [ids["ab"], 1000 + 0xC3, 1000 + 0xA9, ids["b"]]
    names = {i: p for p, i in ids.items()}

    def best(w):
        cuts = [(0, *c, len(w)) for k in range(len(w)) for c in itertools.combinations(range(1, len(w)), k)]
        return max(sum(score[w[a:b]] for a, b in zip(c, c[1:])) for c in cuts if all(w[a:b] in score for a, b in zip(c, c[1:])))

    for w, path in got.items():
        assert "".join(names[i] for i in path) == w and abs(sum(score[names[i]] for i in path) - best(w)) < 1e-9
        assert path == S.best_path(w, {p: (s, [ids[p]]) for p, s in score.items()}, 3, [])


def test_trying_each_edge_once_is_the_same(spark):
    rng = random.Random(11)
    pieces = S.Pieces(S.default_model())
    assert pieces.in_order
    texts = ["".join(rng.choice([p for p, _, _ in pieces.rows[:3000]]) for _ in range(rng.randint(1, 4)))[:40] for _ in range(300)]
    rows = spark.createDataFrame(pieces.rows, "piece string, id int, score double")
    lat = S.lattice(spark.createDataFrame([(t,) for t in sorted(set(texts))], "word string"), rows, pieces.longest)
    ids = lambda codes: S.ids_of(F.col("word"), codes, pieces.bytes)
    full = lat.select("word", ids(S.merge_fold(F.col("edges"), pieces.ranks)).alias("ids"), ids(S.viterbi_fold(F.col("edges"), pieces.scores)).alias("viterbi_ids"))
    assert sorted(full.collect()) == sorted(S.encode_short(lat.select("word"), pieces).collect())
    # "bc" is worse than "abc", yet a part of it where nothing else merges
    assert not S.in_order([("a", 0, -9.0), ("b", 1, -9.0), ("c", 2, -9.0), ("bc", 3, -5.0), ("abc", 4, -2.0)], [9, 4, 4, 4, 3, 1])
    assert S.in_order([("a", 0, -9.0), ("b", 1, -9.0), ("c", 2, -9.0), ("bc", 3, -2.0), ("abc", 4, -5.0)], [9, 4, 4, 4, 1, 3])


def test_packed_arrays_come_back():
    a, b = np.array([0, 1, 2**31], np.uint32), np.zeros(0, np.uint32)
    x, y = S._unsqueeze(S._squeeze(a, b))
    assert (x == a).all() and len(y) == 0
