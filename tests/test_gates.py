"""Gates never lose a match."""

import random
import re

from gleaner.functions import fixed as X
from gleaner.functions import gates


def simple(pattern):
    """Without look-behind, which this engine wants to be of fixed width; what is left matches wherever the pattern does."""
    while m := re.search(r"\(\?<!(?:[^()\\]|\\.)*\)", pattern):
        pattern = pattern[: m.start()] + pattern[m.end() :]
    return pattern


PATTERNS = [r.pattern for r in X.RULES] + [X.PRICE_DISCLOSURE, X.HUMAN_SALE, X.VENDOR_BRANDS, X.CATEGORY_NOUNS, X.HUMAN_BUNDLE, X.LUXURY_BRANDS, X.HYPE_BRANDS, X.LOOKS_NEW, X.STRONG_AUTHENTICITY, X.LUXURY_ITEMS, X.AUTHENTICITY_DODGE, X.RETAIL, X.CONDITION]


def test_literals_and_branches():
    assert gates.literals(r"\btemu\b") == ("temu",) and gates.literals(r"\d+") is None and gates.literals(r"(?:ab|cd)?x") == ("x",)
    assert gates.literals(r"\b(?:order\s+now|buy\s+today)\b") == ("order", "today") and gates.literals(r"a?b*") is None
    assert gates.branches(r"\b(?:a|b(?:c|d)|[|]e)\b") == [r"\b(?:a)\b", r"\b(?:b(?:c|d))\b", r"\b(?:[|]e)\b"]
    assert gates.branches(r"\b(?:a|b)\b|c") == [r"\b(?:a|b)\b", "c"] and gates.branches(r"\b(?:a)\b.(?:b)\b") == [r"\b(?:a)\b.(?:b)\b"]
    assert re.fullmatch(gates.trie(["new", "news", "old"]), "news") and re.match(gates.trie(["new", "news", "old"]), "newsy").group() == "news"


def sample(rng, tree):
    """A text that a parsed pattern matches, look-around aside."""
    import re._constants as C

    out = ""
    for op, arg in tree:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.BRANCH:
            out += sample(rng, rng.choice(arg[1]))
        elif op is C.SUBPATTERN:
            out += sample(rng, arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif op is C.ANY:
            out += "q"
        elif op is C.IN:
            kind, value = arg[0]
            if kind is C.NEGATE:
                out += "q"
            elif kind is C.LITERAL:
                out += chr(value)
            elif kind is C.RANGE:
                out += chr(rng.randint(*value))
            else:
                out += {C.CATEGORY_SPACE: " ", C.CATEGORY_DIGIT: "7", C.CATEGORY_WORD: "w", C.CATEGORY_NOT_SPACE: "x"}[value]
        elif op is C.CATEGORY:
            out += " "
    return out


def test_every_match_passes_its_gate():
    import re._parser as P

    rng, hits = random.Random(6), 0
    all_gates = gates.Gates(PATTERNS)
    found = re.compile(f"(?=({gates.trie(all_gates.words)}))")
    for pattern in PATTERNS:
        plain, parts = re.compile(simple(pattern), re.I | re.A), [re.compile(simple(b), re.I | re.A) for b in gates.branches(pattern)]
        for _ in range(150):
            text = re.sub("[^\x00-\x7f]", "·", rng.choice(["", "so ", "x"]) + "".join(c.upper() if rng.random() < 0.3 else c for c in sample(rng, P.parse(pattern))) + rng.choice(["", " end", "y"]))
            match = bool(plain.search(text))
            low = text.lower()
            assert match == any(p.search(text) for p in parts), (pattern, text)
            if match:
                hits += 1
                assert any(x in low for x in gates.literals(pattern)), (pattern, text)
                assert any(p.search(text) and (gates.literals(b) is None or any(x in low for x in gates.literals(b))) for p, b in zip(parts, gates.branches(pattern)))
                words = {m.group(1) for m in found.finditer(low)}
                k = all_gates.at[pattern]
                assert any(all_gates.masks[k // 63][all_gates.words.index(w)] >> k % 63 & 1 for w in words), (pattern, text)
    assert hits > 3000


def test_bits_of_batches_decide(spark):
    """Where a bit is sure it is the match itself; elsewhere it never loses one."""
    import re._parser as P

    from pyspark.sql import functions as F

    rng, all_gates = random.Random(8), gates.Gates(PATTERNS, elsewhere=(X.CATEGORY_NOUNS,))
    assert len(all_gates.sure) > 70 and X.CATEGORY_NOUNS not in all_gates.sure
    texts = ["", " ", None] + [" ".join(re.sub("[^\x00-\x7f]", "·", sample(rng, P.parse(p))).split()).lower() for p in PATTERNS for _ in range(3)] + ["xtemux", "temu", "shelves·lv"]
    # the engine of the columns, pattern by pattern
    hits = F.array(*[F.coalesce(F.col("t").rlike("(?i)" + p), F.lit(False)) for p in all_gates.at])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2).withColumn("b", all_gates.bits(F.col("t"))).select("t", "b", hits.alias("h")).collect()
    assert len(rows) == len(texts) and sum(map(sum, (r["h"] for r in rows))) > 200
    for r in rows:
        for (p, k), hit in zip(all_gates.at.items(), r["h"]):
            bit = bool(r["b"][k // 63] >> k % 63 & 1)
            assert bit == hit if p in all_gates.sure else bit or not hit, (p, r["t"])
