"""What a text must hold for a pattern to match it: a few literals, far cheaper to look for than the pattern itself.

``literals(pattern)`` are lower-case strings of which every match of the pattern (case-insensitive) holds at least one, found by walking the parsed
pattern: of a sequence the most telling element counts, of alternatives all of them, of what may be absent nothing. None where no literal is sure. A
gate never decides a match, it only spares the regular expression where there can be none.
"""

from __future__ import annotations

import functools
import re
import re._constants as C
import re._parser as P

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTHLESS = {C.AT, C.ASSERT, C.ASSERT_NOT}


def _telling(found: set[str]) -> tuple:
    shortest = min(map(len, found))
    return shortest >= 3, -len(found), shortest


def _of(seq) -> set[str] | None:
    best, run = None, ""

    def consider(found: set[str] | None) -> None:
        nonlocal best
        if found and (best is None or _telling(found) > _telling(best)):
            best = found

    for op, arg in seq:
        if op is C.LITERAL and arg < 128 and not chr(arg).isspace():
            run += chr(arg).lower()
            continue
        if op in _WIDTHLESS:
            continue
        consider({run} if run else None)
        run = ""
        if op is C.BRANCH:
            parts = [_of(p) for p in arg[1]]
            consider(set().union(*parts) if all(parts) else None)
        elif op is C.SUBPATTERN:
            consider(_of(arg[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            consider(_of(arg[2]))
    consider({run} if run else None)
    return best


@functools.cache
def literals(pattern: str) -> tuple[str, ...] | None:
    found = _of(P.parse(pattern))
    if not found:
        return None
    # what holds "abc" holds "b"
    return tuple(sorted(x for x in found if not any(y != x and y in x for y in found)))


def gate(low: Column, pattern: str) -> Column | None:
    """Whether the lower-cased text can match at all."""
    found = literals(pattern)
    if not found:
        return None
    out = F.contains(low, F.lit(found[0]))
    for x in found[1:]:
        out = out | F.contains(low, F.lit(x))
    return out


def branches(pattern: str) -> list[str]:
    """Patterns one of which matches wherever ``pattern`` does: its top alternatives, within the word bounds around all of them if there are such."""
    head, tail, body = "", "", pattern
    if pattern.startswith(r"\b(?:") and pattern.endswith(r")\b") and len(_split(pattern[5:-3])) > 1 and _closed(pattern[5:-3]):
        head, tail, body = r"\b(?:", r")\b", pattern[5:-3]
    return [head + part + tail for part in _split(body)]


def _split(body: str) -> list[str]:
    """The alternatives at the top of a pattern."""
    parts, depth, at, in_class = [""], 0, 0, False
    while at < len(body):
        c = body[at]
        if c == "\\":
            parts[-1] += body[at : at + 2]
            at += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        depth += (c == "(") - (c == ")") if not in_class else 0
        if c == "|" and not depth and not in_class:
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return parts


def _closed(body: str) -> bool:
    """Whether brackets close no more than they open at any place, so that the bracket around the body is its own."""
    depth = 0
    for c in re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", body):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return not depth


def trie(words: list[str]) -> str:
    """A pattern of the longest of the words at a place, shared beginnings once."""
    top: dict = {}
    for w in words:
        node = top
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def spell(node: dict) -> str:
        end = "" in node
        parts = [re.escape(c) + spell(rest) for c, rest in sorted(node.items()) if c]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + ("?" if end else "") if len(parts) > 1 or end else parts[0]

    return spell(top)


class Gates:
    """The gates of many patterns at once: a bit a pattern says whether it can match.

    Bits come from batches of texts. Literals hold no blanks, so they are looked for in the distinct words of a batch; where they let a pattern
    through, the linear engine that Arrow brings decides, for patterns without look-around on the text itself (``sure``). Patterns ``elsewhere``
    are meant for other texts, which the scanned one holds: for those a bit stays a gate.
    """

    def __init__(self, patterns: list[str], elsewhere: tuple[str, ...] = ()):
        self.at = {p: k for k, p in enumerate(dict.fromkeys(p for p in patterns if literals(p)))}
        self.words = sorted({x for p in self.at for x in literals(p)})
        starts = {w: [p for p in self.at if any(w.startswith(x) for x in literals(p))] for w in self.words}
        self.masks = [[sum(1 << self.at[p] - 63 * n for p in starts[w] if self.at[p] // 63 == n) for w in self.words] for n in range(len(self.at) // 63 + 1)]
        self.sure = {p for p in self.at if p not in elsewhere and _linear(p)}

    def bits(self, low: Column) -> Column:
        """The bits alone."""
        return self.look(low)["bits"]

    def look(self, folded: Column, wanted: dict[int, str] | None = None) -> Column:
        """struct<bits, found> of a folded text whose words are parted by single blanks: the bits as an array of longs of 63, and of the ``wanted`` patterns
        (by number, all of them ``sure``) the first matches that are not empty, as array<struct<i, sample>> by number."""
        width, tree, sure = len(self.masks), f"(?=({trie(self.words)}))", [(p, *divmod(self.at[p], 63)) for p in sorted(self.sure)]
        of_word = {w: [m[k] for m in self.masks] for k, w in enumerate(self.words)}
        number = {p: i for i, p in (wanted or {}).items()}

        @F.arrow_udf("struct<bits:array<bigint>,found:array<struct<i:int,sample:string>>>")
        def of(texts: pa.Array) -> pa.Array:
            texts, find = pc.fill_null(texts, ""), re.compile(tree).finditer
            low = pc.ascii_lower(texts)
            words = pc.split_pattern(low, " ")
            known = words.flatten().dictionary_encode()
            masks = np.zeros((len(known.dictionary), width), dtype="int64")
            for k, word in enumerate(known.dictionary.to_pylist()):
                for m in find(word):
                    masks[k] |= of_word[m[1]]
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))[:-1]]) if len(texts) else []
            out = np.bitwise_or.reduceat(masks[known.indices.to_numpy()], starts) if len(texts) else np.zeros((0, width), "int64")
            at, which, samples = [np.zeros(0, "int64")], [np.zeros(0, "int32")], [pa.array([], "string")]
            for pattern, n, bit in sure:
                rows = np.flatnonzero(out[:, n] >> bit & 1)
                if not len(rows):
                    continue
                if pattern in number:
                    match = pc.extract_regex(texts.take(pa.array(rows)), pattern=f"(?i)(?P<m>{pattern})")
                    hit, sample = match.is_valid().to_numpy(zero_copy_only=False), pc.struct_field(match, "m")
                    told = hit & pc.not_equal(pc.fill_null(sample, ""), "").to_numpy(zero_copy_only=False)
                    at.append(rows[told])
                    which.append(np.full(told.sum(), number[pattern], "int32"))
                    samples.append(sample.filter(pa.array(told)).cast("string"))
                else:
                    hit = pc.match_substring_regex(low.take(pa.array(rows)), pattern=pattern, ignore_case=True).to_numpy(zero_copy_only=False)
                out[rows[~hit], n] &= ~(1 << bit)
            at, which, samples = np.concatenate(at), np.concatenate(which), pa.concat_arrays(samples)
            order = np.lexsort((which, at))
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(texts)))]).astype("int32")
            found = pa.StructArray.from_arrays([pa.array(which[order]), samples.take(pa.array(order))], ["i", "sample"])
            bits = pa.ListArray.from_arrays(np.arange(0, out.size + 1, width, dtype="int32"), out.ravel())
            return pa.StructArray.from_arrays([bits, pa.ListArray.from_arrays(ends, found)], ["bits", "found"])

        # not to be run again for each use of a bit
        return of.asNondeterministic()(folded)

    def can(self, pattern: str) -> Column | None:
        if (k := self.at.get(pattern)) is None:
            return None
        return F.col(f"_gate{k // 63}").bitwiseAND(F.lit(1 << k % 63)) != 0


def _linear(pattern: str) -> bool:
    """Whether the engine without look-around takes a pattern."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern=pattern, ignore_case=True)
    except pa.ArrowInvalid:
        return False
    return True
