"""Fill-in-the-middle transformation by a two-pass streaming matcher.

A text is a row of units (code points by default; any pattern that tiles the text, such as words or lines). Two ranks drawn from a
hash of the document's id cut it into prefix, middle and suffix, which are put out in the order that a model learns to fill in
from: prefix, suffix, middle (psm), or suffix first (spm). The first pass runs a lazy iterator of matches and only counts units;
the second starts another and advances it to the lesser rank, then on to the greater. The iterator goes in strides of ``STRIDE`` units,
and one by one within the last stride, so that a unit costs a few nanoseconds; neither units nor their places are ever stored: beside
the text itself, memory is constant.

Texts that hold a marker stay plain, so ``restore`` can always tell the parts: a marker cannot begin within another one, hence the only
markers in a transformed text are the three that were put in.

Defined cases: a null text counts as empty, and an empty text is plain with no units; a null id hashes as an empty one; rows that repeat
an id are each cut by their own text; equal rows give equal results; extra columns are ignored, whatever their names; an empty table gives an
empty result; of a text that begins with unmatched characters, they belong to the first unit, all others to the unit before them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import chunked, ship, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT, WORD, LINE = "(?s:.)", r"\s*\S+(?:\s+\Z)?|\s+\Z", r"[^\n]*\n|[^\n]+\Z"
STRIDE = 256
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Matcher:
    """Counts the units of a text and finds where they begin, without keeping them."""

    def __init__(self, unit: str = CODE_POINT):
        self.one = re.compile(unit)
        self.many = re.compile(f"(?>{unit}){{{STRIDE}}}")  # atomic: a unit is never taken apart to fill a stride
        if self.one.match("") or self.one.match("a b\n") is None:
            raise ValueError("a unit must match something, and units must tile a text")

    def strides(self, text: str) -> Iterator[int]:
        """Where each full stride ends, lazily."""
        at = 0
        while m := self.many.match(text, at):
            at = m.end()
            yield at

    def count(self, text: str) -> int:
        """The first pass."""
        at = n = 0
        for at in self.strides(text):
            n += STRIDE
        return n + sum(1 for _ in self.one.finditer(text, at))

    def cuts(self, text: str, low: int, high: int) -> tuple[int, int]:
        """The second pass: where the units end that make up the first ``low`` and the first ``high``, low <= high."""
        found, at, n = [], 0, 0
        steps = self.strides(text)
        for rank in (low, high):
            while rank - n >= STRIDE:  # whole strides lie before the rank
                at, n = next(steps), n + STRIDE
            found.append(self._unit(text, at, rank - n))
        return found[0], found[1]

    def _unit(self, text: str, at: int, k: int) -> int:
        """Where the k-th match from ``at`` on begins; the end of the text after the last."""
        if k == 0:
            return at
        m = next(islice(self.one.finditer(text, at), k, None), None)
        return len(text) if m is None else m.start()


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a document's id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def cut(text: str, doc_id: int | None, matcher: Matcher, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, lengths of prefix and middle (code points), and the transformed text."""
    n = matcher.count(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = matcher.cuts(text, a, b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transform(unit: str, seed: int, rate: int, spm: int):
    def run(batches):
        matcher = Matcher(unit)
        for b in chunked(batches, 64):
            ids = b.column(0)
            rows = [cut(t or "", i, matcher, seed, rate, spm) for i, t in zip(ids.to_pylist(), b.column(1).to_pylist())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and output of every document.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of these with the suffix first. A narrow step: nothing is shuffled.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_transform(unit, seed, rate, spm), OUTPUT)


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made from, from nothing but the output and its form."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
r AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, substring(t, 1, p) AS pre, substring(t, p + 1, q - p) AS mid, substring(t, q + 1) AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
