"""SentencePiece encoding and decoding as relations.

Words are the unit of work. A word here is a longest run of characters of which every two neighbours stand
side by side in some piece: no piece crosses the border between two words, so a text's ids are its words'
ids one after another, and cutting there loses nothing whatever the script. Each distinct word of all texts
is exploded into its substrings of at most the longest piece's length; an equi-join with the piece table
(fixed size, broadcast) leaves the edges of the word's lattice; edges are grouped by word and folded
with Spark's higher-order ``aggregate``. Two folds run over the same edges:

* ``viterbi_ids``: the path of the highest sum of scores. It is the encoding of a unigram model.
* ``ids``: the model's own rule. The public model is a BPE model, for which the best path is not what its
  library gives: there the best-scored edge that joins two neighbours merges, leftmost first, until none does. The
  state is a bit mask of the borders still standing.

Both decode to the text. Characters without a piece are edges to their bytes.

Texts are read once: a unit (``unit_bytes`` of text) keeps its words as indexes into its own distinct words, which it asks
for once; their ids come back in packed parts, so neither texts nor a row a word of each text are shuffled. Units are
packed by where rows are read: ``docs`` must give the same rows in the same order if a lost executor's part is read again, as files do.
A word of more than ``LONG`` characters, for which a mask has no room, is folded outside of Spark's functions by the
same two rules (the library for ``ids``, a loop for ``viterbi_ids``): results do not depend on the length.

Defined cases: null and empty texts have no ids; rows that repeat an id are encoded each on its own; extra columns are
ignored; empty tables give empty results; a text that holds the mark itself decodes to a space there. Of paths with equal
sums the one whose last piece is longest wins, and so on from the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import words as W
from gleaner.llm.common import chunked, ship, table, text_chars

_MARK = "▁"
LONG = 60
_UNKNOWN = -1e12  # of a character without a piece, below any sum of scores of one word


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _processor(model: bytes | str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model if isinstance(model, bytes) else open(model, "rb").read())


class Pieces:
    """A model's pieces: ``rows`` (piece, id, score) of the ordinary ones, scores and their ranks by id + 1, byte ids, and each id's bytes when decoded."""

    def __init__(self, model: bytes | str):
        sp = _processor(model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in plain]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(len(p) for p, _, _ in self.rows)
        # by id + 1; 0 is a character without a piece, ids that are no ordinary pieces are never looked up
        of = {i: s for _, i, s in self.rows}
        self.scores = [_UNKNOWN] + [of.get(i, _UNKNOWN) for i in range(n)]
        rank = {s: k for k, s in enumerate(sorted(set(self.scores), reverse=True))}
        self.ranks = [rank[s] for s in self.scores]
        self.in_order = in_order(self.rows, self.ranks)
        self.raw = [b"" if sp.is_control(i) else sp.id_to_piece(i).encode() for i in range(n)]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])


class Neighbours:
    """Which two characters stand side by side in some piece."""

    def __init__(self, pieces: list[str]):
        self.pairs = sorted({a + b for p in pieces for a, b in zip(p, p[1:])})
        self._of = None

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Of code points: whether a word starts there."""
        if self._of is None:
            chars = sorted({c for p in self.pairs for c in p})
            of = np.zeros(0x110000, np.int32)
            of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
            side = np.zeros((len(chars) + 1, len(chars) + 1), bool)
            side[[of[ord(p[0])] for p in self.pairs], [of[ord(p[1])] for p in self.pairs]] = True
            self._of, self._side = of, side.ravel()
            self._n = len(chars) + 1
        k = self._of[codes]
        out = np.ones(len(codes), bool)
        out[1:] = ~self._side[k[:-1] * self._n + k[1:]]
        return out

    def __getstate__(self):
        return {"pairs": self.pairs, "_of": None}


def marked(text: str | None) -> str:
    """The text as the model sees it: a mark before it and for each space."""
    return _MARK + text.replace(" ", _MARK) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _runs(texts: list[str], near: Neighbours, size: int = 1 << 19):
    """(first text, text after the last, their characters): some ``size`` at a time, longer texts cut between words."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if len(t) > size:
            if i > lo:
                yield lo, i, "".join(texts[lo:i])
            at = 0
            while at < len(t):
                end, look = at + size, 4096
                while end < len(t):
                    cut = np.flatnonzero(near.starts(_codes(t[end - 1 : end + look]))[1:])
                    if len(cut):
                        end += int(cut[0])
                        break
                    end, look = end + look, look * 2
                yield i, i + 1, t[at:end]
                at = end
            lo, held = i + 1, 0
            continue
        held += len(t)
        if held > size:
            yield lo, i + 1, "".join(texts[lo : i + 1])
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts), "".join(texts[lo:])


def split(texts: list[str], near: Neighbours) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of marked texts: their distinct words, the index of each word of all texts, and each text's number of words."""
    hashes, strings, heads, index, counts, base = [], [], [], [], np.zeros(len(texts), np.int64), 0
    for lo, hi, run in _runs(texts, near):
        if not run:
            continue
        codes = _codes(run)
        start = near.starts(codes)
        bounds = np.cumsum([len(t) for t in texts[lo:hi]]) if hi > lo + 1 else np.array([len(run)])
        start[bounds[:-1][bounds[:-1] < len(run)]] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(codes))
        counts[lo:hi] += np.diff(np.searchsorted(at, bounds), prepend=0)
        h, first, inverse = np.unique(W.hash_values(W._mix(codes.astype(np.uint64) + np.uint64(77)), at, end), return_index=True, return_inverse=True)
        hashes.append(h)
        lead = np.append(codes, np.zeros(5, codes.dtype)).astype(np.uint64) & np.uint64(0xFFF)
        heads.append(sum(np.where(at[first] + k < end[first], lead[at[first] + k], np.uint64(0)) << np.uint64(12 * (4 - k)) for k in range(5)))
        strings += [run[a:b] for a, b in zip(at[first].tolist(), end[first].tolist())]
        index.append((inverse + base).astype(np.uint32))
        base += len(h)
    if not hashes:
        return [], np.zeros(0, np.uint32), counts
    _, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    index = inverse.astype(np.uint32)[np.concatenate(index)]
    # frequent words get low indexes, and those of equal frequency lie in order of their first characters: both pack well
    by = np.lexsort((np.concatenate(heads)[first], -np.bincount(index, minlength=len(first))))
    rank = np.empty(len(by), np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    return [strings[i] for i in first[by].tolist()], rank[index], counts


def _squeeze(*arrays: np.ndarray) -> bytes:
    """32-bit arrays as byte planes, compressed."""
    raw = [np.array([len(a) for a in arrays], "<u4").tobytes()]
    raw += [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    raw = b"".join(raw)
    return len(raw).to_bytes(8, "little") + len(arrays).to_bytes(1, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unsqueeze(raw: bytes) -> list[np.ndarray]:
    k = raw[8]
    raw = np.frombuffer(pa.Codec("zstd").decompress(raw[9:], int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8)
    out, at = [], 4 * k
    for n in raw[: 4 * k].view("<u4").tolist():
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, -1).T).view("<u4").ravel())
        at += 4 * n
    return out


def _units(sent, size: int):
    def pack(unit: int, ids: list, texts: list) -> pa.RecordBatch:
        words, tokens, counts = split([marked(t) for t in texts], sent.value)
        md5 = [hashlib.md5((t or "").replace(_MARK, " ").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
        body = pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([counts]), pa.array([md5]), pa.array([_squeeze(tokens)], pa.binary()), pa.array([words], pa.list_(pa.string()))],
            names=["doc_id", "n", "md5", "tokens", "words"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(body)
        return pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["unit", "payload"])

    def run(batches):
        unit, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(i)
                texts.append(t)
                held += len(t or "") + 16
                if held >= size:
                    yield pack(unit, ids, texts)
                    unit, ids, texts, held = unit + 1, [], [], 0
        if ids:
            yield pack(unit, ids, texts)

    return run


def _open(payload: bytes, *fields: int) -> pa.RecordBatch:
    """Of a unit: doc_id, n, md5, tokens, words, or those of these places."""
    with pa.ipc.open_stream(payload, options=pa.ipc.IpcReadOptions(included_fields=list(fields))) as r:
        return r.read_next_batch()


def _asks(batches):
    for b in batches:
        for unit, payload in zip(b.column("unit").to_pylist(), b.column("payload")):
            words = _open(payload.as_buffer(), 4).column(0).flatten()
            for lo in range(0, len(words), 20_000):
                part = words.slice(lo, 20_000)
                yield pa.RecordBatch.from_arrays([pa.array([unit] * len(part)), pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), part], names=["unit", "at", "word"])


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """word, edges: the sorted codes of the edges of each distinct ``word``.

    A code holds end, start and id + 1 of an edge; 0 there is the edge of a character without a piece.
    """
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, n))).alias("e"))
    sub = F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s"))
    # the piece table has a fixed size, whatever the input
    edges = spans.withColumn("piece", sub).join(F.broadcast(pieces.select("piece", "id")), "piece", "left").where(F.col("id").isNotNull() | (F.col("e") - F.col("s") == 1))
    code = F.col("e").cast("long") * (1 << 40) + F.col("s") * F.lit(1 << 32) + F.coalesce(F.col("id") + 1, F.lit(0))
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(code)).alias("edges"))


def _end(x: Column) -> Column:
    return F.shiftright(x, 40).cast("int")


def _start(x: Column) -> Column:
    return F.shiftright(x, 32).bitwiseAND(255).cast("int")


def _piece(x: Column) -> Column:
    """Id + 1 of an edge."""
    return x.bitwiseAND(2**31 - 1).cast("int")


def _constant(values: list, kind: str) -> Column:
    """One literal array of the vocabulary's size (folded when the plan is made)."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def viterbi_fold(edges: Column, scores: list[float]) -> Column:
    """Codes along the path of the highest sum, edge after edge in order of their ends; then back from the end.

    ``scores`` are by id + 1. The state is the best sum and the last edge of each place before ``e``, and of ``e`` so far.
    """
    table_ = _constant(scores, "double")
    names = ("sums", "back", "e", "sum", "code")
    state = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, names)])

    def step(st: Column, x: Column) -> Column:
        same, total = st["e"] == x["e"], F.get(st["sums"], x["s"]) + x["score"]
        fresh = F.when(x["s"] == st["e"], st["sum"] + x["score"]).otherwise(total)
        return (
            F.when(same & (total <= st["sum"]), st)
            .when(same, state(st["sums"], st["back"], st["e"], total, x["code"]))
            .otherwise(state(F.concat(st["sums"], F.array(st["sum"])), F.concat(st["back"], F.array(st["code"])), x["e"], fresh, x["code"]))
        )

    def back(st: Column) -> Column:
        start = F.struct(st["e"].alias("at"), F.array().cast("array<bigint>").alias("path"))
        way = lambda p, c: F.when(_end(c) == p["at"], F.struct(_start(c).alias("at"), F.concat(F.array(c), p["path"]).alias("path"))).otherwise(p)
        # the first place has no edge; its 0 ends at 0, where the walk stops
        return F.aggregate(F.reverse(F.concat(F.slice(st["back"], F.lit(2), F.size(st["back"])), F.array(st["code"]))), start, way, lambda p: p["path"])

    start = state(F.array(), F.array(), F.lit(0), F.lit(0.0), F.lit(0)).cast("struct<sums:array<double>,back:array<bigint>,e:int,sum:double,code:bigint>")
    read = F.transform(edges, lambda x: F.struct(_end(x).alias("e"), _start(x).alias("s"), F.get(table_, _piece(x)).alias("score"), x.alias("code")))
    return F.aggregate(read, start, step, back)


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def in_order(pieces: list[tuple[str, int, float]], ranks: list[int]) -> bool:
    """Whether every piece comes from two parts of better scores, so that merging never opens a better merge.

    A piece's parts are the same in every word: what lies around it has no say while its own characters merge. So merging
    each piece by itself shows the parts. A piece that is never made by merging counts for nothing.
    """
    rank = {p: ranks[i + 1] for p, i, _ in pieces}
    for whole, own in rank.items():
        parts = list(whole)
        while len(parts) > 2:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
            if best is None or best[0] == own:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2 and own <= max((rank[x] for x in parts if len(x) > 1), default=-1):
            return False
    return True


def merge_fold(edges: Column, ranks: list[int], once: bool = False) -> Column:
    """Codes that a BPE model leaves: the best-scored edge over two neighbours merges them, leftmost first, until none can.

    ``ranks`` are by id + 1, 0 for the best score. The state is a bit for each border that stands. With ``once``
    (see ``in_order``) each edge is tried one time, best first, which is the same.
    """
    rank = _constant(ranks, "bigint")
    masks = lambda s, e: (_bit(s).bitwiseOR(_bit(e)), _bit(e) - _bit(s) * 2)  # noqa: E731  ends; places between them
    wide = F.filter(edges, lambda x: _end(x) - _start(x) >= 2)
    order = F.sort_array(F.transform(wide, lambda x: F.get(rank, _piece(x)) * 65536 + _start(x) * 256 + _end(x)))

    def with_masks(m: Column) -> Column:
        outer, inner = masks(F.shiftright(m, 8).bitwiseAND(255).cast("int"), m.bitwiseAND(255).cast("int"))
        return F.struct(outer.alias("outer"), inner.alias("inner"))

    n = _end(F.element_at(edges, -1))
    steps = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))

    def fold(merges: Column) -> Column:
        def step(borders: Column, _: Column) -> Column:
            fits = F.filter(merges, lambda m: (borders.bitwiseAND(m["outer"]) == m["outer"]) & (F.bit_count(borders.bitwiseAND(m["inner"])) == 1))
            inner = F.get(fits, F.lit(0))["inner"]
            # the sign tells that nothing merges any more
            return F.when(borders < 0, borders).otherwise(F.coalesce(borders.bitwiseAND(F.bitwise_not(inner)), borders.bitwiseOR(F.lit(-(2**63)))))

        def try_one(borders: Column, m: Column) -> Column:
            fits = (borders.bitwiseAND(m["outer"]) == m["outer"]) & (F.bit_count(borders.bitwiseAND(m["inner"])) == 1)
            return F.when(fits, borders.bitwiseAND(F.bitwise_not(m["inner"]))).otherwise(borders)

        def standing(borders: Column) -> Column:
            def stands(x: Column) -> Column:
                outer, inner = masks(_start(x), _end(x))
                return (borders.bitwiseAND(outer) == outer) & (borders.bitwiseAND(inner) == 0)

            return F.filter(edges, stands)

        return F.aggregate(merges if once else steps, _bit(n + 1) - 1, try_one if once else step, standing)

    # a lambda's variable is computed once, a column might be put into every step
    return F.get(F.transform(F.array(F.transform(order, with_masks)), fold), F.lit(0))


def ids_of(word: Column, codes: Column, byte_ids: list[int]) -> Column:
    """Ids of a path; a character without a piece becomes its bytes."""
    table_ = _constant(byte_ids, "int")

    def bytes_(x: Column) -> Column:
        raw = F.hex(F.encode(F.substring(word, _start(x) + 1, _end(x) - _start(x)), "UTF-8"))
        of = lambda k: F.get(table_, F.conv(F.substring(raw, (k * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
        return F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), of)

    plain = F.transform(codes, lambda x: _piece(x) - 1)
    return F.when(F.array_contains(plain, -1), F.flatten(F.transform(codes, lambda x: F.when(_piece(x) > 0, F.array(_piece(x) - 1)).otherwise(bytes_(x))))).otherwise(plain)


def best_path(word: str, score: dict[str, tuple[float, list[int]]], longest: int, byte_ids: list[int]) -> list[int]:
    """What ``viterbi_fold`` gives, for one word of any length."""
    sums, back, ids = [0.0], [0], [[]]
    for e in range(1, len(word) + 1):
        best = None
        for s in range(max(0, e - longest), e):
            piece = word[s:e]
            known = score.get(piece)
            if known is None and s == e - 1:
                known = (_UNKNOWN, [byte_ids[b] for b in piece.encode("utf-8", "replace")])
            if known is not None and (best is None or sums[s] + known[0] > best[0]):
                best = (sums[s] + known[0], s, known[1])
        sums.append(best[0])
        back.append(best[1])
        ids.append(best[2])
    out, e = [], len(word)
    while e:
        out.append(ids[e])
        e = back[e]
    return [i for part in reversed(out) for i in part]


def _long_words(sent):
    def run(batches):
        model = sent.value
        sp, pieces = _processor(model), Pieces(model)
        score = {p: (s, [i]) for p, i, s in pieces.rows}
        lead = len(sp.encode("\n"))
        for b in chunked(batches, 256):
            ids, best = [], []
            for w in b.column("word").to_pylist():
                if w.startswith(_MARK):
                    ids.append(sp.encode(w[1:].replace(_MARK, " ")))
                else:  # a word after a line break and the like: take off what a leading space adds
                    ids.append(sp.encode("\n" + w.replace(_MARK, " "))[lead:])
                best.append(best_path(w, score, pieces.longest, pieces.bytes))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, kind), pa.array(best, kind)], names=["word", "ids", "viterbi_ids"])

    return run


def encode_short(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, ids, viterbi_ids of distinct ``word`` rows of at most ``LONG`` characters, where they are."""
    rows = words.sparkSession.createDataFrame(pieces.rows, "piece string, id int, score double")
    found = lattice(words, rows, pieces.longest)
    merged = merge_fold(F.col("edges"), pieces.ranks, pieces.in_order)
    folded = found.select("word", merged.alias("merged"), viterbi_fold(F.col("edges"), pieces.scores).alias("best"))
    word = F.col("word")
    return folded.select("word", ids_of(word, F.col("merged"), pieces.bytes).alias("ids"), ids_of(word, F.col("best"), pieces.bytes).alias("viterbi_ids"))


def encode_asked(asked: DataFrame, pieces: Pieces, model, tasks: int) -> DataFrame:
    """unit, at, ids, viterbi_ids of the words (unit, at, word) that units ask for.

    Words are shuffled once: the distinct words, their lattices and the join back to those who ask share one exchange
    by word (hence the minima: a reader of all columns keeps Spark from making a second, narrower one). A word
    has a row for each unit that holds it, never for each text.
    """
    out = None
    for long in (False, True):
        own = asked.where((F.length("word") > LONG) == long).repartition(tasks, "word")
        words = own.groupBy("word").agg(F.min("unit").alias("u"), F.min("at").alias("a")).where(F.col("u").isNotNull() & F.col("a").isNotNull()).select("word")
        known = words.mapInArrow(_long_words(model), "word string, ids array<int>, viterbi_ids array<int>") if long else encode_short(words, pieces)
        met = own.join(known.hint("shuffle_hash"), "word").select("unit", "at", "ids", "viterbi_ids")
        out = met if out is None else out.unionByName(met)
    return out


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy())


def _spread(values: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs [begin, begin + len) of values one after another."""
    upto = np.cumsum(lens)
    return values[np.repeat(begin - (upto - lens), lens) + np.arange(upto[-1] if len(upto) else 0)]


def _answers(rows: int = 1 << 18):
    def pack(batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches)
        unit, at = t.column("unit").to_numpy(), t.column("at").to_numpy()
        sides = []
        for name in ("ids", "viterbi_ids"):
            values, lens = _flat(t.column(name))
            sides.append([values, np.cumsum(lens) - lens, lens])
        # a best path that is the model's too is sent as empty
        (v, b, n), (v2, b2, n2) = sides
        same = np.flatnonzero(n == n2)
        differ = np.bincount(np.repeat(same, n[same]), _spread(v, b[same], n[same]) != _spread(v2, b2[same], n[same]), len(n))
        sides[1][2] = np.where((n == n2) & (differ == 0), 0, n2)
        order = np.lexsort((at, unit))
        units, cut = np.unique(unit[order], return_index=True)
        parts = []
        for own in np.split(order, cut[1:]):
            parts.append(_squeeze(np.diff(at[own], prepend=0), *(x for v, b, n in sides for x in (n[own], _spread(v, b[own], n[own])))))
        return pa.RecordBatch.from_arrays([pa.array(units), pa.array(parts, pa.binary())], names=["unit", "part"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return run


_ENCODED = "doc_id long, ids array<int>, viterbi_ids array<int>, source_md5 string"


def _texts(ids: pa.ListArray, raw: list[bytes], rows: int = 64) -> list[str | None]:
    """Texts of ids: their bytes put together, marks turned back into spaces."""
    lens = np.array([len(r) for r in raw], np.int64)
    begin = np.cumsum(lens) - lens
    flat, texts = np.frombuffer(b"".join(raw), np.uint8), []
    for lo in range(0, len(ids), rows):
        part = ids.slice(lo, rows)
        own = part.flatten().to_numpy(zero_copy_only=False)
        data = _spread(flat, begin[own], lens[own]).tobytes()
        at = np.concatenate([[0], np.cumsum(lens[own])])[np.concatenate([[0], np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])].tolist()
        for known, i, j in zip(part.is_valid().to_pylist(), at, at[1:]):
            t = data[i:j].decode("utf-8", "replace").replace(_MARK, " ")
            texts.append((t[1:] if t.startswith(" ") else t) if known else None)
    return texts


def _finish(sent):
    def run(key: tuple[pa.Scalar, ...], own: pa.Table, parts: pa.Table) -> pa.Table:
        """Documents of one unit with their ids (and the texts of these, if the pieces' bytes are given)."""
        kind = pa.list_(pa.int32())
        if not own.num_rows:
            out = pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], kind), "viterbi_ids": pa.array([], kind), "source_md5": pa.array([], pa.string())})
            return out.append_column("text", pa.array([], pa.string())) if sent else out
        own = _open(own.column("payload")[0].as_buffer(), 0, 1, 2, 3)
        doc_id, md5 = own.column("doc_id").flatten(), own.column("md5").flatten()
        tokens, counts = _unsqueeze(own.column("tokens")[0].as_py())[0], own.column("n").flatten().to_numpy()
        got = [_unsqueeze(p) for p in parts.column("part").to_pylist()]
        of = lambda k: np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.uint32)
        at = np.concatenate([np.cumsum(g[0]) for g in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        # where in ``values`` each word's ids are: the model's, and then the best path where it is another
        values, spans = np.concatenate([of(2), of(4)]).astype(np.int32), []
        begin, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for lens, base in ((of(1).astype(np.int64), 0), (of(3).astype(np.int64), len(of(2)))):
            fresh = lens > 0
            begin[at[fresh]], n[at[fresh]] = (base + np.cumsum(lens) - lens)[fresh], lens[fresh]
            spans.append((begin.copy(), n.copy()))
        del got
        first, out, lo = np.cumsum(counts) - counts, [], 0
        while lo < len(counts):  # some 250,000 words at a time
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + 250_000)))
            mine, cols = tokens[first[lo] : first[hi - 1] + counts[hi - 1]], []
            for begin, n in spans:
                upto = np.concatenate([[0], np.cumsum(n[mine])])
                offsets = np.append(upto[first[lo:hi] - first[lo]], upto[-1]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(_spread(values, begin[mine], n[mine]))))
            names = ["doc_id", "ids", "viterbi_ids", "source_md5"]
            b = pa.RecordBatch.from_arrays([doc_id.slice(lo, hi - lo), *cols, md5.slice(lo, hi - lo)], names=names)
            out.append(b.append_column("text", pa.array(_texts(cols[0], sent.value), pa.string())) if sent else b)
            lo = hi
        return pa.Table.from_batches(out)

    return run


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, unit_bytes: int = 20 << 20, chars_a_task: int = 5_000_000, with_text: bool = False,
) -> DataFrame:
    """doc_id, ids, viterbi_ids, source_md5 (of the text, marks read as spaces) of every row; and ``text``, decoded from ids, if asked for."""
    spark = docs.sparkSession
    ship(spark)
    proto = open(model or default_model(), "rb").read()
    pieces = Pieces(proto)
    near = spark.sparkContext.broadcast(Neighbours([p for p, _, _ in pieces.rows]))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a word's lattice is some hundred times its size, so tasks are cut by the amount of text
    tasks = max(2, -(-text_chars(src) // chars_a_task))
    # units are shuffled once, and read from there by those who ask and by those who get the answers
    units = src.mapInArrow(_units(near, unit_bytes), "unit long, payload binary").repartition("unit")
    asked = units.mapInArrow(_asks, "unit long, at int, word string")
    met = encode_asked(asked, pieces, spark.sparkContext.broadcast(proto), tasks)
    parts = met.mapInArrow(_answers(), "unit long, part binary")
    sent = spark.sparkContext.broadcast(pieces.raw) if with_text else None
    return units.groupBy("unit").cogroup(parts.groupBy("unit")).applyInArrow(_finish(sent), _ENCODED + ", text string" * with_text)


def _decode(sent, ids_col: str, out: str):
    def run(batches):
        for b in chunked(batches, 1024):
            yield b.append_column(out, pa.array(_texts(b.column(ids_col), sent.value), pa.string()))

    return run


def decode(encoded: DataFrame, ids_col: str = "ids", model: str | None = None, out: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids: the pieces' bytes put together, marks turned back into spaces; null ids give null."""
    ship(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(Pieces(open(model or default_model(), "rb").read()).raw)
    rest = encoded.drop(out)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields] + [f"`{out}` string"])
    return rest.mapInArrow(_decode(sent, ids_col, out), schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, viterbi_ids, decoded (from ids), round_trip (``decoded`` is the document's text, marks read as spaces)."""
    out = encode(table(spark, sf_dir, "documents"), with_text=True)
    return out.select("doc_id", "ids", "viterbi_ids", F.col("text").alias("decoded"), (F.md5("text") == F.col("source_md5")).alias("round_trip"))
