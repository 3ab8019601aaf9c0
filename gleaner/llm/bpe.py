"""Token ids of the public word-level BPE (lower case, ``</w>`` word ends) for batches of whole texts.

Three paths give the same ids. Texts of ASCII and Latin letters without apostrophes are cut into
words with numpy and each distinct word is encoded once a batch. Other texts of well-known scripts
are cut by the vocabulary's own pattern. Anything else (control characters, rare scripts, strings of
special tokens) goes to the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from gleaner.llm import words as W

_END = "\x01"  # stands for the end of a word; texts that hold it take the library's path
_SAFE_ASCII = bytes([9, 10, 13, *(b for b in range(32, 127) if b != 39)])
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\x88\x8a-\xbf])*")
_KNOWN = re.compile("[\t\n\r -~¡-¬®-įı-ɏΆ-΢Τ-ԯ‐-‧‰-⁞€、-ヿ一-龥가-힣]*")
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2


def _byte_chars() -> dict[str, int]:
    """The usual printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    def __init__(self, vocabulary: str):
        """``vocabulary`` is the text of the vocabulary's file."""
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        spec = json.loads(vocabulary)
        special = {t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        chars = _byte_chars()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if i not in special:
                end = token.endswith("</w>")
                ranks[bytes(chars[c] for c in (token[:-4] if end else token)) + b"\x01" * end] = i
        # merging by rank of the merged bytes equals merging by the vocabulary's list: ids are in its
        # order, and "last byte + end" pairs, which come before all merges, have the lowest ids
        self.words = tiktoken.Encoding("word_bpe", pat_str=_END + "|[^" + _END + "]+" + _END, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for t, i in ranks.items() if len(t) > 1 and t.endswith(b"\x01")]] = True

    def _encode_words(self, joined: str) -> np.ndarray:
        return np.array(self.words._core_bpe.encode_ordinary(joined), np.uint32)

    def _latin(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids."""
        raw = b" ".join(raws)
        bounds = np.cumsum([len(r) + 1 for r in raws])
        h, starts, ends = [], [], []
        for lo, hi in _pieces(raw):
            b = np.frombuffer(raw, np.uint8, hi - lo, lo)
            s, e = _spans(b)
            h.append(W.hash_spans(b, s, e))
            starts.append(s + lo)
            ends.append(e + lo)
        h, starts, ends = np.concatenate(h), np.concatenate(starts), np.concatenate(ends)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(len(raws), np.int64)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids = self._encode_words(b"\x01".join([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]).decode() + _END)
        stop = np.flatnonzero(self.ends[ids]) + 1
        lens = np.diff(stop, prepend=0)
        begin = stop - lens
        n = lens[inverse]
        upto = np.cumsum(n)
        out = ids[np.repeat(begin[inverse] - (upto - n), n) + np.arange(upto[-1])]
        last = np.searchsorted(starts, bounds)
        total = np.concatenate([[0], upto])[last]
        return out, np.diff(total, prepend=0)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and each text's number of ids."""
        latin, raws, slow = [], [], {}
        for i, t in enumerate(texts):
            if not t:
                continue
            raw = t.lower().encode("utf-8", "surrogatepass")
            if _LATIN.fullmatch(raw.translate(None, _SAFE_ASCII)) and "<|" not in t and "İ" not in t:
                latin.append(i)
                raws.append(raw)
            elif _KNOWN.fullmatch(t) and "<|" not in t:
                found = self.pattern.findall(unicodedata.normalize("NFC", t).lower())
                slow[i] = self._encode_words(_END.join(found) + _END) if found else np.zeros(0, np.uint32)
            else:
                t = t.encode("utf-8", "replace").decode()
                slow[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
        counts = np.zeros(len(texts), np.int64)
        ids, n = self._latin(raws) if raws else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        counts[latin] = n
        for i, x in slow.items():
            counts[i] = len(x)
        if not slow:
            return ids, counts
        at = np.concatenate([[0], np.cumsum(n)])
        of = {i: ids[at[k] : at[k + 1]] for k, i in enumerate(latin)} | slow
        return np.concatenate([of[i] for i in sorted(of)]), counts


def _spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = _CLASS[b]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (c[1:] == 2)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(c))
    keep = c[at] != 0
    return at[keep], end[keep]


def _pieces(raw: bytes, size: int = 1 << 20):
    """Cuts at spaces, about ``size`` bytes each: bounds memory, whatever the texts' lengths."""
    lo = 0
    while lo < len(raw):
        hi = raw.find(b" ", lo + size) + 1 or len(raw)
        yield lo, hi
        lo = hi
