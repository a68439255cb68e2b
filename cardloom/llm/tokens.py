"""Token ids through the tokenizers library, with a cache of encoded pieces.

Texts are cut before each space that stands between two other characters than
white space. Both vocabularies always break there, so the pieces' ids, joined,
are the text's ids, and a part seen before needs no second run of the merges.
Distinct pieces are cut once more, into parts, between a letter and punctuation,
where both vocabularies break too. All this, and putting ids together again, is
done by whole Arrow and numpy columns; Python sees each distinct part of a chunk
once. New parts are encoded many at a time as one text, whose ids are then split
where a part must begin or end.

The strings of special tokens in a text are ordinary text, as the vocabularies'
own description sets it (``encode_special_tokens``), so a text can't forge the
end of a document; with ``specials`` they become those tokens, and texts that
hold one are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts kept per worker; the cache is emptied when full.
CACHE_PARTS = 400_000
LONGEST_PART = 64
#: Bytes of text worked on at once (one text at least), and parts encoded as one text.
CHUNK_BYTES = 4 << 20
JOINED = 256
#: Stands alone between joined parts where white space is dropped; parts that hold it are encoded apart.
SEPARATOR = "\x01"
#: Marks where a piece is cut, if spaces count; texts that hold it are encoded apart.
MARK = "\x02"
# White space, as a class of the pattern language.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Letters that stay one letter when composed and lower-cased (so none but U+0130 missing), and ASCII punctuation.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
SYMBOLS = r"!-/:-@\[-`{-~"


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + size]``, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """``batch(texts)`` gives each text's ids as a numpy array of ``dtype``.

    ``lead`` tells that a piece keeps the space before it (byte-level
    vocabularies); otherwise white space is dropped by the vocabulary.
    """

    def __init__(self, path: str, *, lead: bool, specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not specials
        self.lead = lead
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()] if specials else []
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.cache: dict[str, bytes] = {}
        self.begins, self.ends = np.zeros(size, bool), np.zeros(size, bool)  # ids that begin with a space, that end a word
        for token, i in self.tok.get_vocab().items():
            self.begins[i], self.ends[i] = token.startswith("Ġ"), token.endswith("</w>")
        mark = self._encode([SEPARATOR])[0]
        self.mark = mark[0] if len(mark) == 1 else None

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str], kind: str) -> list[bytes]:
        """Ids of each part from one run over all; apart where the splits don't come out even."""
        n, width, gap = len(parts), self.dtype.itemsize, 0
        cuts = None
        if kind == "led":  # each with the only space at its head
            ids = self._encode(["".join(parts)])[0]
            at = np.flatnonzero(self.begins[ids])
            if len(at) == n and at[0] == 0:
                cuts = np.r_[at, len(ids)]
        elif kind == "letters":  # one word each
            ids = self._encode([" ".join(parts)])[0]
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == n and at[-1] == len(ids):
                cuts = np.r_[0, at]
        elif kind == "loose" and self.mark is not None and not any(SEPARATOR in p for p in parts):
            ids = self._encode([f" {SEPARATOR} ".join(parts)])[0]
            at = np.flatnonzero(ids == self.mark)
            if len(at) == n - 1:
                cuts, gap = np.r_[-1, at, len(ids)], width
        if cuts is None:
            return [i.tobytes() for i in self._encode(parts)]
        raw, cuts = ids.tobytes(), (cuts * width).tolist()
        return [raw[a + gap : b] for a, b in zip(cuts, cuts[1:])]

    def _table(self, parts: pa.Array) -> list[bytes]:
        """Ids of distinct parts, from the cache or encoded now."""
        names = parts.to_pylist()
        found = list(map(self.cache.get, names))
        new = np.array([v is None for v in found], bool)
        if len(self.cache) + new.sum() > CACHE_PARTS:
            self.cache.clear()
        if self.lead:
            simple = np.asarray(pc.starts_with(parts, " "))
            kinds = (("led", new & simple), ("apart", new & ~simple))
        else:
            simple = np.asarray(pc.match_substring_regex(parts, f"^[{LETTERS}]+$"))
            kinds = (("letters", new & simple), ("loose", new & ~simple))
        for kind, which in kinds:
            rows = np.flatnonzero(which).tolist()
            for k in range(0, len(rows), JOINED):
                some = rows[k : k + JOINED]
                for j, found[j] in zip(some, self._joined([names[i] for i in some], kind), strict=True):
                    if len(names[j]) <= LONGEST_PART and len(self.cache) < CACHE_PARTS:
                        self.cache[names[j]] = found[j]
        return found

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct pieces, and how many each has."""
        if self.lead:
            pieces = pc.binary_join_element_wise(pa.scalar(" ", pieces.type), pieces, pa.scalar("", pieces.type))
            split = pc.split_pattern(pc.replace_substring_regex(pieces, f"([{LETTERS}])([{SYMBOLS}]+)$", rf"\1{MARK}\2"), MARK)
        else:
            apart = pc.replace_substring_regex(pieces, f"([{LETTERS}])([{SYMBOLS}])", r"\1 \2")
            split = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        parts = split.values.dictionary_encode()
        table = self._table(parts.dictionary)
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        codes = np.asarray(parts.indices)
        ids = spread(np.frombuffer(b"".join(table), self.dtype), (np.cumsum(sizes) - sizes)[codes], sizes[codes])
        return ids, np.diff(np.r_[0, np.cumsum(sizes[codes])][np.asarray(split.offsets)])

    def _cut(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of texts in which every space may be cut at."""
        split = pc.split_pattern(texts, " ")
        bounds = np.asarray(split.offsets)
        pieces = split.values
        first = np.zeros(len(pieces), bool)
        if self.lead:
            first[bounds[:-1]] = True  # a text's first piece has no space before it
        rest = pieces.filter(pa.array(~first)).dictionary_encode()
        heads = pieces.filter(pa.array(first)).dictionary_encode()
        every, sizes = self._pieces(rest.dictionary)
        apart = self._encode(heads.dictionary.to_pylist())
        every, sizes = np.concatenate([every, *apart]), np.r_[sizes, np.array([len(a) for a in apart], np.int64)]
        codes = np.empty(len(pieces), np.int64)
        codes[~first] = np.asarray(rest.indices)
        codes[first] = np.asarray(heads.indices) + len(rest.dictionary)
        flat = spread(every, (np.cumsum(sizes) - sizes)[codes], sizes[codes])
        places = np.r_[0, np.cumsum(sizes[codes])][bounds].tolist()
        for a, b in zip(places, places[1:]):
            yield flat[a:b]

    def _chunk(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = np.zeros(len(texts), bool)
        if self.lead:  # a space beside white space, at either end of a text too, is no place to cut at
            whole |= np.asarray(pc.match_substring_regex(texts, f"^ | $| [{WHITE}]|[{WHITE}] |{MARK}"))
        for token in self.special:
            whole |= np.asarray(pc.match_substring(texts, token, ignore_case=True))
        if not whole.any():
            yield from self._cut(texts)
            return
        cut, apart = self._cut(texts.filter(pa.array(~whole))), iter(self._encode(texts.filter(pa.array(whole)).to_pylist()))
        for w in whole.tolist():
            yield next(apart if w else cut)

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in order; null is empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        begin = 0
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
            yield from self._chunk(texts.slice(begin, end - begin))
            begin = end

    def ids(self, text: str) -> np.ndarray:
        return next(self.batch(pa.array([text], pa.string())))


_ENCODERS: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, *, lead: bool, specials: bool = False) -> Encoder:
    """One encoder, and so one cache, for a worker process."""
    key = (path, lead, specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, lead=lead, specials=specials)
    return _ENCODERS[key]
