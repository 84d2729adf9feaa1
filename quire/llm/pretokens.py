"""Byte-level BPE pre-tokens of many texts at once, in numpy, cut exactly where the tokenizers library cuts them.

The library is asked for the class of each code point it meets (once per process), so its own Unicode tables hold.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from quire.llm.shared import HashTable, flat, ragged, slices, span_hashes

#: Bytes of text worked on at once; with the arrays made from them some 100 MB.
CHUNK = 1_000_000
#: A longer text is cut at a place where a pre-token starts for certain.
LONG = 4 << 20
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 1, 2, 3, 4, 255
#: The contractions of the byte-level pattern, by length.
SUFFIXES = {1: ("s", "t", "m", "d"), 2: ("re", "ve", "ll")}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


def checked(path: str) -> dict:
    """The file's settings, if it is plain byte-level BPE, whose cuts and merges are those made here; else a ValueError."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    model, cut = settings["model"], settings.get("pre_tokenizer") or {}
    plain = {
        "the model is BPE": model.get("type", "BPE") == "BPE" and "merges" in model,
        "there is no normalizer": settings.get("normalizer") is None,
        "pre-tokens are byte-level, by the pattern, without a space put before": cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True),
        "no merge is left out or passed over": not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback"),
        "symbols have no prefix or suffix": not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"),
        "added tokens are taken as they stand": not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in settings.get("added_tokens", [])),
    }
    if missing := [k for k, v in plain.items() if not v]:
        raise ValueError(f"{path} isn't plain byte-level BPE; it would have to hold that " + ", ".join(missing))
    return settings


class Cutter:
    """Pre-token cuts for one tokenizer file."""

    def __init__(self, path: str):
        checked(path)
        self.path, self.tokenizer = path, library(path)
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[32] = SPACE
        self.specials = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def _class(self, cp: int) -> int:
        c = chr(cp)
        n = [span for _, span in self.cut(f"1{c}a")]
        if len(n) == 2:
            return LETTER if n[0] == (0, 1) else NUMBER
        return OTHER if len(self.cut(f"!{c}")) == 1 else SPACE

    def classify(self, cps: np.ndarray) -> np.ndarray:
        out = self.classes[cps]
        if (out == UNKNOWN).any():
            for cp in np.unique(cps[out == UNKNOWN]):
                self.classes[cp] = self._class(int(cp))
            out = self.classes[cps]
        return out

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """(starts, ends, row) of the parts that are cut each for itself, and (row, start, id) of the special tokens between them."""
        starts, ends, rows = offsets[:-1], offsets[1:], np.arange(len(offsets) - 1)
        raw = data.tobytes() if any(s in data.tobytes() for s in self.specials) or (np.diff(offsets) > LONG).any() else b""
        if not raw:
            return starts, ends, rows, []
        out, found = [], []
        for r, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            while True:
                hits = [(i, s) for s in self.specials if (i := raw.find(s, a, b)) >= 0]
                stop, special = min(hits, default=(b, b""), key=lambda x: (x[0], -len(x[1])))
                while stop - a > LONG:
                    # before a single space between two ASCII letters a pre-token ends
                    k = next((i for i in range(a + LONG, stop - 1) if raw[i] == 32 and raw[i - 1 : i].isalpha() and raw[i + 1 : i + 2].isalpha()), stop)
                    if k == stop:
                        break
                    out.append((a, k, r))
                    a = k
                out.append((a, stop, r))
                if not special:
                    break
                found.append((r, stop, self.specials[special]))
                a = stop + len(special)
        x = np.array(out, np.int64).reshape(-1, 3)
        return x[:, 0], x[:, 1], x[:, 2], found

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the pre-tokens of data[starts[i]:ends[i]] (ascending, apart)."""
        none = np.zeros(0, np.int64)
        full = ends > starts
        starts, ends = starts[full], ends[full]
        if not len(starts):
            return none, none
        head = np.flatnonzero((data & 0xC0) != 0x80)
        if len(starts) != 1 or starts[0] or ends[0] != len(data):
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            head = head[np.cumsum(inside[:-1], dtype=np.int8)[head] > 0]
        lead = data[head].astype(np.int32)
        cps = lead.copy()
        wide = np.flatnonzero(lead >= 0xC0)
        if len(wide):
            at, first = head[wide], lead[wide]
            end = len(data) - 1
            b1, b2, b3 = (data[np.minimum(at + k, end)].astype(np.int32) & 0x3F for k in (1, 2, 3))
            cps[wide] = np.where(first < 0xE0, (first & 0x1F) << 6 | b1, np.where(first < 0xF0, (first & 0x0F) << 12 | b1 << 6 | b2, (first & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = self.classify(cps)
        n = len(head)
        opens = np.searchsorted(head, starts)
        run = np.ones(n, bool)
        run[1:] = kind[1:] != kind[:-1]
        run[opens] = True
        at = np.flatnonzero(run)
        first = np.zeros(n, bool)
        first[opens] = True
        stop = np.append(at[1:], n)
        last = np.append(first[at[1:]], True)  # nothing follows the run in its text
        here = kind[at]
        space = here == SPACE
        begin = np.zeros(n, bool)
        begin[at[space]] = True
        begin[stop[space & ~last] - 1] = True
        word = at[~space]
        joined = (word > 0) & ~first[word] & (cps[word - 1] == 32)
        begin[word[~joined]] = True
        quotes = np.flatnonzero(~space & (here == OTHER) & (stop - at == 1) & (cps[at] == 0x27) & ~last)
        if len(quotes):
            quotes = quotes[(here[quotes + 1] == LETTER) & begin[at[quotes]]]
            for q in quotes.tolist():
                a, b = int(at[q + 1]), int(stop[q + 1])
                text = "".join(map(chr, cps[a : min(b, a + 2)]))
                k = next((k for k, s in SUFFIXES.items() if text[:k] in s), 0)
                if k:
                    begin[a] = False
                    if a + k < b:
                        begin[a + k] = True
        at = np.flatnonzero(begin)
        s = head[at]
        e = np.append(s[1:], ends[-1])
        tail = np.searchsorted(s, ends, "left") - 1  # the last pre-token of each part ends with it
        e[tail] = ends
        return s, e


class WordCache:
    """What a function of a pre-token gives (a ragged row of ids), by its hash; emptied when full, so memory has a bound.

    Entries are found by one 64-bit hash and checked by a second one; a pre-token that an entry of another's hash hides
    is worked out each time it comes.
    """

    MOST = 1_000_000

    def __init__(self, rows):
        self.rows = rows  # list of bytes -> (flat int32 array, lengths)
        self.clear()

    def clear(self) -> None:
        self.table, self.flat, self.used = HashTable(21), np.zeros(1 << 20, np.int32), 0
        self.starts, self.lengths, self.check, self.n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.uint64), 0

    def _room(self, name: str, n: int) -> None:
        x = getattr(self, name)
        if len(x) < n:
            setattr(self, name, np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)]))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the entries of data[starts[i]:ends[i]]."""
        h, check = span_hashes(data, starts, ends), span_hashes(data, starts, ends, 1)
        at = self.table.get(h)
        at[(at >= 0) & (self.check[at] != check)] = -2  # hidden by an entry of the same hash
        new = np.flatnonzero(at < 0)
        if len(new):
            order = new[np.lexsort((check[new], h[new]))]
            first = np.append(True, (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]]))
            one = order[first]
            if self.n + len(one) > self.MOST and self.n:
                self.clear()
                return self.of(data, starts, ends)
            raw = data.tobytes()
            ids, lengths = self.rows([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            entries = self.n + np.arange(len(one))
            self._room("flat", self.used + len(ids))
            for name in ("starts", "lengths", "check"):
                self._room(name, self.n + len(one))
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[entries], self.lengths[entries], self.check[entries] = self.used + np.cumsum(lengths) - lengths, lengths, check[one]
            shown = (at[one] == -1) & np.append(True, h[one][1:] != h[one][:-1])
            self.table.put(h[one[shown]], entries[shown])
            self.used, self.n = self.used + len(ids), self.n + len(one)
            at[order] = entries[np.cumsum(first) - 1]
        return at


class Encoder:
    """Ids of whole texts from the tokenizers library, which is asked once for each different pre-token."""

    def __init__(self, path: str):
        self.cutter = Cutter(path)
        self.letters = {b: c for b, c in enumerate(byte_characters())}
        self.cache = WordCache(self._ids)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        model = self.cutter.tokenizer.model.tokenize
        ids = [[t.id for t in model(w.decode("latin-1").translate(self.letters))] for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())), lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts in a row, and n + 1 offsets into them."""
        a, b, rows, found = self.cutter.pieces(data, offsets)
        s, e = self.cutter.tokens(data, a, b)
        at = self.cache.of(data, s, e)
        ids = self.cache.flat[ragged(self.cache.starts[at], self.cache.lengths[at].astype(np.int64))]
        place = np.concatenate([[0], np.cumsum(self.cache.lengths[at], dtype=np.int64)])
        off = place[np.searchsorted(s, offsets)]
        if found:
            where = np.array([x[1] for x in found])
            ids = np.insert(ids, place[np.searchsorted(s, where)], [x[2] for x in found])
            off = off + np.searchsorted(where, offsets)
        return ids, off


@functools.cache
def encoder(path: str) -> Encoder:
    """One per process and file, with its cache."""
    return Encoder(path)


def encoded(texts, path: str):
    """For an Arrow string column: (first row, ids, offsets of each text) by chunks."""
    data, offsets = flat(texts)
    for first, last in slices(offsets, CHUNK):
        part = offsets[first : last + 1]
        ids, off = encoder(path).encode(data[part[0] : part[-1]], part - part[0])
        yield first, ids, off
