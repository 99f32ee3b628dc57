"""Whole-text tokenisation with public tokenizer files, with a bounded cache of word pieces per Python worker.

A tokenizer whose rules cut at white space (read from its file: byte-level BPE without a normaliser, where a space
belongs to the word after it; or BPE that drops white space) gives a text the joined ids of its pieces, so every
distinct piece is encoded once. A text whose white space is unusual (runs, tabs, Unicode spaces) is encoded whole where
the cut would not be exact, and so is every text under a tokenizer of other rules.

Strings of special tokens inside a text, such as <|endoftext|>, are ordinary text (encode_special_tokens is set).
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np

from .common import ranges

#: Bytes of memory, about, that a worker's cached pieces may take; then the half that was used least goes.
CACHE_BYTES = 96_000_000
_PIECE_COST = 170  # a dict entry, a bytes object, a number and two table entries
_LEARN_BYTES = 20_000
_MARKS = b".,;:!?)#*$%&|]"

_ODD = [b"  ", b" \n", b"\n ", b"\n\n", *(bytes([k]) for k in (1, 9, 11, 12, 13, 28, 29, 30, 31))]
_ODD_BEYOND_ASCII = [x.encode() for x in ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")]
_WORKER: dict[str, "PieceEncoder"] = {}


def odd_space(row: bytes) -> bool:
    return any(x in row for x in _ODD) or (not row.isascii() and any(x in row for x in _ODD_BEYOND_ASCII))


def space_rule(path: str) -> str:
    """How the tokenizer treats spaces: "joined" (to the next word), "dropped", or "other" (texts are encoded whole)."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    before, pre, parts = rules.get("normalizer"), rules.get("pre_tokenizer") or {}, []
    if before is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "joined"
    if (before or {}).get("type") == "Sequence" and pre.get("type") == "Sequence":
        parts = pre.get("pretokenizers", [])
        known = {"NFC", "NFD", "NFKC", "NFKD", "Replace", "Lowercase", "StripAccents"}
        if (
            all(n.get("type") in known for n in before["normalizers"]) and before["normalizers"][-1]["type"] == "Lowercase" and len(parts) == 2
            and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
            and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and not parts[1].get("add_prefix_space")
        ):
            return "dropped"
    return "other"


class PieceEncoder:
    """Encodes byte strings with the tokenizer of a file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.rule = space_rule(path)
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.opens = np.zeros(self.vocab_size, bool)  # ids that begin a piece, under "joined"
        if self.rule == "joined":
            self.opens[[i for t, i in self.tok.get_vocab().items() if t[0] in "ĠĊ"]] = True
        elif self.rule == "dropped":
            self.mark = self.raw(["\x01"])[0]
            if len(self.mark) != 1:
                self.rule = "other"
        self.reset()

    def reset(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens, self.hits = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def shrink(self) -> None:
        names, n = list(self.codes), len(self.codes)
        keep = np.sort(np.argsort(-self.hits[:n], kind="stable")[: n // 2])
        hits, lens = self.hits[keep], self.lens[keep]
        flat = self.ids[ranges(self.starts[keep], lens)]
        self.reset()
        self.store([names[k] for k in keep.tolist()], flat, lens)
        self.hits[: len(keep)] = hits >> 1

    def raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def store(self, pieces: list[bytes], flat: np.ndarray, lens: np.ndarray) -> None:
        first = len(self.codes)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while first + len(pieces) > len(self.starts):
            self.starts, self.lens, self.hits = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lens, self.hits))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first : first + len(pieces)] = self.used + np.concatenate(([0], np.cumsum(lens)[:-1]))
        self.lens[first : first + len(pieces)] = lens
        self.used += len(flat)
        self.held += sum(map(len, pieces)) + _PIECE_COST * len(pieces) + 4 * len(flat)
        self.codes.update(zip(pieces, range(first, first + len(pieces))))

    def several(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has: one text of all of them, parted again at the pieces' starts."""
        if self.rule == "joined":
            text = b" ".join(part).replace(b" \n", b"\n")
            ids = np.array(self.raw([(text if text[:1] == b"\n" else b" " + text).decode("utf-8", "replace")])[0], np.uint32)
            lens = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        else:
            ids = np.array(self.raw([b" \x01 ".join([*part, b""]).decode("utf-8", "replace")])[0], np.uint32)
            at = np.flatnonzero(ids == self.mark[0])
            lens = np.diff(np.concatenate(([-1], at))) - 1
            ids = np.delete(ids, at)
        if len(lens) != len(part) or lens.sum() != len(ids):
            texts = [p.decode("utf-8", "replace") for p in part]
            got = self.raw([t if self.rule != "joined" or t[:1] == "\n" else " " + t for t in texts])
            ids, lens = np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got])
        return ids, lens

    def learn(self, new: list[bytes]) -> None:
        """Put new pieces into the cache. Both rules cut between an ASCII letter and the marks after it, so a piece that
        ends in marks is made of two that are mostly known."""
        cores = [p.rstrip(_MARKS) for p in new]
        halved = [(p, c, b"\x01" + p[len(c) :]) for p, c in zip(new, cores) if len(c) < len(p) and c[-1:].isalpha()]
        for tail in {t for _, _, t in halved if t not in self.codes}:
            ids = np.array(self.raw([tail[1:].decode()])[0], np.uint32)
            self.store([tail], ids, np.array([len(ids)]))
        whole = {c for _, c, _ in halved}
        whole.update(p for p, c in zip(new, cores) if len(c) == len(p) or not c[-1:].isalpha())
        self.encode_new(sorted(p for p in whole if p not in self.codes))
        if halved:
            halves = np.array([(self.codes[c], self.codes[t]) for _, c, t in halved], np.int64)
            lens = self.lens[halves]
            self.store([p for p, _, _ in halved], self.ids[ranges(self.starts[halves].ravel(), lens.ravel())], lens.sum(axis=1))

    def encode_new(self, new: list[bytes]) -> None:
        at = 0
        ends = np.cumsum([len(p) + 3 for p in new])
        while at < len(new):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LEARN_BYTES)))
            self.store(new[at:end], *self.several(new[at:end]))
            at = end

    def encode(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of each text as a uint32 array."""
        if self.held > CACHE_BYTES:
            self.shrink()
        out: list[np.ndarray | None] = [None] * len(rows)
        pieces: list[bytes] = []
        counts, plain = [], []
        joined = self.rule == "joined"
        for k, row in enumerate(rows):
            if not row:
                out[k] = np.zeros(0, np.uint32)
                continue
            if joined:
                row = b"\n" + row
                if odd_space(row):
                    out[k] = np.array(self.raw([row[1:].decode("utf-8", "replace")])[0], np.uint32)
                    continue
                got = row.replace(b"\n", b" \n")[1:].split(b" ")
            elif self.rule == "other" or b"\x01" in row:
                out[k] = np.array(self.raw([row.decode("utf-8", "replace")])[0], np.uint32)
                continue
            else:
                got = row.lower().split()  # ASCII letters; the tokenizer lowers all
            pieces += got
            counts.append(len(got))
            plain.append(k)
        codes = np.fromiter(map(self.codes.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            self.learn(list(dict.fromkeys([pieces[k] for k in unknown])))
            codes[unknown] = [self.codes[pieces[k]] for k in unknown]
        n = len(self.codes)
        self.hits[:n] += np.bincount(codes, minlength=n).astype(np.int32)
        lens = self.lens[codes]
        flat = self.ids[ranges(self.starts[codes], lens)]
        ends = np.concatenate(([0], np.cumsum(lens)))[np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))] if counts else []
        for j, k in enumerate(plain):
            out[k] = flat[ends[j] + joined : ends[j + 1]]
        return out


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and file."""
    if path not in _WORKER:
        _WORKER.clear()  # one at a time, so that a worker that serves several jobs holds one cache
        _WORKER[path] = PieceEncoder(path)
    return _WORKER[path]
