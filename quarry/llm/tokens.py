"""Public tokenizers inside tasks, with a bounded memo of words.

Both vocabularies split a text before they merge bytes, and never across the places where we cut it, so the ids of
a text are those of its pieces. Each distinct piece of a batch is encoded once and remembered by the worker.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces of a generation; a worker remembers two, and what it meets again moves to the younger one.
MEMO_PIECES = 500_000
#: Characters of text that are looked up together.
BATCH_CHARS = 4_000_000

_loaded: dict[str, "Encoder"] = {}


def encoder(path: str, kind: str) -> "Encoder":
    """kind: ``bytes`` (byte-level, a space belongs to the word after it) or ``words`` (white space is dropped)."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, kind)
    return _loaded[path]


#: Pieces that are encoded in one call.
TOGETHER = 512


class Encoder:
    #: Kinds of white space besides the space and the line feed, and characters that a rule may count as such.
    _ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        #: Strings that the library takes for tokens of their own wherever they stand; a text with one is encoded whole.
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = [s.encode() for s in special] if kind == "words" else special
        self.mark = os.path.commonprefix(self.special)
        self.kind = kind
        self.memo: dict = {}
        self.old: dict = {}
        self.line_feed = self.tok.encode("\n", add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list) -> list[bytes]:
        """Ids of each piece; many are encoded in one text, which no piece's ids depend on, and parted again."""
        groups = [pieces[i:i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        if self.kind == "words":  # by the place of each token in the text
            texts, out = [b" ".join(g).decode() for g in groups], []
            for g, text, e in zip(groups, texts, self.tok.encode_batch(texts, add_special_tokens=False)):
                spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
                at = np.fromiter((x for x, _ in e.offsets), np.int64, len(e.ids))
                ends = [0, *(4 * np.searchsorted(at, spaces)).tolist(), 4 * len(at)]
                raw = np.array(e.ids, "<u4").tobytes()
                out += [raw[x:y] for x, y in zip(ends, ends[1:])]
            return out
        coded, out = self.tok.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), []
        for g, e in zip(groups, coded):  # by the line feeds, which are tokens of their own between such pieces
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(ids == self.line_feed[0])
            if len(at) != len(g) - 1:
                out += self._ids(g)
                continue
            raw = ids.tobytes()
            out += [raw[4 * x:4 * y] for x, y in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)])]
        return out

    def _learn(self, pieces: set) -> None:
        new = pieces - self.memo.keys()
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.old, self.memo, new = self.memo, {}, pieces
        known = new & self.old.keys()
        self.memo.update((p, self.old[p]) for p in known)
        new = list(new - known)
        if self.kind == "words":
            self.memo.update(zip(new, self._ids_of_pieces(new)))
            return
        plain = [p for p in new if p not in ("", "\n")]
        self.memo.update(zip(plain, self._ids_of_pieces(plain)))
        self.memo[""], self.memo["\n"] = b"", np.array(self.line_feed, "<u4").tobytes()

    def _special_in(self, text: str | bytes) -> bool:
        return self.mark in text and any(s in text for s in self.special)

    def _pieces(self, text: str) -> list | None:
        if self.kind == "words":
            raw = text.encode().lower()  # the tokenizer lower-cases too, but only what is no such string as it stands
            return None if self._special_in(raw) else raw.split()
        if self._special_in(text):
            return None
        if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")
                or self._ODD.search(text)):
            return None  # white space next to other, at an end, or of another kind: encoded whole
        # a space goes with the word after it, a line feed stands alone
        return text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= BATCH_CHARS):
                chars += len(texts[hi])
                hi += 1
            parts = [self._pieces(t) for t in texts[lo:hi]]
            self._learn(set().union(*(p for p in parts if p is not None)))
            get = self.memo.__getitem__
            whole = iter(self._ids([t for t, p in zip(texts[lo:hi], parts) if p is None]))
            out += [next(whole) if p is None else b"".join(map(get, p)) for p in parts]
            lo = hi
        return out
