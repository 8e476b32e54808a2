"""Token ids and counts of whole texts by the tokenizers library, with bounded memos of repeated pieces.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so each piece's tokens do not depend on its
surroundings; texts for which that is not certain (odd white space, special strings) are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces that each of a memo's two generations holds; the older one goes when the younger is full.
MEMO_PIECES = 600_000


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that, in a row after a letter, are one pre-token of their own at a piece's end.
MARKS = ".,!?*#%$&;:\"()|<>"


def _stays_letter(c: str) -> bool:
    """Whether the character is a letter in every version of Unicode, and still one letter when composed and lower-cased.

    Others (such as U+0130, which becomes i and a combining mark) may be, but their pieces are encoded whole.
    """
    return c.isalpha() and (c < "\u0250" and c != "\u0130" or "\u0400" <= c <= "\u0481" or "\u4e00" <= c <= "\u9fa5")


def _base(piece: str) -> str:
    """The piece without the marks at its end, if what stands before them surely ends in a letter; else the piece."""
    base = piece.rstrip(MARKS)
    return base if base and _stays_letter(base[-1]) else piece


def _byte_letters() -> list[str]:
    """The letter by which byte-level models write each byte: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Memo:
    """What ``value`` makes of a piece's ids. A letters-only piece is one pre-token, so the model alone encodes it."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model, self.young, self.old = self.tokenizer.model, {}, {}
        self.letters = _byte_letters()
        self.marks: dict = {}

    def value(self, ids: list[int]):
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def written(self, piece: str) -> str | None:
        """The piece as the model reads it, if it is surely one pre-token; else None."""
        raise NotImplementedError

    def _one(self, piece: str):
        if (written := self.written(piece)) is not None:
            return self.value([t.id for t in self.model.tokenize(written)])
        return self.value(self.encode_whole(piece))

    def learn(self, pieces: set[str]) -> None:
        """Puts the pieces into the younger generation."""
        if len(self.young) + len(pieces) > MEMO_PIECES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        for p in pieces:
            if p in young:
                continue
            if p in old:
                young[p] = old[p]
            elif len(base := _base(p)) < len(p):
                v = young[base] if base in young else old[base] if base in old else self._one(base)
                end = p[len(base) :]
                if end not in self.marks:
                    if len(self.marks) > 10_000:
                        self.marks.clear()
                    self.marks[end] = self.value(self.encode_whole(end))
                young[base], young[p] = v, v + self.marks[end]
            else:
                young[p] = self._one(p)

    def look_up(self, cut: list[list[str] | None]) -> dict:
        pieces = {p for c in cut if c for p in c}
        if missing := pieces.difference(self.young):
            before = self.young
            self.learn(missing)
            if self.young is not before:
                self.learn(pieces)
        return self.young


class WordIds(_Memo):
    """Ids of a tokenizer that drops white space and case (word_bpe): pieces between white space are independent."""

    @staticmethod
    def cut(text: str) -> list[str] | None:
        # str.split() also splits at U+001C..U+001F, which the tokenizer does not; "<|" may begin a special string
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        return text.split()

    def value(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def written(self, piece: str) -> str | None:
        if piece.isascii():
            return piece.lower() if piece.isalpha() else None
        if piece.isalpha() and max(piece) < "\u0130":  # up to there, composed and of simple case
            return "".join([self.letters[b] for b in piece.lower().encode()])
        return None

    def sentence_ends(self) -> np.ndarray:
        """Whether an id is a sentence's final mark."""
        vocab = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for t, i in vocab.items() if re.fullmatch(r"[.!?]+(</w>)?", t)]] = True
        return ends

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.cut(t) for t in texts]
        get = self.look_up(cut).__getitem__
        return [self.value(self.encode_whole(t)) if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut, strict=True)]


class ByteCounts(_Memo):
    """Token counts of a byte-level tokenizer whose pre-tokens may begin with one space (byte_bpe)."""

    @staticmethod
    def cut(text: str) -> list[str] | None:
        """Cuts only at a lone space or line feed between characters that are no white space, and only if there is no other."""
        if not text or any(x in text for x in ("<|", "  ", "\n\n", " \n", "\n ")) or text[0].isspace() or text[-1].isspace():
            return None
        # every piece but a line's first begins with its space
        pieces = text.replace(" ", "\n ").split("\n")
        return pieces if len(pieces) == len(text.split()) else None

    def __init__(self, path: str):
        super().__init__(path)
        self.newline = len(self.encode_whole("\n"))

    def value(self, ids: list[int]) -> int:
        return len(ids)

    def written(self, piece: str) -> str | None:
        word = piece[piece[0] == " " :]
        if word.isalpha() and (max(word) < "\u0250" or all(map(_stays_letter, word))):
            return "".join([self.letters[b] for b in piece.encode()])
        return None

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        get = self.look_up(cut).__getitem__
        return [(len(self.encode_whole(t)) if t else 0) if c is None else sum(map(get, c)) + self.newline * t.count("\n") for t, c in zip(texts, cut, strict=True)]
