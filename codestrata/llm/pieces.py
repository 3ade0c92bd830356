"""Token ids of whole texts with a byte-level tokenizer, many words at a time.

The byte-level tokenizer splits a text with one fixed pattern, then merges the bytes of each piece by itself. Pieces repeat
far more than texts do, so each worker keeps the ids of those it has met, in a bounded table.

A text of Latin-1 characters alone is split here: for them the pattern's classes of letters, digits and white space are
written out below. Any other text is cut where the pattern always begins a new piece, which is before a single space between
two characters that are not white space, and the library encodes each cut whole, so its own character tables decide. Texts
that hold the tokenizer's special string go through the library whole. ``tests/llm`` compares all of it with encoding whole
texts in one call.
"""
import re
import struct

from codestrata.llm.tokens import LONG_WORD, byte_characters

KNOWN_PIECES = 250_000     # pieces of a generation that a worker keeps; those of the one before move over when met again

# The tokenizer's public pattern for Latin-1: letters, digits and white space as Unicode has them in that range.
LETTERS, DIGITS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
PIECE = re.compile(rf" ?[{LETTERS}]+| ?[{DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")


class PieceEncoder(dict):
    """Ids of pieces as little-endian unsigned 32-bit bytes, made when a piece is first asked for."""

    def __init__(self, path: str):
        super().__init__()
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model, self.characters = self.library.model, byte_characters()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.characters))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG_WORD:
            self[piece] = found
        return found

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _by_cuts(self, text: str) -> bytes:
        """Words whose neighbours all begin and end without white space are cuts of their own; others are glued together."""
        words, found, at = text.split(" "), [], 0
        tight = [bool(word) and not word[0].isspace() and not word[-1].isspace() for word in words]
        while at < len(words):
            end = at + 1
            while end < len(words) and not (tight[end - 1] and tight[end]):
                end += 1
            cut = (" " if at else "") + " ".join(words[at:end])
            if not BEYOND_LATIN.search(cut):
                found.extend(map(self.__getitem__, PIECE.findall(cut)))
            else:
                known = self.get(cut)
                if known is None:
                    known = self._whole(cut)
                    if len(cut) <= LONG_WORD:
                        self[cut] = known
                found.append(known)
            at = end
        return b"".join(found)

    def _text(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if any(mark in text for mark in self.special):
            return self._whole(text)
        if BEYOND_LATIN.search(text):
            return self._by_cuts(text)
        return b"".join(map(self.__getitem__, PIECE.findall(text)))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > KNOWN_PIECES:
            self.older = dict(self)
            self.clear()
        return list(map(self._text, texts))


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's own encoder; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
