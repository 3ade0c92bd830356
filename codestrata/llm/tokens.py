"""Token ids of whole texts with a public tokenizer, many words at a time.

The word tokenizer drops white space and no rule of it (composition, lower case, splitting, merges, its special strings)
looks across white space, so a text's ids are those of its white-space separated words, one after another. Words repeat far
more than texts do: each worker keeps the ids of the words it has met, in a bounded table, and asks the library only for
new ones. ``tests/llm`` compares this with encoding whole texts in one call.
"""
import re
import struct

KNOWN_WORDS = 150_000      # words of a generation that a worker keeps; words of the one before move over when met again
LONG_WORD = 64             # longer words are encoded but not kept

# Words for which the library's normalizer and splitter have nothing to decide: letters of Latin-1 with marks of ASCII, but
# neither ' nor a special string's <, before or after them. They are composed already, only their case changes, and letters
# and marks are one piece each. The merges, which take the time, are then asked for directly; every other word goes through
# the whole library.
MARKS = r"[!-&(-/:-@\[-`{-~]*"
PLAIN_WORD = re.compile(rf"((?!.*<){MARKS})([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)({MARKS})")

# In texts of Latin-1 letters and ASCII alone the library may be handed A-Z in lower case, since it lowers all letters and
# nothing composes there. Where no two marks stand side by side, a mark may be cut off what is before it too, since its pattern
# ends a piece there. So a word is one entry however it is written and whatever follows it. What looks like a special string
# is left as it is.
LOWERED_BYTES = bytes(range(128)) + bytes(range(0x80, 0xC0)) + b"\xc3"
SHAPE = bytes(32 if b in b" \t\n\v\f\r" else 97 if chr(b).isalnum() or b >= 0x80 else 46 for b in range(128)) + b"a" * 128
CUT_MARKS = (b".", b",", b";", b":", b"!", b"?")
SIGNS = ("\u00d7".encode(), "\u00f7".encode())      # the two of these bytes that are no letters


def simplified(text: bytes) -> bytes:
    if text.translate(None, LOWERED_BYTES) or b"<|" in text:
        return text
    text = text.lower()
    if b".." not in text.translate(SHAPE) and SIGNS[0] not in text and SIGNS[1] not in text:
        for mark in CUT_MARKS:
            text = text.replace(mark, b" " + mark)
    return text


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


class WordEncoder(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, made when a word is first asked for; texts are joined from them."""

    def __init__(self, path: str):
        super().__init__()
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model, self.characters = self.library.model, byte_characters()
        self.older: dict[bytes, bytes] = {}

    @property
    def vocabulary(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def _piece(self, text: str) -> bytes:
        """Ids of one piece, which as a word of its own is known by its bytes."""
        key = text.encode()
        found = self.get(key) or self.older.get(key)
        if found is None:
            ids = [t.id for t in self.model.tokenize(key.decode("latin-1").translate(self.characters))]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(key) <= LONG_WORD:
                self[key] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            match = PLAIN_WORD.fullmatch(text)
            if match:
                found = self._piece(match[2].lower())
                found = self._piece(match[1]) + found if match[1] else found
                found = found + self._piece(match[3]) if match[3] else found
            else:
                ids = self.library.encode(text, add_special_tokens=False).ids
                found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONG_WORD:
            self[word] = found
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        return [b"".join(map(self.__getitem__, simplified(text).split())) for text in texts]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
