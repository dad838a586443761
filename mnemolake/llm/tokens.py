"""Exact tokenization with caches of chunks and of pretokens.

Both tokenizers cut a text at white space before they merge, so the ids of a text are the ids of its
white-space-separated chunks in a row. A text of Latin letters, ASCII digits and ASCII signs is cut into
pretokens by the tokenizer's own rule. Natural text repeats its words, so most pretokens come from a
dictionary of bounded size; new ones go to the library's merge model. Other texts are cut into chunks, and
a chunk that has other characters goes through the whole library, as does a whole text where a cut is not
certain to be one of the tokenizer's own.
"""

from __future__ import annotations

import os
import re

import numpy as np

from mnemolake.llm.common import LOWER, resident

#: Entries of a worker's cache of pretokens, of which the entries of the last round stay for one more, and of chunks; about 140 bytes each.
CACHE_ENTRIES, CACHE_CHUNKS = 100_000, 40_000
#: Longer chunks are encoded but not kept.
CACHE_CHUNK_BYTES = 256

#: The byte-level alphabet: a printable character for each byte.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_ALPHABET = str.maketrans({chr(b): c for b, c in _SHOWN.items()})

# Latin letters without a decomposition or lower-case form of several characters; ASCII signs without the apostrophe.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+"
_SIGNS = "[!-&(-/:-@\\[-`{-~]+"
#: Of chunks with plain characters only: their pretokens.
_PLAIN = {
    "drop": re.compile(f"{_LETTERS}|[0-9]|{_SIGNS}"),
    "lead": re.compile(f" ?{_LETTERS}| ?[0-9]+| ?{_SIGNS}|\\n+(?=\\n[^\\s])|\\n(?=[^\\s])|\\n+\\Z"),
}
#: The same, and any other character as a piece of its own (but for the ASCII white space that is dropped).
_PIECES = {"drop": re.compile(_PLAIN["drop"].pattern + "|[^ \t\n\r\x0b\x0c]"), "lead": re.compile(_PLAIN["lead"].pattern + "|\\n(?s:.)|(?s:.)")}
_WHOLE = {k: re.compile(f"(?:{x.pattern})+") for k, x in _PLAIN.items()}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    spaces: "drop" for a tokenizer that drops white space and case, "lead" for a byte-level one whose words
    carry the space before them. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, spaces: str, entries: int = CACHE_ENTRIES):
        self.entries = entries
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.spaces, self.plain, self.whole, self.pieces = spaces, _PLAIN[spaces], _WHOLE[spaces], _PIECES[spaces]
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.kept: dict[bytes, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pretoken(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            if text.isascii() and "\n" not in text:
                shown = text.replace(" ", "\u0120")
            else:
                low = text.lower() if self.spaces == "drop" else text
                shown = low.encode("utf-8").decode("latin-1").translate(_ALPHABET)
            found = b"".join([self.bytes_of[x.id] for x in self.model.tokenize(shown)])
        if len(self.pretokens) >= self.entries:  # the entries of the last round stay at hand for one more
            self.older, self.pretokens = self.pretokens, {}
        if len(text) <= CACHE_CHUNK_BYTES:
            self.pretokens[text] = found
        return found

    def _pretokens(self, texts: list[str]) -> list[bytes] | None:
        """The ids of each pretoken; None if one is not of plain characters."""
        out = list(map(self.pretokens.get, texts))
        if None in out:
            at = -1
            try:
                while True:
                    at = out.index(None, at + 1)
                    text = texts[at]
                    found = self.pretokens.get(text)
                    if found is None:
                        if not self.plain.fullmatch(text) and not (text and not text.strip("\n")):
                            return None
                        found = self._pretoken(text)
                    out[at] = found
            except ValueError:
                pass
        return out

    def _chunk(self, text: str) -> bytes:
        if self.whole.fullmatch(text):
            return b"".join(self._pretokens(self.plain.findall(text)))
        return self._library(text)

    def _known(self, chunks: list[bytes], lead: str) -> list[bytes] | None:
        """The ids of each chunk; None if a chunk's borders are not certain."""
        out = list(map(self.kept.get, chunks))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    c = chunks[i]
                    x = self.kept.get(c)
                    if x is None:
                        text = c.decode("utf-8")
                        if lead and (not text or text[0].isspace() or text[-1].isspace()):
                            return None
                        x = self._chunk(lead + text)
                        if len(self.kept) >= CACHE_CHUNKS:
                            self.kept.clear()
                        if len(c) <= CACHE_CHUNK_BYTES:
                            self.kept[c] = x
                    out[i] = x
        return out

    def encode(self, text: str | bytes | None) -> bytes:
        """Null and empty texts have no ids. Bytes are UTF-8."""
        if not text:
            return b""
        data = text.encode("utf-8") if isinstance(text, str) else text
        if self.spaces == "drop":
            data = data.translate(LOWER)
        if (ids := self._pretokens(self.pieces.findall(data.decode("utf-8")))) is not None:
            return b"".join(ids)
        if self.spaces == "drop":
            return b"".join(self._known(data.split(), ""))
        first, *rest = data.split(b" ")
        head = first.decode("utf-8")
        if rest and head and not head[-1].isspace() and (ids := self._known(rest, " ")) is not None:
            return self._chunk(head) + b"".join(ids)
        return self._library(data.decode("utf-8"))

    def encode_with_starts(self, text: str | bytes | None) -> tuple[bytes, np.ndarray]:
        """The ids, and of each the place of its first code point in the text, by the library."""
        if not text:
            return b"", np.zeros(0, np.int64)
        found = self.tokenizer.encode(text.decode("utf-8") if isinstance(text, bytes) else text, add_special_tokens=False)
        return np.array(found.ids, "<u4").tobytes(), np.array([a for a, _ in found.offsets], np.int64)


def encoder(path: str, spaces: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """One encoder for each Python worker, kept until a task asks for another model."""
    return resident((path, spaces, entries), lambda: Encoder(path, spaces, entries))
