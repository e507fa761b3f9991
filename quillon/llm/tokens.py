"""Public vocabularies, read from public_tokenizers at run time, with a cache per word.

The ids of a text are those that the tokenizers library gives for the vocabulary with word ends. White space always ends a
pre-token, so a text's ids are its words' ids in a row, and most words have been seen before. A text takes this way only if all
its characters are among those for which lower-casing and normal form are plain (see PLAIN) and no special token can be in it;
any other goes whole to the library."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

WORD_BPE = "word_bpe_49k.json"
#: Characters with the same lower case, class and normal form in both libraries; no white space but the ASCII kind.
PLAIN = re.compile("[^\t-\r\x20-\x7e\xa1-\xac\xae-\xffĀ-įı-ž‐-‧]")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words that a worker keeps, the characters they may have together, and the length from which a piece goes to the library.
CACHE, CACHE_CHARS, LONG_PIECE = 300_000, 16_000_000, 512
END = b"\xff"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}


class WordBpe(dict):
    """Word to the little-endian 16-bit ids of its pieces; ids() has those of a whole text."""

    def __init__(self, name: str = WORD_BPE) -> None:
        from tiktoken import _tiktoken
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self.whole = Tokenizer.from_file(path)
        model, of = json.load(open(path))["model"], byte_characters()
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        ranks = {}
        for token, i in model["vocab"].items():
            if token in special:
                continue
            end = token.endswith("</w>") and token != "</w>"
            ranks[bytes(of[c] for c in token.removesuffix("</w>" * end)) + END * end] = i
        if len(self.whole.get_vocab()) > 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.core = _tiktoken.CoreBPE(ranks, {}, r"[\s\S]+")

    def __missing__(self, word: str) -> bytes:
        ids: list[int] = []
        for piece in PIECES.findall(word):
            ids += self.core.encode_single_piece(piece.encode() + END) if len(piece) <= LONG_PIECE else self.whole.encode(piece, add_special_tokens=False).ids
        out = array("H", ids).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if "<|" in text or not text.isascii() and PLAIN.search(text) or text.isascii() and _CONTROL.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


@lru_cache(4)
def word_bpe(name: str = WORD_BPE) -> WordBpe:
    """One for each Python worker, whatever number of tasks it runs."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordBpe(name)


class Fertility(dict):
    """Word to (ids of the vocabulary with byte fallback, number of byte-level tokens), for words that learn() has met."""

    def __init__(self, pieces: str, ranks: str) -> None:
        import base64

        import public_tokenizers
        import sentencepiece
        from tiktoken import _tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(pieces))
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(ranks), "rb"))}
        self.bpe = _tiktoken.CoreBPE(table, {}, public_tokenizers.PATTERN)
        self.chars = 0
        self.fallback = np.array([self.sp.is_byte(i) or self.sp.is_unknown(i) for i in range(self.sp.vocab_size())])

    def learn(self, words: set[bytes]) -> None:
        """Measures words that are new, each whole, in time that grows with their length."""
        new = [w for w in words if w not in self]
        size = sum(map(len, new))
        if len(self) + len(new) > CACHE or self.chars + size > CACHE_CHARS:
            self.clear()
            new, size, self.chars = list(words), sum(map(len, words)), 0
        self.chars += size
        every, count = [w.decode("utf-8", "replace") for w in new], self.bpe.encode_ordinary
        for w, text, ids in zip(new, every, self.sp.encode(every, num_threads=1) if new else []):
            self[w] = array("H", ids).tobytes(), len(count(" " + text))


@lru_cache(4)
def fertility(pieces: str, ranks: str) -> Fertility:
    return Fertility(pieces, ranks)
