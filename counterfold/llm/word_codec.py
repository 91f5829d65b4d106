"""Token ids of white-space separated words, remembered per worker.

The tokenizer ``word_bpe_49k`` drops white space and never joins across it, so
the ids of a text are the ids of its words in order.  Words are looked up in a
bounded cache; a missing word is cut into the tokenizer's own pieces, and only
pieces never seen before go to the library, many in one call.  A text of
ASCII and Latin letters is cut into pieces at once, without a cache of words.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer, pre_tokenizers

#: The pattern by which the vocabulary file cuts normalised text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What the tokenizer takes as white space.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters that ``str.split`` takes as white space and the tokenizer doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Words of other characters than these (Latin letters, where normalisation is
#: plain lower-casing), of '<' (special strings) or of this length go to the
#: library whole.
_PLAIN = re.compile("[!-;=-~\xa1-\u024f]{1,128}")
#: Texts of these characters are lower-cased one by one and stay among them; special strings begin with "<|".
_LATIN = re.compile("[\0-\x7f\x85\xa0-\u012f\u0131-\u017f]*")
#: ``PIECES`` of such texts.
_LATIN_PIECES = re.compile(
    "[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|'(?:s|t|re|ve|m|ll|d)"
    "|[^\t-\r \x85\xa00-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]")
_PER_CALL = 1_000


def split_words(text: str) -> list[str]:
    if _NOT_SPACE.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


class Pieces(dict[str, bytes]):
    """Ids of lower-cased pieces; a missing one, of characters of ``_LATIN``, is cut by the library's model."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.cut = tokenizer.model.tokenize
        of_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {c: of_bytes(chr(c))[0][0] for c in range(0x180)}

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.cut(piece.translate(self.alphabet))]
        found = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found


class WordCodec:
    """``ids(words)`` for words; remembers at most ``limit`` words and pieces."""

    def __init__(self, vocabulary: str, limit: int = 300_000, known: dict[str, bytes] | None = None) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.limit = limit
        self.known = known or {}
        self.words: dict[str, bytes] = dict(self.known)
        self.pieces = Pieces(self.tokenizer)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def learn(self, words: Iterable[str]) -> None:
        """Make sure that ``self.words`` holds each of ``words``."""
        missing = [w for w in words if w not in self.words]
        if not missing:
            return
        if len(self.words) + len(missing) > self.limit + len(self.known):
            self.words = dict(self.known)
            missing = list(words)
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        cut: list[tuple[str, list[str]]] = []
        whole: list[str] = []
        for word in missing:
            if _PLAIN.fullmatch(word):
                low = word.lower()
                cut.append((word, [low] if low.isalpha() else PIECES.findall(low)))  # letters alone are one piece
            else:
                whole.append(word)
        self._learn_pieces({p for _, ps in cut for p in ps if p not in self.pieces})
        for word, ps in cut:
            self.words[word] = b"".join([self.pieces[p] for p in ps])
        for start in range(0, len(whole), _PER_CALL):
            part = whole[start:start + _PER_CALL]
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.words[word] = np.array(e.ids, "<u4").tobytes()

    def _learn_pieces(self, new: set[str]) -> None:
        order = list(new)
        for start in range(0, len(order), _PER_CALL):
            part = order[start:start + _PER_CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1  # a piece's last token carries the mark of a word's end
            if len(stops) != len(part):  # the tokenizer cuts one of them again
                for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.pieces[piece] = np.array(e.ids, "<u4").tobytes()
                continue
            data, at = ids.tobytes(), 0
            for piece, stop in zip(part, stops.tolist(), strict=True):
                self.pieces[piece] = data[at:4 * stop]
                at = 4 * stop

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        latin = [_LATIN.fullmatch(t) is not None and "<|" not in t for t in batch]
        others = iter(self._encode_words([t for t, ok in zip(batch, latin, strict=True) if not ok]))
        return [self._encode_latin(t) if ok else next(others) for t, ok in zip(batch, latin, strict=True)]

    def _encode_latin(self, text: str) -> bytes:
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, _LATIN_PIECES.findall(text.lower())))

    def _encode_words(self, batch: list[str]) -> list[bytes]:
        cut = [split_words(t) for t in batch]
        known = self.words
        self.learn({w for ws in cut for w in ws if w not in known})
        known = self.words
        out = []
        for ws in cut:
            try:
                out.append(b"".join([known[w] for w in ws]))
            except KeyError:  # the cache was emptied for this batch
                self.learn(set(ws))
                known = self.words
                out.append(b"".join([known[w] for w in ws]))
        return out
