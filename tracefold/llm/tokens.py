"""Token ids of whole texts by a public tokenizer of words."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: The tokenizer of the queries: no token of it spans white space, so the pieces between spaces can be encoded apart.
WORD_BPE = "word_bpe_49k.json"
#: Bytes that a process spends on remembered pieces, and on remembered words, beside those of the texts in hand; what an entry costs besides its characters and ids.
REMEMBERED_BYTES, ENTRY = 100_000_000, 170


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Printable Latin-1 without capitals, and in it the tokenizer's own rule for the words of a piece: letters, a number, marks.
PLAIN = re.compile(r"[\x21-\x40\x5b-\x7e\xa1-\xbf\xd7\xdf-\xff]+")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


class Encoder:
    """Encodes texts piece by piece, a piece being what stands between spaces and line feeds, and remembers the pieces.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its pieces in
    order. A plain piece, of lower-cased printable Latin-1, is cut further by the tokenizer's rule for words; only new words
    are encoded, many at once, by the tokenizer without its normaliser, which leaves such words as they are. All other
    pieces go through the tokenizer as it is. Tests hold all this against encoding whole texts.

    Ids are little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.known_bytes = self.words_bytes = 0

    @staticmethod
    def _pieces(text: str | None) -> list[str]:
        text = text or ""
        if "<|" not in text:
            # the tokenizer lower-cases; in Latin-1 that is the same before, and fewer pieces differ
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self._pieces(t) for t in texts]
        used = set().union(*split)
        new = used.difference(self.known)
        if self.known_bytes > REMEMBERED_BYTES:
            self.known, new, self.known_bytes = {}, used, 0
        # a piece that is one word is the key of both, and held once
        plain = {p: [p] if WORD.fullmatch(p) else WORD.findall(p) for p in new if PLAIN.fullmatch(p) and "<|" not in p}
        self._learn_words(set().union(*plain.values()))
        word, known = self.words.__getitem__, self.known
        for p, ws in plain.items():
            known[p] = b"".join(map(word, ws))
        for p in new.difference(plain):
            known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.known_bytes += sum(len(p) + len(known[p]) + ENTRY for p in new)
        get = known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def _learn_words(self, words: set[str]) -> None:
        new = list(words.difference(self.words))
        if self.words_bytes > REMEMBERED_BYTES:
            self.words, new, self.words_bytes = {}, list(words), 0
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) != len(part) + 1:
                raise ValueError("a word has not one last token")
            raw = ids.tobytes()
            for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
                self.words[w] = raw[a:b]
            self.words_bytes += sum(map(len, part)) + len(raw) + ENTRY * len(part)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker."""
    return Encoder(path)
