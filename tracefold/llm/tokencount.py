"""Token counts (9): count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word; dynamic programming over end positions carries the best
score and the number of pieces on the way to it, never the pieces themselves. The rules are those of the public unigram
tokenizer: a later start replaces an earlier one only if its score is strictly greater; a character that no single-character
piece covers may be taken as unknown, at the smallest score less 10; an unknown character counts one token for each of its
UTF-8 bytes, where the vocabulary has all byte pieces, else a run of them counts one.

A text is read as the tokenizer's Metaspace rule says: spaces become U+2581, one is put in front, and every piece that starts
with one is scored on its own. Characters that no piece holds, such as line feeds, cut words further.

The vocabulary is that of a public model file, pieces with their scores; nothing is trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.llm.shingles import rows_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: The public vocabulary of the query.
PIECES = "piece_bpe_32k.model"
#: Words whose counts are remembered by a process.
REMEMBERED = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a model file with their scores, by id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def vocabulary_path(name: str = PIECES) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocab).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocab}
        self.single = {p for p in pieces if len(p) == 1}
        self.inside = set("".join(pieces))
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        #: Without byte pieces a run of unknown characters is one token, so words must not be cut inside one.
        self.cuts = "\n" if self.bytes and "\n" not in self.inside else ""

    def viterbi(self, word: str) -> tuple[float, int]:
        """Best score and number of tokens of a word. At an end, matches come from the earliest start on."""
        size = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, hit in self.automaton.iter(word):
            ending[end].append(hit)
        score, count, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end in range(size):
            best = None
            for length, s in sorted(ending[end], reverse=True):
                total = s + score[end + 1 - length]
                if best is None or total > best:
                    best, count[end + 1], unknown[end + 1] = total, count[end + 1 - length] + 1, False
            char = word[end]
            if char not in self.single:
                total = self.unknown + score[end]
                if best is None or total > best:
                    more = len(char.encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown[end])
                    best, count[end + 1], unknown[end + 1] = total, count[end] + more, True
            score[end + 1] = best
        return score[size], count[size]

    def _learn(self, word: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        n = self.known[word] = self.viterbi(word)[1] if word else 0
        return n

    def count(self, text: str | None) -> int:
        """The number of tokens of a text; 0 for a null or empty one."""
        if not text:
            return 0
        text = text.replace(" ", MARK)
        text = text if text[0] == MARK else MARK + text
        known, learn = self.known, self._learn
        total = 0
        lines = text.split("\n") if self.cuts else [text]
        for n, line in enumerate(lines):
            head, *words = line.split(MARK)
            if head:  # what stands behind a line feed and before the next mark
                got = known.get(head)
                total += learn(head) if got is None else got
            for w in words:
                got = known.get(MARK + w)
                total += learn(MARK + w) if got is None else got
            total += n > 0  # the line feed: one unknown byte
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a Python worker."""
    return Counter(vocabulary(path))


def _count(path: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            yield batch.append_column("n_tokens", pa.array([c.count(t) for (t,) in rows_of(batch.select([text_at]), 1)], type=pa.int64()))

    return run


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with the column n_tokens: 0 for null and empty texts.

    Each row stands for itself, whatever its id; other columns pass through (a column named n_tokens is replaced); an empty
    table gives an empty table.
    """
    docs = docs.drop("n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(_count(path or vocabulary_path(), docs.columns.index(text_col)), schema)


def token_count_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_tokens of every document."""
    counted = count_tokens(docs.select("doc_id", "text"))
    return counted.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "n_tokens")
