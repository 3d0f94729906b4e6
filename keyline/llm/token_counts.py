"""Token counts: a linear longest-match automaton counts word pieces without building them.

A word is cut greedily: its first piece is the longest one that begins a word, each next one the longest one that goes on.
The pieces form two tries. Every node knows where to go on when its next character fails, and how many pieces leave the
word by then; so each character is read once. A word that can't be cut whole counts as one unknown piece.

Defined cases: a null or empty text has no words; a null doc_id is carried; repeated rows are counted each; other columns
are not read; a word may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from keyline.llm.common import documents, slices

BEGINS = "▁"
#: Words that a worker remembers; then it starts anew.
REMEMBERED = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def pieces_of(path: str) -> tuple[str, ...]:
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(held.id_to_piece(i) for i in range(held.get_piece_size()) if not (held.is_control(i) or held.is_unknown(i) or held.is_byte(i)))


class Automaton:
    """Nodes 0 (a word begins) and 1 (a word goes on) are the roots of the two tries."""

    def __init__(self, pieces: Iterable[str], begins: str = BEGINS):
        self.to: list[dict[str, int]] = [{}, {}]
        whole, parents = [False, False], [(0, ""), (0, "")]
        for piece in pieces:
            at, rest = (0, piece[len(begins) :]) if piece.startswith(begins) else (1, piece)
            if not rest:
                continue
            for c in rest:
                nxt = self.to[at].get(c)
                if nxt is None:
                    nxt = self.to[at][c] = len(self.to)
                    self.to.append({})
                    whole.append(False)
                    parents.append((at, c))
                at = nxt
            whole[at] = True
        self.fails: list[int] = [-1] * len(self.to)
        self.pops: list[int] = [0] * len(self.to)
        level = [*self.to[0].values(), *self.to[1].values()]
        while level:  # shallow nodes first: a failure leads to a node nearer to its root
            below = []
            for v in level:
                u, c = parents[v]
                if whole[v]:
                    self.fails[v], self.pops[v] = 1, 1
                else:
                    z, n = self.fails[u], self.pops[u]
                    while z >= 0 and c not in self.to[z]:
                        n += self.pops[z]
                        z = self.fails[z]
                    if z >= 0:
                        self.fails[v], self.pops[v] = self.to[z][c], n
                below += self.to[v].values()
            level = below

    def count(self, word: str) -> int:
        """Pieces of the word; 0 if it can't be cut whole."""
        to, fails, pops, at, n = self.to, self.fails, self.pops, 0, 0
        for c in word:
            while c not in to[at]:
                if fails[at] < 0:
                    return 0
                n += pops[at]
                at = fails[at]
            at = to[at][c]
        while at != 1:
            if fails[at] < 0:
                return 0
            n += pops[at]
            at = fails[at]
        return n


@cache
def _automaton(path: str) -> tuple[Automaton, dict[str, int]]:
    return Automaton(pieces_of(path)), {}


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(path)
        for batch in slices(batches, most=8 << 20):
            parts = pc.ascii_split_whitespace(batch.column("text").fill_null("").cast(pa.large_string()))
            coded = parts.flatten().dictionary_encode()
            if len(known) > REMEMBERED:
                known.clear()
            counts = np.zeros(len(coded.dictionary), np.int64)
            for i, w in enumerate(coded.dictionary.to_pylist()):
                n = known.get(w)
                if n is None:
                    n = known[w] = automaton.count(w) if w else -1
                counts[i] = n
            each = counts[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
            unknown = sums(each == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (sums(each >= 0), sums(np.maximum(each, 0)) + unknown, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens, n_unknown), one for each row of ``docs``; unknown words count as one token each."""
    return docs.select("doc_id", "text").mapInArrow(_counted(vocabulary or default_vocabulary()), "doc_id long, n_words long, n_tokens long, n_unknown long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, word pieces and unknown words of each document."""
    return token_counts(documents(spark, sf_dir))
