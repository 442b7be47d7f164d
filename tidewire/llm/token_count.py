"""Operator 1: greedy word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.tables import in_arrow, picked
from tidewire.llm.text import slices

#: Marks a word's start, as in the vocabulary file.
START = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words remembered by a task before it forgets them all; bounds its memory.
MEMO = 400_000


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Ordinary pieces (no control, unknown or byte pieces) of a sentencepiece model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (m.is_control, m.is_unknown, m.is_byte, m.is_unused)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not any(f(i) for f in odd)]


class Automaton:
    """Trie of the pieces; each node has a failure link and the number of pieces popped on taking it.

    From node v (a prefix that longest match has read), failing pops ``pops[v]`` finished pieces and
    goes on at ``fail[v]``, the node of what is left; -1 where no sequence of pieces covers it. Each
    character is read once, so a word costs time linear in its length.
    """

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.pops = [-1], [0]
        ends = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                if (u := self.next[v].get(c)) is None:
                    u = self.next[v][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(-1)
                    self.pops.append(0)
                    ends.append(False)
                v = u
            ends[v] = v > 0
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if ends[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.next[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of greedy longest match over ``word``; -1 if some part is not covered."""
        step, fail, pops = self.next, self.fail, self.pops
        v = n = 0
        for c in word:
            while (u := step[v].get(c)) is None:
                if fail[v] < 0:
                    return -1
                n += pops[v]
                v = fail[v]
            v = u
        while v:
            if fail[v] < 0:
                return -1
            n += pops[v]
            v = fail[v]
        return n


def token_counts(docs: DataFrame, path: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_tokens, n_unknown``.

    Words are runs of characters other than space and 0x09-0x0D; each, with a start mark before it,
    is cut by greedy longest match. A word that pieces cannot cover counts as one unknown token. A
    null or empty text has zero of all; repeated rows give repeated results; other columns are not
    read. The automaton's size depends on the vocabulary alone.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(read_pieces(path)))
    key = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = automaton.value.count, {}
        for whole in batches:
            for batch in slices(whole, "_text"):
                n_words, n_tokens, n_unknown = [], [], []
                for value in batch.column("_text"):
                    words = (value.as_py() or "").translate(BLANKS).split(" ")
                    n = tokens = unknown = 0
                    for w in words:
                        if w:
                            c = memo.get(w)
                            if c is None:
                                if len(memo) >= MEMO:
                                    memo.clear()
                                c = count(START + w)
                                if len(w) < 64:
                                    memo[w] = c
                            n += 1
                            if c < 0:
                                unknown += 1
                                tokens += 1
                            else:
                                tokens += c
                    n_words.append(n)
                    n_tokens.append(tokens)
                    n_unknown.append(unknown)
                cols = [batch.column("_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))]
                yield pa.RecordBatch.from_arrays(cols, names=[doc_id, "n_words", "n_tokens", "n_unknown"])

    return in_arrow(picked(docs, _id=doc_id, _text=text), run, f"`{doc_id}` {key}, n_words long, n_tokens long, n_unknown long")


BLANKS = {c: " " for c in range(0x09, 0x0E)}
