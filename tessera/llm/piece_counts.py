"""Token counts by a linear longest-match automaton over a piece vocabulary."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import bounded, slices, split_words

#: Stands before each word, as in the vocabulary's word-initial pieces.
WORD_START = "▁"


def load_pieces(model_path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model (control, unknown and byte pieces left out)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class PieceAutomaton:
    """Greedy longest-match piece counts in time linear in the word.

    A trie of the pieces, in which each node has a failure link (the node that remains once
    the greedy pieces of its string have been popped) and the number of tokens popped on the
    way. A character with no piece of its own counts as its UTF-8 bytes.
    """

    def __init__(self, pieces: Iterable[str]):
        step: dict[tuple[int, str], int] = {}
        parent, letter, ends = [0], [""], [False]
        for piece in pieces:
            node = 0
            for char in piece:
                after = step.get((node, char))
                if after is None:
                    after = step[node, char] = len(parent)
                    parent.append(node)
                    letter.append(char)
                    ends.append(False)
                node = after
            ends[node] = node != 0 or ends[node]
        self.step = step
        self.fail, self.popped = [0] * len(parent), [0] * len(parent)
        depth_order = self._by_depth(parent)
        for node in depth_order:
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
            elif parent[node] == 0:  # no piece of its own: bytes
                self.fail[node], self.popped[node] = 0, len(letter[node].encode("utf-8", "surrogatepass"))
            else:
                at, tokens = self._advance(self.fail[parent[node]], letter[node], self.popped[parent[node]])
                self.fail[node], self.popped[node] = at, tokens

    @staticmethod
    def _by_depth(parent: list[int]) -> Iterator[int]:
        below: list[list[int]] = [[] for _ in parent]
        for node in range(1, len(parent)):
            below[parent[node]].append(node)
        queue = deque(below[0])
        while queue:
            node = queue.popleft()
            queue.extend(below[node])
            yield node

    def _advance(self, node: int, char: str, tokens: int) -> tuple[int, int]:
        step, fail, popped = self.step, self.fail, self.popped
        while True:
            after = step.get((node, char))
            if after is not None:
                return after, tokens
            if node == 0:
                return 0, tokens + len(char.encode("utf-8", "surrogatepass"))
            tokens += popped[node]
            node = fail[node]

    def count(self, word: str) -> int:
        """Number of tokens of one word."""
        node = tokens = 0
        for char in word:
            node, tokens = self._advance(node, char, tokens)
        while node:
            tokens += self.popped[node]
            node = self.fail[node]
        return tokens


def greedy_count(word: str, pieces: set[str]) -> int:
    """Token count by trying the longest piece at each place (quadratic; for tests)."""
    tokens = at = 0
    longest = max(map(len, pieces), default=0)
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + size] in pieces:
                tokens, at = tokens + 1, at + size
                break
        else:
            tokens, at = tokens + len(word[at].encode("utf-8", "surrogatepass")), at + 1
    return tokens


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """``doc_id, n_words, n_tokens`` per row of ``docs``, in one pass without a shuffle.

    Words are parted by ASCII white space, each is preceded by WORD_START. The automaton is
    broadcast: its size is that of the vocabulary, which is given. Each distinct word of a
    batch goes through it once.

    Null and empty texts have no tokens; repeated rows give repeated results; an empty table
    gives none; a very long text is counted whole, in a batch of its own; columns other than
    doc_id and text are not read.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(PieceAutomaton(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = automaton.value.count
        for batch in slices(batches, "text"):
            words, offsets = split_words(pc.fill_null(batch.column("text"), ""))
            coded = words.dictionary_encode()
            each = np.fromiter((count(WORD_START + w) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]])],
                names=["doc_id", "n_words", "n_tokens"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint"
    return docs.select("doc_id", "text").transform(bounded).mapInArrow(run, schema)
