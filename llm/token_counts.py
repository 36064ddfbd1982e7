"""Token counts by a linear longest-match automaton over a public vocabulary.

Greedy word pieces take the longest piece of the vocabulary at every position. The automaton is the trie of all pieces
with two numbers for each node: where to go when no edge fits (the failure link, the trie node of what is left after
the pieces that greedy matching takes from the node's string), and how many tokens those pieces are. Reading a word
is then one pass over its characters that only adds up numbers; no piece is ever built.

Characters that are no piece of their own count as their UTF-8 bytes, so every text has a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from llm.common import code_points, ragged, segment_sum, text_chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"
LONG_WORD = 64


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces of a public sentencepiece vocabulary, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in plain]


class Automaton:
    """Trie of ``pieces`` with failure links and the tokens popped on the way.

    ``keys``/``goes`` are the edges sorted by (node, character); ``fail`` and ``pops`` belong to each node (0 is the
    root); ``rest`` is the number of tokens that the end of a word still adds.
    """

    def __init__(self, pieces: list[str]):
        children: list[dict[int, int]] = [{}]
        cost: list[int] = [0]  # of the piece that ends at the node, 0 if none does

        def insert(text: str, tokens: int) -> None:
            node = 0
            for c in map(ord, text):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    cost.append(0)
                node = children[node][c]
            cost[node] = cost[node] or tokens

        known = {p for p in pieces if p}
        for piece in sorted(known):
            insert(piece, 1)
        for c in sorted({c for p in known for c in p}):
            insert(c, 1 if c in known else len(c.encode()))
        fail, pops = [0] * len(children), [0] * len(children)
        layer = [0]
        while layer:
            below = []
            for node in layer:
                for c, child in children[node].items():
                    below.append(child)
                    if cost[child]:
                        fail[child], pops[child] = 0, cost[child]
                        continue
                    at, popped = fail[node], pops[node]
                    while c not in children[at]:
                        at, popped = fail[at], popped + pops[at]
                    fail[child], pops[child] = children[at][c], popped
            layer = below
        rest = [0] * len(children)
        for node in range(len(children)):
            at = node
            while at:
                rest[node] += pops[at]
                at = fail[at]
        edges = sorted((node << 21 | c, child) for node, kids in enumerate(children) for c, child in kids.items())
        self.keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.goes = np.array([g for _, g in edges], dtype=np.int32)
        self.fail, self.pops, self.rest = (np.array(x, dtype=np.int32) for x in (fail, pops, rest))

    def step(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes after reading one character each, and the tokens popped meanwhile."""
        popped = np.zeros(len(node), dtype=np.int64)
        node, todo = node.astype(np.int64), np.arange(len(node))
        while len(todo):
            key = node[todo] << 21 | char[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
            node[todo[found]] = self.goes[at[found]] if len(self.keys) else 0
            todo, missed = todo[~found], char[todo[~found]]
            root = node[todo] == 0
            # No piece holds the character at all: its bytes are the tokens.
            popped[todo[root]] += 1 + (missed[root] > 0x7F) + (missed[root] > 0x7FF) + (missed[root] > 0xFFFF)
            todo = todo[~root]
            popped[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]
        return node, popped

    def count_words(self, words: pa.Array) -> np.ndarray:
        """Tokens of each word. All words advance together, one character a step; the few very long ones go alone."""
        points, offsets = code_points(words)
        points = points.astype(np.int64)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        node, total = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        short = order[lengths[order] <= LONG_WORD]
        steps = np.searchsorted(-lengths[short], -np.arange(1, LONG_WORD + 1), side="right")
        for t, alive in enumerate(steps):
            if alive == 0:
                break
            rows = short[:alive]
            node[rows], popped = self.step(node[rows], points[offsets[rows] + t])
            total[rows] += popped
        for row in order[: len(order) - len(short)]:
            node[row], total[row] = self.walk(points[offsets[row] : offsets[row + 1]].tolist())
        return total + self.rest[node]

    def walk(self, chars: list[int]) -> tuple[int, int]:
        """As ``step`` for the characters of one word."""
        if not hasattr(self, "table"):
            self.table = dict(zip(self.keys.tolist(), self.goes.tolist(), strict=True))
            self.plain = self.fail.tolist(), self.pops.tolist()
        (fail, pops), table, node, total = self.plain, self.table, 0, 0
        for c in chars:
            while (to := table.get(node << 21 | c)) is None:
                if node == 0:
                    total += 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                    to = 0
                    break
                total += pops[node]
                node = fail[node]
            node = to
        return node, total


def count_tokens(docs: DataFrame, pieces: list[str], word_start: str = WORD_START) -> DataFrame:
    """doc_id, n_words, n_tokens for each row: greedy longest-match pieces of ``word_start`` + word, summed over the words.

    Words are the runs between ASCII white space. Needs doc_id and text, other columns are ignored; null and empty
    texts have no words and no tokens; repeated rows are counted each. What every task gets is the vocabulary, a file
    of fixed size.
    """
    automaton = Automaton(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in text_chunks(batches):
            words, offsets = ragged(pc.ascii_split_whitespace(text))
            kinds = words.dictionary_encode()
            real = pc.not_equal(pc.binary_length(kinds.dictionary), 0).to_numpy(zero_copy_only=False)
            started = pc.binary_join_element_wise(pa.scalar(word_start, pa.large_string()), kinds.dictionary, pa.scalar("", pa.large_string()))
            each = np.where(real, automaton.count_words(started), 0)
            at = np.asarray(kinds.indices)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(segment_sum(real[at], offsets).astype(np.int64)), pa.array(segment_sum(each[at], offsets).astype(np.int64))],
                ["doc_id", "n_words", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
