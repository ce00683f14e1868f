"""Token counts by greedy longest match in linear time, without building the pieces.

The vocabulary is a trie. Every node has a failure link to the node of what is left of its string
after the longest pieces at its front are taken, and the number of those pieces. Reading a word
follows an edge or, where there is none, the failure link and adds its number: no symbol is read twice.
A word is its bytes behind one space, as in vocabularies whose word-initial pieces begin with a space.
"""

from __future__ import annotations

import json
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from paperlake.llm.frames import map_texts

_MEMO = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = set(chain(range(33, 127), range(161, 173), range(174, 256)))
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces_in(path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizer file, without its special tokens."""
    with open(path, encoding="utf-8") as file:
        definition = json.load(file)
    alphabet = byte_alphabet()
    special = {t["content"] for t in definition["added_tokens"]}
    return [bytes(alphabet[c] for c in piece) for piece in definition["model"]["vocab"] if piece not in special]


class Automaton:
    """Trie edges by ``node << 8 | byte``, failure links and the pieces they pop. Node 0 is the root."""

    def __init__(self, pieces: list[bytes]) -> None:
        if not {bytes([b]) for b in range(256)} <= set(pieces):
            raise ValueError("every single byte must be a piece, or a word could have no match")
        edges: dict[int, int] = {}
        levels: list[list[tuple[int, int, int]]] = []
        final = [False]
        for piece in pieces:
            node = 0
            for depth, byte in enumerate(piece):
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(final)
                    final.append(False)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((node, byte, edges[key]))
                node = edges[key]
            final[node] = True
        links, popped = [0] * len(final), [0] * len(final)
        for parent, byte, node in chain.from_iterable(levels):
            if final[node]:
                popped[node] = 1  # the whole string is one piece
                continue
            link, count = links[parent], popped[parent]
            while link << 8 | byte not in edges:
                count += popped[link]
                link = links[link]
            links[node], popped[node] = edges[link << 8 | byte], count
        self.edges, self.links, self.popped = edges, links, popped

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest match."""
        edges, links, popped = self.edges, self.links, self.popped
        node = total = 0
        for byte in word:
            while (node << 8 | byte) not in edges:
                total += popped[node]
                node = links[node]
            node = edges[node << 8 | byte]
        while node:
            total += popped[node]
            node = links[node]
        return total


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``found.n_words`` and ``found.n_tokens`` of every document.

    ``path`` names a byte-level tokenizer file on the driver. Words end at ASCII white space; null and
    empty texts have none. Distinct words are counted once while a task remembers them.
    """
    built = Automaton(pieces_in(path))
    shared = docs.sparkSession.sparkContext.broadcast((built.edges, built.links, built.popped))  # bounded by the vocabulary

    def run(texts: list[bytes], memo={}, own=[]) -> list[pa.Array]:  # noqa: B006  one per task
        if not own:
            own.append(Automaton.__new__(Automaton))
            own[0].edges, own[0].links, own[0].popped = shared.value
        count = own[0].count
        words, tokens = [], []
        for text in texts:
            found = text.split()
            total = 0
            for word in found:
                n = memo.get(word)
                if n is None:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    n = memo[word] = count(b" " + word)
                total += n
            words.append(len(found))
            tokens.append(total)
        return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]

    return map_texts(docs, "n_words long, n_tokens long", run)
