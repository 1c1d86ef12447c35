"""Token counts by dynamic programming over a trie of pre-tokens (operator 10).

The vocabulary is a fixed file's pieces; a piece's log probability follows Zipf's law from its place in the file. A
text's pre-tokens are its runs of non-white-space characters with a word mark before each. Of all ways to cut a
pre-token into pieces the most probable one counts (of equal ones the one with fewest pieces); a character that no piece
holds is spelled in its UTF-8 bytes, one token each.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.common import by_list, coded, map_rows, resident, scattered, slices
from quarry.llm.tokens import WORDS, tokenizer_path

MARK = "▁"


def vocabulary(path: str) -> dict[str, float]:
    """Log probability of each ordinary piece: minus the log of its place, normalised over the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / (k + 1) for k in range(len(found))))
    return {piece: -math.log(k + 1) - norm for k, piece in enumerate(found)}


class TrieCounter:
    """Counts of pre-tokens. A trie node stands for a prefix and holds the best score and token count of any cut of it,
    found once from the nodes above it; the count at a pre-token's last node is its result. The trie starts anew beyond
    `nodes` nodes; results are kept in two generations of about `keep`."""

    def __init__(self, scores: dict[str, float], nodes: int = 700_000, keep: int = 200_000):
        self.scores, self.nodes, self.keep = scores, nodes, keep
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.results: dict[str, tuple[int, int]] = {}
        self.old: dict[str, tuple[int, int]] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = array("d", [0.0]), array("i", [0])

    def insert(self, word: str) -> int:
        """Token count of a pre-token."""
        child, best, count, scores = self.child, self.best, self.count, self.scores
        node, path, depth = 0, [0], 0
        for c in word:
            depth += 1
            key = node << 21 | ord(c)
            nxt = child.get(key)
            if nxt is None:
                # the character alone, in bytes if no piece is equal to it; then every piece that ends here
                f = best[node] + (scores[c] if c in scores else self.unknown)
                n = count[node] + (1 if c in scores else len(c.encode("utf-8", "surrogatepass")))
                for size in range(2, min(depth, self.longest) + 1):
                    s = scores.get(word[depth - size : depth])
                    if s is not None:
                        up = path[depth - size]
                        g = best[up] + s
                        if g > f or (g == f and count[up] + 1 < n):
                            f, n = g, count[up] + 1
                nxt = child[key] = len(best)
                best.append(f)
                count.append(n)
            node = nxt
            path.append(node)
        return count[node]

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each of a list of distinct pieces of text."""
        if len(self.results) > self.keep:
            self.old, self.results = self.results, {}
        got = list(map(self.results.get, texts))
        for i, found in enumerate(got):
            if found is None:
                text = texts[i]
                found = self.old.get(text)
                if found is None:
                    if len(self.best) > self.nodes:
                        self.clear()
                    words = WORDS.findall(text)
                    found = len(words), sum([self.insert(MARK + w) for w in words])
                if len(text) <= 48:
                    self.results[text] = found
                got[i] = found
        return got


def counter(path: str) -> TrieCounter:
    """The worker's trie for a vocabulary file."""
    return resident(("trie", path), lambda: TrieCounter(vocabulary(path)))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each row. Null, empty and blank texts have none. Whole texts; equal rows give
    equal results; an empty table gives no rows."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def of(batch):
        n, t = [], []
        for part in slices(batch.column(1)):
            # pieces between single spaces and line feeds; one with other white space in it holds several pre-tokens
            codes, offsets, pieces = coded(pc.split_pattern(pc.replace_substring(part, "\n", " "), " "))
            found = np.array(counter(path).counts(pieces), dtype=np.int64).reshape(len(pieces), 2)
            n.append(by_list(found[codes, 0], offsets))
            t.append(by_list(found[codes, 1], offsets))
        return {"doc_id": batch.column(0), "n_pretokens": np.concatenate(n), "n_tokens": np.concatenate(t)}

    return map_rows(scattered(docs, "doc_id", "text"), of, "doc_id long, n_pretokens long, n_tokens long")
