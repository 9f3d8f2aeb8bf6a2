"""Public vocabularies as tries that a task walks with arrays."""

from __future__ import annotations

import numpy as np

from orograph.llm.textnp import U

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


def pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a SentencePiece model; control and byte pieces are empty strings."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(len(sp))]
    return [(sp.id_to_piece(i) if ok else "", sp.get_score(i)) for i, ok in enumerate(plain)]


def byte_ids(path: str) -> np.ndarray:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = np.full(256, -1, np.int64)
    for i in range(len(sp)):
        if sp.is_byte(i):
            out[int(sp.id_to_piece(i)[3:-1], 16)] = i
    return out


class Trie:
    """Nodes by number (0 the root); children found in an open-addressed table of (node, code point)."""

    def __init__(self, words: list[tuple[str, int]], roots: int = 1):
        """``words``: (text, id), or (text, id, root) with more than one root."""
        self.kids: list[dict[str, int]] = [{} for _ in range(roots)]
        self.token: list[int] = [-1] * roots
        for text, i, *root in words:
            node = root[0] if root else 0
            for ch in text:
                child = self.kids[node].get(ch)
                if child is None:
                    child = self.kids[node][ch] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                node = child
            self.token[node] = i

    def arrays(self) -> dict[str, np.ndarray]:
        edges = [(n << 21 | ord(ch), to) for n, kids in enumerate(self.kids) for ch, to in kids.items()]
        size = 1 << max(4, int(np.ceil(np.log2(4 * len(edges) + 1))))
        slots, child, reach = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int64), 1
        for key, to in edges:
            at = (key * SPREAD % (1 << 64)) >> (64 - (size.bit_length() - 1))
            start = at
            while slots[at] >= 0:
                at += 1
            slots[at], child[at], reach = key, to, max(reach, at - start + 1)
        return {"keys": slots, "to": child, "reach": np.array(reach), "shift": np.array(64 - (size.bit_length() - 1)), "token": np.array(self.token, np.int64)}


#: An odd multiplier that spreads keys over the table by their product's high bits.
SPREAD = 0x9E3779B97F4A7C15


def step(t: dict[str, np.ndarray], node: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """The child of each node by a code point, or -1."""
    key = (node << 21) | cp
    at = ((key.astype(U) * U(SPREAD)) >> U(t["shift"])).astype(np.int64)
    out, open_ = np.full(len(key), -1, np.int64), np.arange(len(key))
    for _ in range(int(t["reach"])):
        found = t["keys"][at]
        hit = found == key
        out[open_[hit]] = t["to"][at[hit]]
        go = ~hit & (found >= 0)
        if not go.any():
            break
        open_, key, at = open_[go], key[go], at[go] + 1
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, bounds)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(size)])


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes."""
    return (x >> U(11)).astype(np.float64) * 2.0**-53
