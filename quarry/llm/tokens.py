"""Exact encoding through the tokenizers library with a memo of white-space delimited pieces.

Both tokenizer files split text so that no token spans a step from a non-space to a white-space character, and their
patterns never look behind. A text may therefore be cut at each such step, every distinct piece encoded once, and the
pieces' ids joined: the result is the library's own result for the whole text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.common import coded, resident, slices

#: The characters of Unicode's White_Space property, by code point.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Bytes that stand for themselves in a byte-level vocabulary; the others follow from character 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: A run of white space with the run of other characters after it.
PIECES = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Runs of other characters alone.
WORDS = re.compile(f"[^{WHITE_SPACE}]+")


def merge_ranks(path: str):
    """The file's merges as a tiktoken encoding, which is faster on single pieces; None unless the ids of the byte-level
    vocabulary follow the order of its merges, in which case both libraries merge alike."""
    import tiktoken

    file = json.load(open(path, encoding="utf-8"))
    model, before = file["model"], file["pre_tokenizer"]
    if model["type"] != "BPE" or file["normalizer"] or before != before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
        return None
    vocab, plain = model["vocab"], {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)} | {chr(b): b for b in PLAIN}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or any(vocab.get(c, 256) > 255 for c in plain):
        return None
    ranks = {bytes(plain[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}
    # Fixed value: the published pattern of byte-level BPE.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ended_ranks(path: str):
    """For a byte-level vocabulary whose words end in `</w>`: a function from a word's bytes to its ids, the byte that
    stands for each last byte, and the ids of a single mark by itself.

    The last byte of a word is a symbol of its own kind. Words of Latin-1 letters leave enough bytes unused to give each
    last byte a stand-in, so that the merges become those of plain bytes. None unless the ids follow the merges' order.
    """
    import tiktoken

    file = json.load(open(path, encoding="utf-8"))
    model = file["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>":
        return None
    vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(pairs)):
        return None
    letters, trails = range(ord("a"), ord("z") + 1), range(0x9F, 0xC0)
    ends = {b: bytes([b - 32]) for b in letters} | {b: bytes([b - 0xA0 if b > 0x9F else 0x20]) for b in trails}
    used = {*letters, *trails, 0xC2, 0xC3}
    plain = {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)} | {chr(b): b for b in PLAIN}
    ranks = {}
    for token, i in vocab.items():
        ended = token.endswith("</w>")
        raw = [plain.get(c) for c in (token[:-4] if ended else token)]
        if raw and used.issuperset(raw) and not (ended and raw[-1] not in ends):
            ranks[bytes(raw[:-1]) + ends[raw[-1]] if ended else bytes(raw)] = i
    core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    marks = {m: array("I", [vocab[m + "</w>"]]).tobytes() for m in ".,;:!?" if m + "</w>" in vocab}
    return core._encode_single_piece, ends, marks


class PieceEncoder:
    """Encodes Arrow string arrays. Texts are cut at single spaces and line feeds, distinct pieces are found by Arrow's
    dictionary encoding, looked up in a memo or encoded once, and the ids are put together by index arithmetic.

    A text in which white space precedes a space or line feed (or that holds the mark put before first pieces) has
    cuts that are not safe for a tokenizer that keeps white space; it is cut by pattern instead. Memory: two generations
    of at most `keep` pieces of up to `longest` characters (longer ones are encoded but not kept) and arrays for
    `at_once` characters of text, or one text if that is longer.
    """

    FIRST = "\x01"

    def __init__(self, path: str, drops_space: bool = False, keep: int = 300_000, longest: int = 48, at_once: int = 6_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space, self.keep, self.longest, self.at_once = drops_space, keep, longest, at_once
        self.plain = None if drops_space else merge_ranks(path)
        self.ended = ended_ranks(path) if drops_space else None
        if self.plain:
            self.sizes = np.array([len(x) for x in byte_table(self.tokenizer)], dtype=np.int64)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _fresh(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces (by key) that no memo holds."""
        if self.drops_space:
            return self._fresh_words(keys)
        done: list[bytes | None] = [None] * len(keys)
        if self.plain:
            # pieces that begin with a space or line feed and end in another character divide again where they are
            # joined, so many are encoded as one text; the bytes of the ids tell where each ends
            special, space = self.special, WHITE_SPACE
            hard = any(x in " ".join(keys) for x in special)
            easy = [i for i, k in enumerate(keys) if k and len(k) <= 200 and k[0] != self.FIRST and k[-1] not in space and not (hard and any(x in k for x in special))]
            for at in range(0, len(easy), 2000):
                part = easy[at : at + 2000]
                texts = [k if k[0] == "\n" else " " + k for k in map(keys.__getitem__, part)]
                ids = np.array(self.plain.encode_ordinary("".join(texts)), dtype="<u4")
                ends = np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in texts])
                cuts = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()
                raw, before = ids.tobytes(), 0
                for i, end in zip(part, cuts):
                    done[i] = raw[before:end]
                    before = end
        rest = [i for i, d in enumerate(done) if d is None]
        if rest:
            texts = [k[1:] if k[:1] == self.FIRST else k if k[:1] == "\n" else " " + k for k in map(keys.__getitem__, rest)]
            for i, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                done[i] = array("I", e.ids).tobytes()
        return done

    def _fresh_words(self, keys: list[str]) -> list[bytes]:
        """Ids of words without white space. Words of Latin-1 letters, with at most one mark after them, are merged by
        the faster library; the tokenizers library encodes the others."""
        done: list[bytes | None] = [None] * len(keys)
        if self.ended:
            one, ends, marks = self.ended
            for i, k in enumerate(keys):
                tail = marks.get(k[-1:])
                core = k[:-1] if tail else k
                if core.isalpha() and len(k) <= 60 and (k.isascii() or max(k) < "\u0100"):
                    b = core.lower().encode()
                    last = ends.get(b[-1])
                    if last is not None:
                        done[i] = array("I", one(b[:-1] + last)).tobytes() + (tail or b"")
        rest = [i for i, d in enumerate(done) if d is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([keys[i] for i in rest], add_special_tokens=False)):
            done[i] = array("I", e.ids).tobytes()
        return done

    def pieces(self, keys: list[str]) -> list[bytes]:
        """Ids of each of a list of distinct keys."""
        if len(self.memo) > self.keep:
            self.old, self.memo = self.memo, {}
        got = list(map(self.memo.get, keys))
        old, new = self.old, []
        for i, ids in enumerate(got):
            if ids is None:
                ids = old.get(keys[i])
                if ids is None:
                    new.append(i)
                else:
                    got[i] = self.memo[keys[i]] = ids
        if new:
            names = [keys[i] for i in new]
            for i, k, ids in zip(new, names, self._fresh(names)):
                got[i] = ids
                if len(k) <= self.longest:
                    self.memo[k] = ids
        return got

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Codes of all pieces of the texts, where each text's begin, and the distinct keys."""
        if self.drops_space:
            return coded(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
        unsafe = pc.match_substring_regex(texts, f"[{WHITE_SPACE}][ \n]|{self.FIRST}")
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(self.FIRST, texts, ""), "\n", " \n"), " ")
        if pc.any(unsafe).as_py():
            # the pattern keeps a space before a piece; keys leave one out
            rows, odd = lists.to_pylist(), unsafe.to_pylist()
            for i, t in enumerate(texts.to_pylist()):
                if odd[i]:
                    rows[i] = [p[1:] if p[0] == " " and p[1:2] not in ("\n", self.FIRST) else p if p[0] == "\n" else self.FIRST + p for p in PIECES.findall(t)]
            lists = pa.array(rows, type=pa.list_(pa.string()))
        return coded(lists)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts, one after the other, and where each text's begin (one place more than texts).
        Null counts as empty."""
        ids, ends, before = [], [np.zeros(1, dtype=np.int64)], 0
        for part in slices(texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.string()), self.at_once):
            codes, offsets, keys = self._cut(part)
            got = self.pieces(keys)
            flat = np.frombuffer(b"".join(got), dtype="<u4")
            size = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
            start = np.cumsum(size) - size
            each = size[codes]
            upto = np.concatenate([[0], np.cumsum(each)])
            ids.append(flat[np.repeat(start[codes] - upto[:-1], each) + np.arange(upto[-1])])
            ends.append(upto[offsets[1:]] + before)
            before += int(upto[-1])
        return np.concatenate(ids) if ids else np.zeros(0, dtype="<u4"), np.concatenate(ends)

    def encode_bytes(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        ids, ends = self.encode(texts)
        raw, at = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]


def encoder(path: str, drops_space: bool = False) -> PieceEncoder:
    """The worker's encoder for a tokenizer file; one that cuts at all white space meets fewer distinct pieces and keeps
    half as many."""
    return resident(("pieces", path, drops_space), lambda: PieceEncoder(path, drops_space, keep=150_000 if drops_space else 300_000))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_table(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary: printable Latin-1 stands for itself, other bytes for 256 on."""
    of = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out
