"""Encode whole texts with a byte-level BPE tokenizer, each distinct run once.

The tokenizer's pattern takes contractions, runs of letters, digits and marks, each with one space before it, and
runs of white space but for the last one before a word.  Texts are cut where these pieces certainly end, the distinct
runs are encoded in one call of ``tiktoken`` over the same vocabulary (its ids are those of the ``tokenizers``
library: compared over all characters, and by tests on random texts), and the ids of the texts are gathered from them.

Texts that the library itself encodes: those that hold a special token's string, white space outside ASCII, or
bytes that are not UTF-8.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

from nextbest.llm.bpe import Store
from nextbest.llm.runs import LETTER, OTHER, SPACE, classes, distinct, gather

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class ByteEncoder:
    """``path``: the library's file; ``ranks``: the same vocabulary as ranks; ``entries``: runs kept from batch to batch."""

    def __init__(self, path: str, ranks: str, entries: int = 800_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self.known = Store(entries)
        self.bytes = np.zeros(max(known.values()) + 1, dtype=np.int64)
        self.bytes[list(known.values())] = [len(x) for x in known]
        sample = b"It's  one,\n\n two_3 \xc3\xa9\xe6\x97\xa5!"
        if self.plain(sample).tolist() != self.encoding.encode_ordinary(sample.decode()):
            raise ValueError("the ranks must be those of the tokenizer")

    def plain(self, text: bytes) -> np.ndarray:
        """The library's own encoding."""
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")

    def _alone(self, text: bytes) -> bool:
        return any(x in text for x in self.specials) or (any(x in text for x in _LEADS) and _ODD_SPACE.search(text) is not None)

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = {i: self.plain(t) for i, t in enumerate(texts) if self._alone(t)}
        size = np.fromiter((0 if i in whole else len(t) for i, t in enumerate(texts)), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(size)])
        data = b"".join([t for i, t in enumerate(texts) if i not in whole])
        if not data:
            return [whole.get(i, np.zeros(0, "<u4")) for i in range(len(texts))]
        starts = self._starts(np.frombuffer(data, dtype=np.uint8), begin)
        index, runs = distinct(data, starts)
        try:
            ids, first, many = self._ids(runs)
        except UnicodeDecodeError:
            self.known = Store(2 * self.known.entries)
            return [self.plain(t) for t in texts]
        flat, at = gather(index, ids, first, many)
        cut = at[np.searchsorted(starts, begin)].tolist()
        return [whole[i] if i in whole else flat[a:b] for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    @staticmethod
    def _starts(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where runs start: beside white space, and between letters, digits and marks unless a contraction may stand there."""
        kind = classes(raw)
        left, right = kind[:-1], kind[1:]
        cut = np.zeros(len(raw) + 1, dtype=bool)
        inner = cut[1:-1]
        inner |= (left != right) & (left != SPACE) & (left != OTHER) & (right != OTHER) & ((raw[:-1] != ord("'")) | (right != LETTER))
        inner |= (left != SPACE) & (right == SPACE)
        # white space before a word: a last blank belongs to the word, another last character stands alone
        words = np.flatnonzero((left == SPACE) & (right != SPACE)) + 1
        words = words[~np.isin(words, begin)]
        cut[words[raw[words - 1] != ord(" ")]] = True
        cut[words - 1] = True
        cut[begin] = True
        return np.flatnonzero(cut[:-1])

    def _ids(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many runs, where those of each run begin, and how many it has."""
        self._learn(self.known.lacking(set(runs)))
        got = list(map(self.known.young.__getitem__, runs))
        many = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return np.frombuffer(b"".join(got), dtype="<u4"), np.cumsum(many) - many, many

    def _learn(self, runs: list[bytes]) -> None:
        kept = self.known.young
        rest = []
        for run in runs:
            if run.isspace():
                kept[run] = np.array(self.encoding.encode_ordinary(run.decode()), dtype="<u4").tobytes()
            else:
                rest.append(run)
        ids = np.array(self.encoding.encode_ordinary(b"\n".join([*rest, b""]).decode()), dtype="<u4")
        ends = np.cumsum(self.bytes[ids])
        size = np.fromiter(map(len, rest), np.int64, len(rest))
        stop = np.cumsum(size + 1) - 1
        last = np.searchsorted(ends, stop, side="right")
        if (ends[last - 1] != stop).any():
            raise ValueError("a run must end where one of its ids ends")
        first = np.searchsorted(ends, stop - size, side="right")
        flat = ids.tobytes()
        kept.update(zip(rest, [flat[a:b] for a, b in zip((4 * first).tolist(), (4 * last).tolist(), strict=True)], strict=True))


_ENCODERS: dict[tuple, ByteEncoder] = {}


def encoder(path: str, ranks: str) -> ByteEncoder:
    """One encoder for each tokenizer and Python worker."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = ByteEncoder(path, ranks)
    return _ENCODERS[path, ranks]
