"""Token counts under a public byte-level BPE vocabulary, counted word by word.

The vocabulary's pattern never lets a token reach from a sign that is no blank over the
blanks that follow it. A text therefore falls into atoms, each the blanks before a word
and the word, whose token counts add up exactly; the count of an atom is remembered.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import tiktoken

#: Where the rank file of the public tokenizer lies; read by the driver only.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that goes with the public rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ATOM = re.compile(r"\s*\S+")


def read_ranks(path: str = DEFAULT_RANKS) -> bytes:
    """The rank file as it is (under a megabyte), to be sent to the executors."""
    with open(path, "rb") as f:
        return f.read()


class TokenCounter(dict):
    """atom -> number of tokens; forgets everything when it grows beyond ``most`` atoms."""

    def __init__(self, ranks: bytes, most: int = 400_000):
        super().__init__()
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.most = most

    def __missing__(self, atom: str) -> int:
        n = len(self.encoding.encode_ordinary(atom))
        if len(atom) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[atom] = n
        return n

    def each(self, atoms: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, atoms), np.int64, len(atoms))

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, atoms_of(text)))


def atoms_of(text: str) -> list[str]:
    """Blanks and word, blanks and word, ...; blanks at the end of the text stand alone."""
    atoms = _ATOM.findall(text)
    rest = len(text) - sum(map(len, atoms))
    if rest:
        atoms.append(text[len(text) - rest :])
    return atoms


_made: list = []


def counter(ranks: bytes) -> TokenCounter:
    """One per Python worker."""
    if not _made or _made[0] is not ranks:
        _made[:] = [ranks, TokenCounter(ranks)]
    return _made[1]
