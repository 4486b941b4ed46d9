"""Token ids of a public byte-level BPE vocabulary, a whole text to a call.

Ids equal those of the `tokenizers` file of the same vocabulary with no special tokens added, and the tests hold
them against it: the literal end-of-document marker in a text is its one id there. An encoder made with marker=False takes
it as ordinary text, for uses in which that id must stand for ends of documents only.
"""

from __future__ import annotations

import base64
import re
from functools import cached_property

#: The marker of the vocabulary's file, with its id (fixed values).
MARKER, MARKER_ID = "<|endoftext|>", 50_256
#: The vocabulary's pattern with its alternatives in another order: letters, which are most of a text, are tried before the
#: contractions. Only the latter begin with an apostrophe, so both orders cut every text alike.
SOLID = r" ?\p{L}+|'(?:[sdmt]|ll|ve|re)| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
PATTERN = SOLID + r"|\s+(?!\S)|\s+"
#: What `\s` stands for in it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class WordEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None, marker: bool = True):
        with open(path or default_path(), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = {MARKER: MARKER_ID} if marker else {}
        self.bpe = self.encoding(PATTERN)
        #: One more than the greatest id.
        self.size = max(max(self.ranks.values()), MARKER_ID if marker else 0) + 1
        #: Places before the last of several white characters that something else follows, which the pattern never joins.
        self.joints = re.compile(f"(?<=[{WHITE}])(?=[{WHITE}][^{WHITE}])" + "".join(f"(?![{WHITE}]{re.escape(m)})" for m in self.special))

    def encoding(self, pattern: str):
        import tiktoken

        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.special)

    @cached_property
    def cut(self):
        """For texts cut at their joints: there the pattern needs not look ahead."""
        return self.encoding(SOLID + r"|\s+")

    def encode(self, text: str) -> bytes:
        try:
            found = [self.bpe.encode_to_numpy(text, allowed_special="all")]
        except ValueError:  # a million white characters in a row are more than the pattern can look ahead from
            found = [self.cut.encode_to_numpy(t, allowed_special="all") for t in self.joints.split(text)]
        return b"".join(x.astype("<u4", copy=False).tobytes() for x in found)


_KEPT: dict[tuple[str | None, bool], WordEncoder] = {}


def encoder(path: str | None = None, marker: bool = True) -> WordEncoder:
    """One encoder per Python worker, vocabulary and way with the marker."""
    if (path, marker) not in _KEPT:
        _KEPT[path, marker] = WordEncoder(path, marker)
    return _KEPT[path, marker]
