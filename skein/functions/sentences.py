"""Sentence-aware chunks: windows of whole sentences within a budget of tokens, linear in the text.

A token is a run of letters, digits and underscores, or any other character that is no white space; or, with a vocabulary, what
a tokenizer file makes of a sentence. A sentence ends after a full stop, exclamation or question mark (or its full-width form),
with closing quotes and brackets, before white space; and at an empty line. A window takes sentences while their tokens fit the
budget; the next one starts with as many of its last sentences as fit the overlap and leave room for the next sentence. Only a
sentence that alone is over the budget is cut, after each budget's worth of tokens. A chunk is the text between the first and
the last of its sentences as it stands, with the places of its ends in code points.

Defined results: null, empty and white texts have no chunks; all tokens are in some chunk, in order; windows always go on, so
an overlap as large as the budget is the same as one less.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .workers import give_back, text_slices

#: White space of this splitter, marks that end a sentence, and what may close after them.
SPACE = " \\t\\n\\v\\f\\r"
STOPS, CLOSERS = ".!?…。！？", "\"')]}»”’"
TOKEN = re.compile(rf"\w+|[^\w{SPACE}]")
#: All ends begin with one set of letters, so that a search skips the others at once; at an empty line that is its line feed.
END = re.compile(rf"[{STOPS}\n](?:(?<=[{STOPS}])[{re.escape(CLOSERS)}]*(?=[{SPACE}])|(?<=\n)(?=[ \t\r]*\n))")
LEAD = re.compile(rf"[{SPACE}]*")
#: Bytes of text whose chunks a task holds at a time.
SLICE_BYTES = 1 << 20
#: The pattern of byte-level pre-tokenisers, and characters whose classes in it have long been the same in all tables (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLED = "\\u0000-\\u052f\\u2000-\\u2bff\\u3040-\\u3096\\u30a0-\\u30ff\\u4e00-\\u9fa5"
FIELDS = [("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32()), ("text", pa.string())]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence, without the white space around it."""
    at, n = LEAD.match(text).end(), len(text)
    for m in END.finditer(text):
        end = m.start() if text[m.start()] == "\n" else m.end()
        if end > at:
            yield at, _trimmed(text, at, end)
            at = LEAD.match(text, end).end()
    end = _trimmed(text, at, n)
    if end > at:
        yield at, end


def _trimmed(text: str, start: int, end: int) -> int:
    while end > start and text[end - 1] in " \t\n\v\f\r":
        end -= 1
    return end


class Plain:
    """Tokens by the pattern above."""

    def counts(self, parts: list[str]) -> list[int]:
        """The number of tokens of each part."""
        return [len(TOKEN.findall(p)) for p in parts]

    def spans(self, part: str) -> list[tuple[int, int]]:
        """(start, end) of the tokens of one part."""
        return [m.span() for m in TOKEN.finditer(part)]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ranked(about: dict) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file (as JSON) by bytes, if `tiktoken` makes the same tokens of it; else none.

    It does for byte-level BPE by its own pattern, without a normaliser, dropout, or texts cut or filled up, when each token has
    one merge, ids follow the order of merges, and each token's own bytes become that token: then no two tokens side by side
    that make up a third can be anything but the two of its merge.
    """
    from tokenizers import Tokenizer, models

    pre, model, added = about.get("pre_tokenizer") or {}, about.get("model") or {}, about.get("added_tokens") or ()
    if any(about.get(k) for k in ("normalizer", "truncation", "padding")) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True):
        return None
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    special = {t["content"] for t in added}
    names = {k: v for k, v in model["vocab"].items() if k not in special}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [names.get("".join(m), -1) for m in merges]
    letters = {k: v for k, v in names.items() if len(k) == 1}
    if len(letters) != 256 or len(made) != len(set(made)) or made != sorted(made) or len(names) != 256 + len(made) or min(made, default=256) <= max(letters.values()):
        return None
    alone = Tokenizer(models.BPE(vocab=names, merges=merges))
    if any(len(e) != 1 for e in alone.encode_batch_fast(list(names), add_special_tokens=False)):
        return None
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printed)}
    return {bytes(of[c] for c in k): v for k, v in names.items()} if of.keys() == letters.keys() else None


class Vocabulary:
    """Tokens by a tokenizer file, which must be at that path on every executor.

    Counts are made by `tiktoken` where it makes the same tokens (see `ranked`), and by the file's own library for other files
    and for parts with an added token or with letters on which the two libraries' tables of letters may differ.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = _tokenizer(path)
        about = json.loads(self.tokenizer.to_str())
        ranks = ranked(about)
        self.quick = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.odd = re.compile("|".join([f"[^{SETTLED}]", *(re.escape(t["content"]) for t in about.get("added_tokens") or ())]))

    def counts(self, parts: list[str]) -> list[int]:
        slow = [i for i, p in enumerate(parts) if self.quick is None or self.odd.search(p)]
        found = self.tokenizer.encode_batch_fast([parts[i] for i in slow], add_special_tokens=False) if slow else []
        known = {i: len(e) for i, e in zip(slow, found)}
        return [known[i] if i in known else len(self.quick.encode_ordinary(p)) for i, p in enumerate(parts)]

    def spans(self, part: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(part, add_special_tokens=False).offsets


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """One for each file and worker."""
    return Vocabulary(path)


def units(text: str, spans: list[tuple[int, int]], sizes: list[int], budget: int, tokens: Plain | Vocabulary) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and token counts of sentences; one over the budget becomes pieces of budget tokens."""
    starts, ends, counts = [], [], []
    for (a, z), n in zip(spans, sizes):
        if n <= budget:
            starts.append(a), ends.append(z), counts.append(n)
            continue
        found = tokens.spans(text[a:z])
        for i in range(0, n, budget):
            last = min(i + budget, n) - 1
            starts.append(a + found[i][0]), ends.append(z if last == n - 1 else a + found[last][1]), counts.append(last - i + 1)
    return starts, ends, counts


def windows(counts: list[int], budget: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(first, behind the last) unit of each window; counts up to any unit are looked up in their running sum."""
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    i, n = 0, len(counts)
    while i < n:
        j = max(bisect_right(total, total[i] + budget, i + 1) - 1, i + 1)
        yield i, j
        if j == n:
            return
        # the earliest unit from which what is taken again fits the overlap, and the next one with it the budget
        i = max(bisect_left(total, total[j] - overlap, i + 1, j), bisect_left(total, total[j + 1] - budget, i + 1, j))


def laid(texts: list[str | None], budget: int, overlap: int, tokens: Plain | Vocabulary) -> Iterator[list[tuple[int, int, int]]]:
    """(start, end, tokens) of the chunks of each text; the sentences of all texts are counted together."""
    spans = [list(sentences(t)) if t else [] for t in texts]
    sizes = iter(tokens.counts([t[a:z] for t, some in zip(texts, spans) for a, z in some]))
    for t, some in zip(texts, spans):
        starts, ends, counts = units(t or "", some, list(islice(sizes, len(some))), budget, tokens)
        yield [(starts[i], ends[j - 1], sum(counts[i:j])) for i, j in windows(counts, budget, overlap)]


def chunks_of(text: str | None, budget: int, overlap: int, tokens: Plain | Vocabulary = Plain()) -> list[dict]:
    (found,) = laid([text], budget, overlap, tokens)
    return [{"ord": k, "start": a, "end": z, "tokens": n, "text": text[a:z]} for k, (a, z, n) in enumerate(found)]


def _as_lists(texts: list[str | None], found: list[list[tuple[int, int, int]]]) -> pa.Array:
    """The chunks of each text as one list array, without an object for each."""
    offsets = [0]
    for some in found:
        offsets.append(offsets[-1] + len(some))
    rows = [c for some in found for c in some]
    columns = [[k for some in found for k in range(len(some))], *([c[i] for c in rows] for i in range(3)), [t[a:z] for t, some in zip(texts, found) for a, z, _ in some]]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS)], [n for n, _ in FIELDS]))


def cut_batches(batches: Iterator[pa.Array], budget: int, overlap: int, vocabulary: str | None = None) -> Iterator[pa.Array]:
    tokens = vocabulary_of(vocabulary) if vocabulary else Plain()
    for col in batches:
        for texts in text_slices(col, SLICE_BYTES):
            yield _as_lists(texts, list(laid(texts, budget, overlap, tokens)))


def sentence_chunks(text: Column, budget: int = 1024, overlap: int = 200, vocabulary: str | None = None) -> Column:
    """Array of (ord, start, end, tokens, text). vocabulary: a tokenizer file by which tokens are counted.

    A task holds the chunks of one slice of the texts at a time, whatever Arrow's batches are.
    """
    if budget < 1 or overlap < 0:
        raise ValueError("a chunk takes at least one token, and overlaps are not negative")
    kinds = {"ord": Ty.IntegerType(), "start": Ty.IntegerType(), "end": Ty.IntegerType(), "tokens": Ty.IntegerType(), "text": Ty.StringType()}

    @F.arrow_udf(Ty.ArrayType(Ty.StructType([Ty.StructField(n, k) for n, k in kinds.items()])))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from cut_batches(batches, budget, overlap, vocabulary)
        finally:
            give_back()

    return cut(text)
