"""Sentence chunks against a plain greedy loop, and embedding in batches against a provider that fails."""

import json
import random
import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import sentences as S
from skein.operators import embedding as E

SPACE = " \t\n\v\f\r"


def plain(text, budget, overlap):
    """The same chunks, letter by letter and window by window."""
    toks, i = [], 0
    while i < len(text):
        if text[i] in SPACE:
            i += 1
        elif re.match(r"\w", text[i]):
            j = i
            while j < len(text) and re.match(r"\w", text[j]):
                j += 1
            toks.append((i, j))
            i = j
        else:
            toks.append((i, i + 1))
            i += 1
    units = []
    for k, (a, z) in enumerate(toks):
        new = k == 0
        if k:
            gap = text[toks[k - 1][1] : a]
            h = k - 1
            while h > 0 and text[toks[h][0]] in S.CLOSERS and toks[h][0] == toks[h - 1][1]:
                h -= 1
            new = bool(gap) and (text[toks[h][0]] in S.STOPS or re.search(r"\n[ \t\r]*\n", gap) is not None)
        if new:
            units.append([])
        units[-1].append((a, z))
    units = [u[i : i + budget] for u in units for i in range(0, len(u), budget)]
    out, i = [], 0
    size = lambda a, b: sum(map(len, units[a:b]))
    while i < len(units):
        j = i + 1
        while j < len(units) and size(i, j + 1) <= budget:
            j += 1
        out.append((units[i][0][0], units[j - 1][-1][1], size(i, j)))
        if j == len(units):
            break
        i += 1
        while i < j and (size(i, j) > overlap or size(i, j + 1) > budget):
            i += 1
    return [{"ord": k, "start": a, "end": z, "tokens": n, "text": text[a:z]} for k, (a, z, n) in enumerate(out)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1é.!?。\"')] \n\t,-", max_size=120), st.integers(1, 9), st.integers(0, 9))
def test_chunks_equal_a_plain_loop(text, budget, overlap):
    assert S.chunks_of(text, budget, overlap) == plain(text, budget, overlap)


def test_sentences_stay_whole_and_tokens_are_all_there():
    rng = random.Random(3)
    text = " ".join(" ".join("w" * rng.randint(1, 7) for _ in range(rng.randint(1, 30))) + rng.choice([".", "!", '?"', ".)"]) + rng.choice(["", "\n\n"]) for _ in range(300))
    spans = list(S.sentences(text))
    got = S.chunks_of(text, 64, 16)
    assert len(spans) == 300 and {c["start"] for c in got} <= {a for a, _ in spans} and {c["end"] for c in got} <= {z for _, z in spans}
    assert all(c["tokens"] <= 64 for c in got) and got[0]["start"] == 0 and got[-1]["end"] == len(text)
    assert all(not text[a["end"] : b["start"]].strip() for a, b in zip(got, got[1:]))  # nothing is left between two windows
    long = S.chunks_of("x " * 100 + "end.", 30, 10)
    assert [c["tokens"] for c in long] == [30, 30, 30, 12] and S.chunks_of(None, 5, 1) == S.chunks_of(" \n", 5, 1) == []


def test_chunks_in_a_table_and_by_a_vocabulary(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = spark.createDataFrame([(1, None), (2, ""), (3, "One two. Three four! Five"), (3, "One two. Three four! Five"), (4, "word " * 20_000)], "i int, text string")
    got = df.select("i", F.explode(S.sentence_chunks(F.col("text"), 6, 3)).alias("c")).select("i", "c.*").orderBy("i", "ord").collect()
    assert [(r.i, r.text) for r in got if r.i == 3] == [(3, "One two. Three four!"), (3, "One two. Three four!"), (3, "Three four! Five"), (3, "Three four! Five")]
    assert len([r for r in got if r.i == 4]) == 3334
    with pytest.raises(ValueError):
        S.sentence_chunks(F.col("text"), 0)
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tok = Tokenizer.from_file(path)
    for r in docs.select("text", F.explode(S.sentence_chunks(F.col("text"), 128, 20, path)).alias("c")).limit(300).collect():
        assert r.c.tokens <= 128 and r.c.text == r.text[r.c.start : r.c.end] and abs(len(tok.encode(r.c.text, add_special_tokens=False).ids) - r.c.tokens) <= 20


class Flaky:
    """Fails on texts with 'bad', asks to wait now and then, returns a wrong width for 'wide'; tells on files how it was called."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, texts):
        import os
        import uuid

        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        if len(os.listdir(self.folder)) == 1:
            raise RuntimeError("429: too many requests")
        if any("bad" in t for t in texts):
            raise ValueError("cannot embed")
        return [[1.0] * 5 if "wide" in t else None if "none" in t else [float(len(t)), 0.5, 1.0] for t in texts]


def test_batches_retries_and_isolated_failures(spark, tmp_path):
    texts = [f"text {i}" for i in range(120)] * 3 + ["bad one", "another bad", "wide", "none", None, "", " \n\t"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, text string, _text string").repartition(7)
    got = {r.i: r for r in E.embedded(df, "text", Flaky(str(tmp_path)), batch=10, pause=0.01).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts[:360]):
        assert got[i].vector == [len(t), 0.5, 1.0] and got[i].error is None
    assert [(got[360 + i].vector, got[360 + i].error) for i in range(7)] == [(None, "cannot embed")] * 2 + [(None, "width 5"), (None, "no vector")] + [(None, "empty")] * 3
    calls = [f.read_text().split("\n") for f in tmp_path.iterdir()]
    assert max(map(len, calls)) <= 10 and len(calls) < 60
    good = [t for c in calls if not any("bad" in t for t in c) for t in c]
    assert all(good.count(t) <= 2 for t in set(good))  # once, and again where the first call was refused
    assert E.embedded(df.limit(0), "text", E.HashedWords()).count() == 0


def test_a_provider_that_always_refuses_ends():
    def never(texts):
        raise RuntimeError("rate limit")

    assert E.called(never, ["a", "b"], pause=0.001) == [(None, "rate limit")] * 2


def test_queries_and_chunks_meet(spark):
    """A chunk's own text, embedded as a query, finds it first."""
    from skein.operators.knn import knn

    docs = spark.createDataFrame([(i, f"word{i} and word{i * 7 % 50} with common words") for i in range(50)], "doc_id long, text string")
    chunks = E.embedded(docs, "text", E.HashedWords(256))
    queries = E.embedded(docs.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "q"), "text", E.HashedWords(256))
    found = knn(chunks, queries, 1).collect()
    assert len(found) == 5 and all(r.score == 1.0 for r in found)


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", " \n", "\n\n", "\t", "\u00a0", "\x1c", "a", "word", "été", "中文", "𑨀ₐ", "¾", "'s", "...", ".", "…", '"', "<|endoftext|>", "12", "😀"]


@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_counts_by_a_vocabulary_are_the_files_own(text):
    v = S.vocabulary_of(VOCABULARY)
    assert v.quick is not None
    want = S._tokenizer(VOCABULARY).encode(text, add_special_tokens=False)
    assert v.counts([text, "", text]) == [len(want.ids), 0, len(want.ids)] and v.spans(text) == want.offsets
    for c in S.chunks_of(text, 5, 2, v):
        assert c["tokens"] <= 5 and c["text"] == text[c["start"] : c["end"]]


def test_other_tokenizer_files_count_by_themselves(tmp_path):
    from tokenizers import Tokenizer

    about = json.loads(Tokenizer.from_file(VOCABULARY).to_str())
    assert S.ranked(about) is not None
    texts = ["Hello there,  you", "a", ""]
    merges = about["model"]["merges"]
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**about["model"], "merges": [merges[1], merges[0], *merges[2:]]}}, {"model": {**about["model"], "merges": merges[:-1]}}):
        other = about | change
        assert S.ranked(other) is None
        path = str(tmp_path / "other.json")
        with open(path, "w") as f:
            json.dump(other, f)
        S._tokenizer.cache_clear()
        v = S.Vocabulary(path)
        assert v.quick is None and v.counts(texts) == [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    S._tokenizer.cache_clear()


def test_a_task_holds_one_slice_of_texts_and_one_call():
    """What the functions hold grows with neither the rows nor the bytes of Arrow's batches."""
    import tracemalloc

    import pyarrow as pa

    from skein.functions.workers import text_slices

    assert [len(x) for x in text_slices(pa.array(["ab", None, "", "abcd", "a"]), 4)] == [3, 1, 1] and list(text_slices(pa.array([], pa.string()), 4)) == []

    def peak(n):
        col = pa.array(["Some words of a sentence. " * 40] * n)
        cut = S.cut_batches(iter([col]), 16, 4)
        tracemalloc.start()
        rows = sum(len(x) for x in cut)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return top

    peak(10)
    assert peak(6000) < 1.5 * peak(1500)
