"""Operators of skein.llm against brute force, on small tables with nulls, empty and very long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import exact_dedup, html_text, langid, mixing, ngram_join, packing, pii, quality, queries, shingles, telephony, token_counts
from skein.llm.tokens import WordEncoder

from .. import oracle

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "word " * 3000), (5, "  two  spaces\n\n and\tmore "), (6, "é" * 50), (7, "x" * 9000), (None, "no id")]
CLASH = "doc_id long, text string, digest string, t string, h string, rep long, kept boolean"


def table(spark, rows, extra=True):
    return spark.createDataFrame([(*r, "d", "t", "h", 1, True) for r in rows], CLASH) if extra else spark.createDataFrame(rows, "doc_id long, text string")


# ---- 1 packing


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_equals_the_tokenizer(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [t or "" for _, t in ODD] + [" lead", "trail ", "a  b", "a \n b", "a\n b", "tab\t x", "  nb sp ", "it's we'll", "<|endoftext|> x", "a <|endoftext|> b", "x  <|endoftext|>", "a<|endoftext|>b\n<|endoftext|>", "1 2 33 a1", "   ", "a　 b"]
    e = WordEncoder()
    for t, want in zip(texts, reference_ids(texts)):
        for _ in range(2):  # from the memo, too
            assert np.frombuffer(e.encode(t), "<u4").tolist() == want


def test_a_text_of_rare_words_is_one_call(monkeypatch):
    import tiktoken

    calls = []
    for name in ("encode", "encode_to_numpy"):
        monkeypatch.setattr(tiktoken.Encoding, name, lambda self, text, *a, real=getattr(tiktoken.Encoding, name), **k: (calls.append(text), real(self, text, *a, **k))[1])
    text = " ".join(f"w{i}'s" for i in range(1000))
    (want,) = reference_ids([text])
    assert np.frombuffer(WordEncoder().encode(text), "<u4").tolist() == want and len(calls) == 1


def test_ids_with_much_white_space():
    white = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2028\u202f\u205f\u3000\x1c\x1f\u200b"
    rng = np.random.default_rng(5)
    parts = [*white, *white, "a", "é", "7", "!", "'s", "'ll", "'", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, size=n % 30)) for n in range(5000)]
    for marker in (True, False):
        e = WordEncoder(marker=marker)
        for t, want in zip(texts, reference_ids(texts)):
            if marker or "<|endoftext|>" not in t:
                assert np.frombuffer(e.encode(t), "<u4").tolist() == want
            by_parts = [e.cut.encode_to_numpy(p, allowed_special="all") for p in e.joints.split(t)]
            assert b"".join(x.tobytes() for x in by_parts) == e.encode(t)
    for text in (" " * 1_100_000 + "a", "a" + "\n" * 1_100_000 + "<|endoftext|> b"):
        assert np.frombuffer(WordEncoder().encode(text), "<u4").tolist() == reference_ids([text])[0]


def test_packing(spark):
    rows = ODD + [(100 + i, "some words here " * (i % 90)) for i in range(300)] + [(990, "<|endoftext|> hi <|endoftext|>")]
    got = packing.pack(table(spark, rows)).collect()
    ids = {}
    for (d, _), x in zip(rows, reference_ids([t or "" for _, t in rows])):
        ids.setdefault(d, []).append(x + [2])
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    by_seq = defaultdict(list)
    for r in got:
        x = ids[r.doc_id][0]
        assert zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(by_seq) <= 1.05 * sum(r.length for r in got) / 1024 + 5
    assert packing.pack(table(spark, [])).count() == 0


def test_packing_strictly_online_is_best_fit(spark):
    rows = [(i, "word " * (i * 37 % 700)) for i in range(200)]
    got = packing.pack(table(spark, rows), block_pieces=1, open_bins=4).coalesce(1).orderBy("doc_id", "piece").collect()
    by_bin = defaultdict(list)
    for r in got:
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for o, n in v if o < at) == at for v in by_bin.values() for at, _ in v) and max(sum(n for _, n in v) for v in by_bin.values()) <= 1024


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    f = packing.BestFit(10, 2)
    assert [f.put(n) for n in (6, 5, 4)] == [(0, 0), (1, 0), (0, 6)]
    assert f.put(9) == (2, 0)  # open: bin 1 (5 free), bin 2 (1 free)
    assert f.put(7) == (3, 0)  # one too many: bin 2 closes
    assert f.put(1) == (3, 7) and f.put(5) == (1, 5)


# ---- 2 languages


def test_language_identification(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = langid.op2_langid(spark, d).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    m = langid.fit(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30)
    rows = [r for r in ODD if r[0] is not None] + [(9, "123 !?"), (10, "the dog and the cat"), (11, "und die katze")]
    got = {r.doc_id: r for r in langid.identify(table(spark, rows), m).collect()}
    assert [got[i].lang_pred for i in (1, 2, 9, 10, 11)] == ["und", "und", "und", "en", "de"]
    assert {r.lang_pred for r in langid.identify(table(spark, rows), langid.fit([], [])).collect()} == {"und"}
    assert langid.identify(table(spark, []), m).count() == 0


def test_labels_of_long_texts_and_many_languages_are_learned(spark):
    rows = [(i, "der hund und die katze " * 2000, "de") for i in range(40)] + [(100 + i, "the cat and the dog " * (i % 9 + 1), "en") for i in range(60)] + [(None, "the cat", "en"), (7, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit_counted(*langid.sample(docs))
    assert m.langs == ["de", "en"]
    got = langid.identify(docs, m).collect()
    assert all(r.lang_pred == lang for r, (_, t, lang) in zip(sorted(got, key=lambda r: r.doc_id or -1), sorted(rows, key=lambda r: r[0] or -1)) if t) and [r.held_out for r in got if r.doc_id is None] == [False]
    many = spark.createDataFrame([(i, "some text", f"l{i % 50}") for i in range(400)], "doc_id long, text string, lang string")
    assert 50 >= len(langid.sample(many, total=50)[1]) >= 45


def test_scores_equal_a_plain_sum(spark):
    texts = ["the cat and the dog", "der hund und die katze", "The CAT!", "x", "été là-bas", "ab  cd"]
    m = langid.fit(texts[:2] * 30, ["en", "de"] * 30)

    def plain(text):  # one subword after the other
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        fold = lambda c: c if 97 <= c <= 122 or c >= 128 else 32
        b, total, n = [fold(c) for c in b], np.zeros(len(m.langs)), 0
        for k in langid.ORDERS:
            for i in range(len(b) - k + 1):
                if 32 in b[i + 1 : i + k - 1]:
                    continue
                h = 0
                for c in b[i : i + k]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                h ^= h >> 15
                h = ((h * 0x85EBCA6B) & 0xFFFFFFFF) >> 18
                total, n = total + m.weights[h or 1], n + 1
        z = (total / max(1, n) + m.bias) / m.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    for r in langid.identify(table(spark, list(enumerate(texts))), m).collect():
        p = plain(texts[r.doc_id])
        assert r.lang_pred == m.langs[int(p.argmax())] and abs(r.score - p.max()) < 1e-4


def test_long_text_is_read_whole(monkeypatch):
    m = langid.fit(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30)
    data = np.frombuffer(("the cat " * 500 + "der hund " * 700).encode(), "uint8")
    whole = m.logits(data, np.array([0, len(data)]))
    monkeypatch.setattr(langid, "PIECE", 997)
    assert np.allclose(m.logits(data, np.array([0, len(data)])), whole)
    ids, share = langid.counted(data.tobytes())
    monkeypatch.undo()
    want = langid.counted(data.tobytes())
    assert np.array_equal(ids, want[0]) and np.allclose(share, want[1])


# ---- 3 personal data

PATTERNS = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}
TEXTS = [
    "mail a.b@c.de, x@@y.z @q@r.s.t a@b a@b.c@d.e ..@x.y", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 0000000255.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111", "tel +1 (767) 555-5699 ext, +49 30 123456 +1 2", "+12 345 678 901 4111111111111111", "", "12.34.5x 1..2.3.4.5 .9.8.7.6. 1.2.3.4x a1.2.3.4"]


def brute(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p.pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = name == "email" or (name == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (name == "card" and 13 <= len(d) <= 19 and pii.luhn(d)) or (name == "phone" and 9 <= len(d) <= 15)
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_patterns(spark, sf_dir):
    for t in TEXTS + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]:
        assert pii.base_spans(t) == brute(t)


def test_long_runs_are_read_once():
    m = pii.fit_counts([(pii.shape("+1 (767) 555-5699"), 3, pii.ABSENT, pii.ABSENT, 5), (pii.shape("word"), pii.NONE, pii.ABSENT, pii.ABSENT, 5)])
    for t in ("1" * 300_000 + "x", "y" * 300_000 + " 1", "1 " * 100_000 + "1x", "@" * 100_000, "a@" * 50_000, "+1(" * 50_000):
        pii.find(t, m)


def test_the_field_marks_values_that_return(spark):
    m = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    text = "Call +1 (767) 555-5699 today. Once more: (767) 555-5699 is the number. Room 12 holds 30 people."
    base, added = pii.find(text, m)
    assert [text[s:e] for _, s, e in base] == ["+1 (767) 555-5699"]
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in added] == [("phone", "(767) 555-5699")]
    assert pii.find("Room 12 holds 30 people in 2024.", m) == ([], [])
    got = pii.personal_data(table(spark, ODD), m).collect()
    assert len(got) == len(ODD) and all(r.spans == "" for r in got if r.doc_id in (1, 2, 3))
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_value_that_returns_fifty_times_is_marked_each_time(spark):
    m = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    base, later = "Call +1 (767) 555-5699 now.", " Then again {} is what they all said to us on that long day."
    for v in ("(767) 555-5699", "767 555 5699", "767-555-5699"):
        for text in (base + later.format(v) * 50, later.format(v) * 50 + " " + base, later.format(v) * 25 + " " + base + later.format(v) * 25):
            found, added = pii.find(text, m)
            assert len(found) == 1 and [(pii.KINDS[k], text[s:e]) for k, s, e in added] == [("phone", v)] * 50


def exact_marginals(field, text, found):
    """By enumeration of all labellings."""
    from itertools import product

    chain, skip, _ = pii.edges(text, found)
    own = pii.expanded(np.array([pii.shape(text[s:e]) for s, e, _ in found])) @ field.unary
    out = np.zeros(own.shape)
    for y in product(range(pii.NONE + 1), repeat=len(found)):
        if all(k < 0 or y[i] == k for i, (_, _, k) in enumerate(found)):
            z = sum(own[i, c] for i, c in enumerate(y)) + sum(field.chain[y[i], y[j]] for i, j in chain) + sum((field.skip if max(found[i][2], found[j][2]) >= 0 else field.echo)[y[i], y[j]] for i, j in skip)
            for i, c in enumerate(y):
                out[i, c] += np.exp(z)
    return out / out.sum(axis=1, keepdims=True)


def random_field(rng, size=1.0):
    sym = rng.normal(0, size, (5, 5))
    return pii.Field(rng.normal(0, size, (pii.FEATURES, 5)), rng.normal(0, size, (5, 5)), (sym + sym.T) / 2, pii.balanced(sym + sym.T))


def test_marginals_equal_enumeration(monkeypatch):
    rng = np.random.default_rng(3)
    far = "-" * 50 + " "
    trees = ["5551234567 " + far + "5551234567", "a.b@c.de now", "x1 y2 z3 w4", "5551234567 a1 " + far + "b2 5551234567"]
    loops = ["5551234567 a1 5551234567 b2", "a.b@c.de x1 a.b " + far + "a.b@c.de a.b"]
    for text in trees + loops:
        found = pii.nodes(text, pii.base_spans(text))
        assert 1 < len(found) < 8
        for size in (0.5, 1.5) if text in trees else (0.4,):
            f = random_field(rng, size)
            assert np.abs(f.labels(text, found) - exact_marginals(f, text, found)).max() < (0.005 if text in trees else 0.05)


def test_parts_are_settled_one_after_the_other(monkeypatch):
    f = random_field(np.random.default_rng(4))
    text = " ".join(f"{i}-{i * 7919 % 10_000_000:07d}" + " words that part them, far enough from each other for no chain" * (i % 3 == 0) for i in range(60)) + " 3-0023757" * 3
    found = pii.nodes(text, pii.base_spans(text))
    whole = f.labels(text, found)
    for n in (1, 7, 30):
        monkeypatch.setattr(pii, "PART_NODES", n)
        assert np.abs(f.labels(text, found) - whole).max() < 0.01


def test_the_field_is_learned_and_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    m = pii.fit(docs)
    assert all(m.skip[k, k] - m.skip[k, pii.NONE] > 5 for k in range(pii.NONE)) and np.allclose(np.exp(m.echo).sum(axis=1), 1, atol=1e-3)  # nobody set these
    assert pii.find("5927243074273351 is no card " + "for sure, 5927243074273351 is a number, " * 4, m) == ([], [])
    lost = "4845168114407329 4845168114407329"  # one run of 32 digits to the pattern
    assert pii.base_spans(lost) == [] and pii.find(lost, m)[1] == [(2, 0, 16), (2, 17, 33)]
    assert pii.find("mail jane.doe@x.org or just Jane.Doe now", m)[1] == [(0, 28, 36)]
    assert sum(r.n_added for r in pii.op3_pii(spark, "/root/testdata/sf0.01").collect()) > 0
    assert pii.fit(docs.where("text LIKE 'no such text'")) is None
    twice = pii.fit(docs.union(docs))  # counts of all rows, in any order
    assert np.allclose(twice.skip, m.skip) and np.allclose(twice.unary, m.unary)


# ---- 4 mixing


def test_rates_meet_their_targets(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    out = mixing.mixed(docs, mixing.label_domains(spark.read.parquet(f"{d}/labels.parquet"))).collect()
    total = sum(r.n_tokens for r in out)
    assert len(out) == docs.count() and all(r.rate >= 0 for r in out)
    for dom, share in mixing.TARGETS.items():
        assert abs(sum(r.n_tokens * r.rate * r.posterior[dom] for r in out) / total - share) < 0.01


def test_mixing_odd_tables(spark):
    labels = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (3, "a")], "doc_id long, domain string")
    out = mixing.mixed(table(spark, ODD), labels, {"a": 0.5, "b": 0.5}).collect()
    assert len(out) == len(ODD) and {r.domain for r in out} == {"a"}
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r.rate for r in mixing.mixed(table(spark, ODD), none).collect()} == {1.0}
    assert mixing.mixed(table(spark, []), labels).count() == 0
    same = mixing.mix(table(spark, ODD), labels, {"a": 1.0}, {"a": 1.0}, keep="a")
    assert same.columns == table(spark, ODD).columns and same.count() == len(ODD)


def test_words_are_split_at_all_white_space(spark):
    texts = ["a\nb", "a\tb c\r\nd", "\n \t\v\f", "one\x0btwo\x0cthree", "à\xa0la\u2009carte\u3000x\u2028y\x85z", "row\tof\tcells\n" * 500, None, "plain words"]
    model = mixing.Classifier(["all"], [0] * mixing.BUCKETS, [[]], [0.0])
    got = {r.doc_id: r.n_tokens for r in mixing.with_posteriors(table(spark, list(enumerate(texts))), model).collect()}
    assert got == {i: len((t or "").split()) for i, t in enumerate(texts)}
    docs = table(spark, [(i, f"fine\n{'slur' if i % 2 else 'rose'}\nwords here") for i in range(400)])
    labels = spark.createDataFrame([(i, "toxic" if i % 2 else "clean") for i in range(200)], "doc_id long, domain string")
    out = mixing.mixed(docs, labels, {"clean": 0.5, "toxic": 0.5}).collect()
    assert {r.n_tokens for r in out} == {4} and all(r.domain == ("toxic" if r.doc_id % 2 else "clean") and max(r.posterior.values()) > 0.9 for r in out)
    model = mixing.fit_classifier(docs, labels)
    other = mixing.with_posteriors(table(spark, [(1, "quite\nslur\tother"), (2, "slur other")]), model).collect()
    assert {model.domains[r.domain - 1] for r in other} == {"toxic"} and all(max(r.p) > 0.9 for r in other)


def plain_posterior(model, text):
    """Of one text, word by word."""
    import xxhash

    words = (text or "").lower().split()
    scale = lambda k, x: f"\x01{k}{int(x / max(1, len(words)) * 8)}"
    marked = [*words, scale("s", sum(w[-1] in "&%$#*!|=<>~^" for w in words)), scale("d", len(set(words)))]
    hit = {model.slots[xxhash.xxh64(w.rstrip(".,;:!?)\"").encode(), seed=42).intdigest() & (mixing.BUCKETS - 1)] for w in marked} - {0}
    z = np.array([b + sum(w[s - 1] for s in hit) for w, b in zip(model.weights, model.bias)])
    e = np.exp(np.maximum(z - z.max(), -60))
    return len(words), e / e.sum()


def test_posteriors_and_rates_equal_plain_versions(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = mixing.label_domains(spark.read.parquet(f"{d}/labels.parquet"))
    model = mixing.fit_classifier(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    post = mixing.with_posteriors(docs, model)
    rows = post.collect()
    for r in rows:
        n, p = plain_posterior(model, texts[r.doc_id])
        assert r.n_tokens == n and np.allclose(r.p, p, atol=1e-9)
    # the steps, made again over all rows at once, and the optimum's conditions: a rate above 0 has no gradient left
    rates = mixing.fit_rates(post, model.domains, mixing.TARGETS)
    p, n, r = np.array([x.p for x in rows]), np.array([x.n_tokens for x in rows]), np.ones(len(rows))
    for e in rates.steps:
        r = np.maximum(r - p @ np.array(e), 0)
    got = {x.doc_id: x.r for x in post.withColumn("r", rates.column(F.col("p"))).collect()}
    assert np.allclose([got[x.doc_id] for x in rows], r)
    goal = n.sum() * np.array([mixing.TARGETS[d] for d in model.domains])
    assert np.abs(p.T @ (n * r) - goal).max() < 0.002 * n.sum() and not rates.unmet


def test_rates_lift_a_rare_domain_to_its_target(spark):
    names, targets = ["clean", "low", "toxic"], {"clean": 0.90, "low": 0.07, "toxic": 0.03}
    rows = [(i, 100, [0.0005, 0.0005, 0.999] if i == 7 else [0.01, 0.9895, 0.0005] if i % 9 == 0 else [0.9989, 0.001, 0.0001], 1) for i in range(2000)]  # toxic: one in 2000
    post = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>, domain int")
    rates = mixing.fit_rates(post, names, targets)
    out = post.withColumn("r", rates.column(F.col("p"))).collect()
    for d, name in enumerate(names):
        assert abs(sum(r.n_tokens * r.p[d] * r.r for r in out) / 200_000 - targets[name]) < 0.001
    assert not rates.unmet and min(r.r for r in out) >= 0
    none = spark.createDataFrame([(i, 10, [1.0, 0.0], 1) for i in range(20)], "doc_id long, n_tokens long, p array<double>, domain int")
    assert mixing.fit_rates(none, ["clean", "toxic"], {"clean": 0.5, "toxic": 0.5}).unmet["toxic"] == (0.0, 0.5)


# ---- 5 n-gram join


def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def families(seed=5, n=12, copies=15):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab, 40))
    rows, d = [], 0
    for f in range(n):
        base = list(rng.choice(vocab, rng.integers(5, 200)))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.integers(0, 6)):
                words[rng.integers(len(words))] = str(rng.choice(vocab))
            base = words if rng.random() < 0.3 else base
            rows.append((d, " ".join(words).title() if d % 2 else " ".join(words) + (" " + passage if d % 5 == 0 else "")))
            d += 1
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three"), (906, rows[0][1])]


@pytest.mark.parametrize("chunk", [1024, 8])
def test_components_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 10**9)  # no order by frequency: groups grow large
    rows = families()
    for k, percent in ((4, 85), (5, 80)) if chunk > 8 else ((4, 85),):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table(spark, rows), k=k, percent=percent).collect()}
        assert got == brute_components(rows, k, percent)


def test_join_of_odd_tables(spark):
    got = ngram_join.jaccard_components(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id == 3} == {3}
    assert ngram_join.jaccard_components(table(spark, [])).count() == 0


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(2)
    sets = [set(rng.choice(3000, rng.integers(20, 120), replace=False).tolist()) for _ in range(60)]
    sets += [set(list(s)[2:]) | {5000 + i} for i, s in enumerate(sets)] * 10
    points = np.stack([np.bincount([x % ngram_join.GROUPS for x in s], minlength=ngram_join.GROUPS) for s in sets]).astype("uint8")
    sizes = np.array([len(s) for s in sets])
    tree = ngram_join.CountTree(points, sizes, 85)
    assert len(tree.levels) > 2
    for i in range(0, len(sets), 7):
        near = set(tree.near(points[i], len(sets[i])).tolist())
        assert {j for j, s in enumerate(sets) if 100 * len(s & sets[i]) >= 85 * len(s | sets[i])} <= near


def test_search_of_vectors_of_several_lengths_loses_no_pair(monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIR_CELLS", 4096)
    rng = np.random.default_rng(8)
    sets = [rng.choice(1 << 40, n, replace=False).astype("uint64") for n in (5, 900, 1020, 1030, 1100, 2040, 2060, 4000, 4200, 9000) for _ in range(4)]
    sets += [np.concatenate((s[len(s) // 20 :], rng.choice(1 << 40, len(s) // 30).astype("uint64"))) for s in sets for _ in range(3)]
    vectors, sizes = [ngram_join.packed(ngram_join.counted(s)) for s in sets], np.array([len(s) for s in sets])
    assert len({len(ngram_join.unpacked(v)) for v in vectors}) > 3
    half = np.arange(len(sets)) % 2 == 0
    for left, right in ((np.arange(len(sets)),) * 2, (np.flatnonzero(half), np.flatnonzero(~half))):
        found = {(x, y) for i, j in ngram_join.near_pairs(vectors, sizes, np.arange(len(sets)), left, right, 80) for x, y in zip(i.tolist(), j.tolist())}
        held = [set(s.tolist()) for s in sets]
        want = {(i, j) for i in left.tolist() for j in right.tolist() if i != j and 100 * len(held[i] & held[j]) >= 80 * len(held[i] | held[j])}
        assert want and want <= found and len(found) < len(left) * len(right) / 4


def test_the_tree_decides_which_pairs_of_a_group_are_verified(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_LEAST", 10**9)
    base = [f"w{i}" for i in range(100)]  # 0 to 7 hold the text of 8 and 9 and more, link with neither, and are first in each of their groups
    rows = [(d, " ".join(base + [f"{d}x{i}" for i in range(30)])) for d in range(8)] + [(8, " ".join(base)), (9, " ".join(base[:99]))]
    want = brute_components(rows, 4, 85)
    get = lambda: {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table(spark, rows), k=4, percent=85).collect()}
    assert get() == want
    monkeypatch.setattr(ngram_join, "search_cells", lambda cells, percent: cells.selectExpr("node AS a", "node AS b").where("false"))
    assert get() != want


@pytest.mark.parametrize("limit", [48 << 20, 0])
def test_ids_that_are_null_or_have_several_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", limit)
    a, b, c = ("red green blue white black grey pink brown " * 3 + x for x in ("one two three four five six", "one two three four five seven", "ten nine eight"))
    alone = "this text has nothing to do with any of the others in here"
    rows = [(5, a), (5, alone), (9, b), (None, b + " eight"), (None, alone), (None, "quite another text without an id at all"), (12, alone), (12, alone)]
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in ngram_join.jaccard_components(table(spark, rows), k=2, percent=70).collect())
    n = {t: len(set(zip(t.split(), t.split()[1:]))) for _, t in rows}
    assert got == sorted([(5, n[a], 5), (5, n[alone], 5), (9, n[b], 5), (0, n[b + " eight"], 5), (0, n[alone], 5), (0, n[rows[5][1]], 0), (12, n[alone], 5), (12, n[alone], 5)])


def test_words_cross_blocks(monkeypatch):
    import pyarrow as pa

    texts = ["Alpha beta  gamma", None, "", "x" * 50 + " y", "alpha\tBETA gamma delta"]
    col = pa.array(texts)
    want, bound = shingles.words(*shingles.text_buffers(col))
    monkeypatch.setattr(shingles, "BLOCK", 7)
    monkeypatch.setattr(shingles, "_POWERS", [])
    got, b2 = shingles.words(*shingles.text_buffers(col))
    assert got.tolist() == want.tolist() and bound.tolist() == b2.tolist() == [0, 3, 3, 3, 5, 9]
    assert want[0] == want[5] and want[1] == want[6]


# ---- 6 token counts


@pytest.mark.parametrize("block", [4, 64, 1 << 20])
def test_scan_of_flat_files(spark, tmp_path, block):
    files, want = [], {}
    rng = np.random.default_rng(block)
    for f, lengths in enumerate(([0, 5, 0, 0, 37, 1], [200], [], rng.integers(0, 40, 50).tolist())):
        for tail in (0, 9):
            ids = [x for n in lengths for x in [*([7] * n), 50_256]] + [7] * tail
            path = tmp_path / f"{f}-{tail}"
            path.write_bytes(np.array(ids, "<u2").tobytes())
            files.append((f"file://{path}", 2 * len(ids)))
            want[files[-1][0]] = lengths + [tail] * (tail > 0)
    got = defaultdict(dict)
    for r in token_counts.scan(spark.createDataFrame(files, "file string, bytes long"), block_bytes=block).collect():
        got[r.file][r.ordinal] = r.n_tokens
    assert {f: [v[i] for i in range(len(v))] for f, v in got.items()} == {f: v for f, v in want.items() if v}


def test_token_counts(spark):
    rows = [*ODD, (77, "a <|endoftext|> b")]  # the marker in a text is no end of a document
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(table(spark, rows), block_bytes=1000).collect())
    marked = len(np.frombuffer(WordEncoder(marker=False).encode("a <|endoftext|> b"), "<u4"))
    assert marked > 4 and got == sorted([(d is None, d or 0, len(x)) for (d, _), x in zip(ODD, reference_ids([t or "" for _, t in ODD]))] + [(False, 77, marked)])
    assert token_counts.token_counts(table(spark, [])).count() == 0


def test_wide_ids_do_not_wrap(spark, tmp_path):
    assert token_counts.id_width(None, 50_256) == 2 and token_counts.id_width(None, 70_000) == 4
    with pytest.raises(ValueError):
        token_counts.id_width(None, 13)
    rows = [(1, "two words"), (2, ""), (3, "word " * 50)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table(spark, rows), block_bytes=64, separator=70_000).collect()}
    assert got == {d: len(x) for (d, _), x in zip(rows, reference_ids([t for _, t in rows]))}
    ids = [5, 65_536 + 7, 5, 70_000, 9, 70_000]
    (tmp_path / "w").write_bytes(np.array(ids, "<u4").tobytes())
    f = spark.createDataFrame([(f"file://{tmp_path}/w", 4 * len(ids))], "file string, bytes long")
    assert sorted((r.ordinal, r.n_tokens) for r in token_counts.scan(f, 70_000, 8, width=4).collect()) == [(0, 3), (1, 1)]


# ---- 7 telephony


def scalar_adpcm(block):
    pred, i = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [pred]
    for b in block[4:]:
        for nib in (b & 15, b >> 4):
            step = int(telephony.STEPS[i])
            d = (step >> 3) + (step if nib & 4 else 0) + (step >> 1 if nib & 2 else 0) + (step >> 2 if nib & 1 else 0)
            pred = max(-32768, min(32767, pred - d if nib & 8 else pred + d))
            i = max(0, min(88, i + int(telephony.INDEX_STEPS[nib & 7])))
            out.append(pred)
    return out


def test_decoders():
    assert telephony.MU_LAW_PCM[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A_LAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    data = np.random.default_rng(1).integers(0, 256, 64 * 20, dtype="uint8")
    assert telephony.decode_adpcm(data).tolist() == [scalar_adpcm(data[i : i + 64].tobytes()) for i in range(0, len(data), 64)]
    assert telephony.resample(np.array([0, 10, -10], "<i2"), 8000, 16000).tolist() == [0, 5, 10, 0, -10, -10]


def test_media_round_trip(spark):
    for kind in (telephony.PCM, telephony.A_LAW, telephony.MU_LAW, telephony.IMA_ADPCM):
        data = bytes(range(256))
        k, rate, block, back = telephony.read_wave(telephony.wave_file(data, kind, 8000, 64 if kind == telephony.IMA_ADPCM else None))
        assert (k, rate, bytes(back)) == (kind, 8000, data)
    media = [telephony.wave_file(bytes(range(64)), telephony.MU_LAW, 8000), None]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in media], "m binary").select(telephony.decode_media(F.col("m"))).collect()]
    assert telephony.read_wave(got[0])[:2] == (telephony.PCM, 16_000) and got[1] is None
    with pytest.raises(ValueError):
        telephony.read_wave(media[0][:-1])


def test_text_audio(spark):
    got = telephony.text_audio(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        raw = (dict((d, t) for d, t in ODD)[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = telephony.wave_file(payload, telephony.MU_LAW, 8000)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        x = np.frombuffer(payload, "uint8")
        up = telephony.resample(telephony.MU_LAW_PCM[x], 8000, 16_000)
        s = telephony.Sound()
        s.feed(up)
        assert r.feature == f"pcm16000:{s.feature()};alaw:{zlib.crc32(telephony.A_LAW_PCM[x].tobytes()):08x};adpcm:{zlib.crc32(telephony.decode_adpcm(x).tobytes()):08x}"


@pytest.mark.parametrize("kind", [telephony.PCM, telephony.A_LAW, telephony.MU_LAW, telephony.IMA_ADPCM])
@pytest.mark.parametrize("to", [8000, 16_000, 11_025])
def test_stored_pieces_are_the_whole_sound(kind, to):
    data = np.random.default_rng(kind).integers(0, 256, 64 * 60, dtype="uint8").tobytes()
    media = telephony.wave_file(data, kind, 8000, 64 if kind == telephony.IMA_ADPCM else None)
    _, rate, block, back = telephony.read_wave(media)
    whole = telephony.resample(telephony.to_pcm(kind, block, np.frombuffer(back, "uint8")), rate, to)
    for samples in (1, 500, 1 << 20):
        parts = [telephony.read_wave(p) for p in telephony.stored_pcm(media, to, samples)]
        assert {p[:2] for p in parts} == {(telephony.PCM, to)} and b"".join(bytes(p[3]) for p in parts) == whole.tobytes()


def test_features_go_through_the_stored_pcm_and_each_decoder(monkeypatch):
    media = telephony.wave_file(bytes(range(256)), telephony.MU_LAW, 8000)
    payloads = [memoryview(bytes(range(n % 251)) + bytes(64 - n % 251 % 64)) for n in (0, 64, 130, 250, 1000)]
    digest = lambda: (telephony.feature(media, 16_000), telephony.adpcm_checks(payloads, 8000))
    whole = digest()
    assert whole[1] == [zlib.crc32(telephony.decode_adpcm(np.frombuffer(p, "uint8")).tobytes()) for p in payloads]
    for piece in (64, 128, 192):
        monkeypatch.setattr(telephony, "PIECE", piece)
        assert digest() == whole
    for name in ("MU_LAW_PCM", "A_LAW_PCM", "ADPCM_DIFF"):
        with monkeypatch.context() as m:
            m.setattr(telephony, name, getattr(telephony, name)[::-1].copy())
            assert digest() != whole
    with monkeypatch.context() as m:
        m.setattr(telephony, "stored_pcm", lambda media, to: [telephony.wave_file(b"\0\0", telephony.PCM, to)])
        assert digest() != whole


# ---- 8 quality


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (7, 1), (None, 1), (5, None)], "doc_id long, quality int")
    docs = table(spark, ODD)
    m = quality.fit(docs, labels)
    got = quality.assess(docs, m).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.fit(docs, labels.where("quality = 0")) is None and quality.fit(docs, labels.limit(0)) is None and {r.score for r in quality.assess(docs, None).collect()} == {0.5}
    assert quality.assess(table(spark, []), m).count() == 0
    assert quality.keep_quality(docs, labels.limit(0)).columns == docs.columns


def plain_features(text):
    b = (text or "").encode()
    if not b:
        return [0.0] * (quality.KINDS + 8) + [1.0]
    kind = lambda c: 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in (9, 10, 11, 12, 13, 32) else 4 if chr(c) in ".,;:'\"?()-" else 5 if c < 128 else 6
    n = [0] * quality.KINDS
    for c in b:
        n[kind(c)] += 1
    w = [x.lower() for x in re.split(rb"[\x20\x09-\x0D]+", b) if x]
    lines = [x for x in b.split(b"\n") if x]
    k, own = len(w), len(set(w))
    return [(x / len(b)) ** 0.5 for x in n] + [
        n[1] / max(1, n[0] + n[1] + n[6]), sum(x == y for x, y in zip(w, w[1:])) / max(1, k - 1), (len(lines) - len(set(lines))) / max(1, len(lines) - 1), own / max(1, k),
        np.log1p(k) / 8, np.log1p(len(b) / max(1, k)) / 3, min(1, own / (3 * k**0.75 + 1)), k < 8, 0]


def test_quality_features_equal_plain_ones(sf_dir):
    import pandas as pd
    import pyarrow as pa

    texts = pd.read_parquet(f"{sf_dir}/documents.parquet")["text"].tolist() + [t for _, t in ODD] + ["a a a b", "\n\nx\nx\n", "Ä ä 1 $ (b)", " "]
    got = quality.features(*shingles.text_buffers(pa.array(texts)))
    assert np.allclose(got, [plain_features(t) for t in texts])


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_is_estimated_without_negatives(share):
    rng = np.random.default_rng(0)
    n = int(1200 * share)
    x = np.concatenate((rng.normal(2, 1, (1000, 3)), rng.normal(2, 1, (n, 3)), rng.normal(-2, 1, (1200 - n, 3))))
    pos, unl = np.arange(1000), np.arange(1000, 2200)
    prior = quality.estimated_prior(x, pos, unl)
    assert abs(prior - share) < 0.1
    m = quality.train(x, pos, unl, prior)
    m.line = quality.calibrated(m, x, pos, unl, prior)
    assert (m.score(x[: 1000 + n]) >= quality.CUT).mean() > 0.97 and (m.score(x[1000 + n :]) < quality.CUT).mean() > 0.97
    assert abs(m.score(x[unl]).mean() - share) < 0.1


def test_no_row_labelled_0_is_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = quality.fit(docs, labels), quality.fit(docs, labels.where("quality = 1"))
    assert np.array_equal(a.out, b.out) and a.line == b.line
    null = quality.assess(spark.createDataFrame([(None, "some text"), (3, None), (3, None)], "doc_id long, text string"), a).collect()
    assert [r.held_out for r in null if r.doc_id is None] == [False] and len({r.score for r in null if r.doc_id == 3}) == 1


# ---- 9 HTML


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain text  only", "plain text only"),
        ("<p>a &amp; b&nbsp;c &lt;x&gt;<br>d</p>", "a & b c <x> d"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>One two.<p>Thr<b>ee</b> four.</article><footer>f</footer>", "T\n\nOne two.\n\nThree four."),
        ("<div class='sidebar'>side</div><div id='main'><p>Long enough text of the article body.</p><p>ok</p></div><div class='comments'><p>first comment!</p></div>", "Long enough text of the article body.\n\nok"),
        ("<article><p>x</p><form><label>name</label></form><aside>a</aside><div class='ad'>buy</div><script>var a='<p>';</script></article>", "x"),
        ("<p>unclosed <i>tag", "unclosed tag"),
        ("<ul><li>a<li>b</ul>", "a\n\nb"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_article_text_in_sibling_containers_stays():
    long, short = "long text " * 80, "short text " * 14
    for one, two in (("<div>", "</div>"), ("<section>", "</section>"), ("<div><div><div>", "</div></div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<article>", "</article>")):
        for texts in ((long, short), (short, long), (long, short, "end"), (long, long, short, long)):
            body = "".join(f"{one}<p>{t}</p>{two}" for t in texts)
            for html in (body, f"<body><nav>menu</nav><div>{body}</div><footer>f</footer></body>"):
                assert html_text.main_text(html) == "\n\n".join(t.strip() for t in texts)
    for word in ("has-sidebar", "no-ads-page", "share-holders", "header2-font"):
        assert html_text.main_text(f"<div class='{word}'><p>{short}</p></div><div class='ad-2'>buy</div>") == short.strip()


PLAIN = [  # pages without article or main: only the ratios tell their regions
    ("<body><div><a href=a>Home</a> <a href=b>News and more</a></div><div><h1>Title</h1><p>{t}</p><p>Short.</p></div><div><a href=c>Imprint of us</a></div></body>", "Title\n\n{t}\n\nShort."),
    ("<body><nav>x</nav><p>by us</p><div class=ad>Buy now</div><h2>Head</h2><p>{t}</p><footer>f</footer></body>", "Head\n\n{t}"),
    ("<table><tr><td><a href=a>one</a><br><a href=b>two</a></td><td><p>{t}<p>End</td></tr></table>", "{t}\n\nEnd"),
    ("<body><div class=ad>{t}</div></body>", ""),
]


@pytest.mark.parametrize(("html", "want"), PLAIN)
def test_regions_without_article(html, want):
    t = "A long enough sentence of the text that this page is about, with more words. " * 4
    assert html_text.main_text(html.format(t=t)) == want.format(t=t.strip())


ARTICLE = "A sentence of the article that goes on for some words. " * 6


@pytest.mark.parametrize(("html", "want"), [
    # a paragraph that is one link; forms around an article, around a page and beside an article; wrappers of any depth; what only screen readers skip
    ("<article><p>{t}</p><p><a href=r>Read the whole of the council report on the budget</a></p></article>", "{t}\n\nRead the whole of the council report on the budget"),
    ("<body><nav>menu</nav><form><article><h1>Head</h1><p>{t}</p></article><p>Your name <input></p><button>go</button></form></body>", "Head\n\n{t}"),
    ("<body><form action=x><div><nav><a href=a>Home</a></nav><h1>Head</h1><p>{t}</p><p>Short.</p></div></form></body>", "Head\n\n{t}\n\nShort."),
    ("<body><p>{t}</p><form><p>Get our letter</p><label>Mail</label><input></form></body>", "{t}"),
    ("<form><p>Get our letter</p></form><p>{t}</p>", "{t}"),
    ("<div>" * 400 + "<p>Hello world</p>", "Hello world"),
    ("<article><p>a <i aria-hidden='true'>b</i> c</p></article>", "a b c"),
    ("<body><div class='related'><p>{t}</p></div></body>", ""),
])
def test_what_the_article_is(html, want):
    assert html_text.main_text(html.format(t=ARTICLE)) == want.format(t=ARTICLE.strip())


def test_equal_lines_are_kept_alike():
    """Ties: lines of one ratio are all content or none of them."""
    assert html_text.main_text("<p>same words here</p>" * 5) == "\n\n".join(["same words here"] * 5)


def test_the_clusters_decide(monkeypatch, sf_dir):
    import pandas as pd

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")["html"].tolist()[:50] + [h.format(t="Some words of text. " * 20) for h, _ in PLAIN]
    texts = [html_text.main_text(h) for h in pages]
    monkeypatch.setattr(html_text, "threshold", lambda x: -1.0)
    assert all(html_text.main_text(h) != t for h, t in zip(pages, texts))


def test_blocks_of_pages():
    page = "<article><p>a<span hidden>no</span> b<script>var x;</script>c</p>{}</article>"
    for word in ("tags", "related", "share", "search", "flash", "disclaimer", "widget"):
        assert html_text.main_text(page.format(f"<div class='{word}'><p>inside {word}</p></div>")) == f"a bc\n\ninside {word}"
    for word in ("ads", "comments", "sidebar"):
        assert html_text.main_text(page.format(f"<div class='{word}'>out</div><p>d</p>")) == "a bc\n\nd"
    assert html_text.main_text("<p>&lt;b&gt; &amp;amp; &#233;&nbsp; x\u3000y") == "<b> &amp; \u00e9 x y"
    assert html_text.main_text("<p>" + "x" * 2_000_000 + "</p>") == "x" * 2_000_000


def test_unclosed_tags_take_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        html_text.main_text("<b>" * n + "<p>x" * n + "</i>" * n + "<div>" * n)
        return time.perf_counter() - began

    took(1000)
    assert took(32_000) < 16 * max(0.05, took(8000))


def test_pages_with_clashing_columns(spark):
    rows = [(1, "u", "<p>one</p>", "t", 3), (1, "u", "<p>one</p>", "t", 3), (2, None, None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long"))
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got.collect() if r.url) == [(1, "u", "one", 3)] * 2 and got.columns == ["page_id", "url", "text", "n_chars"]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").union(spark.createDataFrame([(9001, "u", None), (9002, None, "")], "page_id long, url string, html string"))
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id > 9000} == {""} and all(r.text for r in got if r.page_id < 9000)


# ---- 10 exact dedup


def test_exact_groups(spark):
    rows = ODD + [(20, "a"), (21, "A"), (22, "x" * 9000)]
    for hash128 in (exact_dedup.content_hash, lambda t: F.unhex(F.md5(F.substring(t, 1, 1).cast("binary")))):  # the second one collides
        got = exact_dedup.exact_groups(table(spark, rows), keep="max", hash128=hash128).collect()
        assert len(got) == len(rows)
        for r in got:
            text = {d: t or "" for d, t in rows}[r.doc_id]
            same = [d for d, t in rows if (t or "") == text]
            keep = max((d for d in same if d is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(same), r.doc_id == keep, hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_drop_copies(spark):
    left = exact_dedup.drop_copies(table(spark, ODD + [(20, "a")]), keep="min")
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4, 5, 6, 7] and left.columns == table(spark, []).columns


@pytest.mark.parametrize("keep", ["min", "max"])
def test_drop_copies_goes_by_id_and_text(spark, keep):
    rows = [(None, "copy"), (1, "copy"), (None, "alone"), (None, "other"), (None, "other"), (None, None), (None, ""), (5, "one"), (5, "two"), (5, "two"), (6, "two"), (7, "three"), (7, "copy")]
    got = sorted((r.doc_id or 0, r.text or "") for r in exact_dedup.drop_copies(table(spark, rows), keep=keep).collect())
    low = keep == "min"
    want = [(1 if low else 7, "copy"), (0, "alone"), (0, "other"), (0, ""), (5, "one"), (5 if low else 6, "two"), (7, "three")]
    assert got == sorted(want)


def test_query_equals_sql(spark, sf_dir):
    from skein.llm import oracle_sql

    con = oracle.connection(sf_dir)
    for name, sql in oracle_sql().items():
        oracle.check(spark, con, sf_dir, queries()[name], sql)


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept, names = docs, []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, d)
        assert out.columns == docs.columns
        out = exact_dedup.materialise(out, f"test-{name}")
        names.append({r.doc_id: r.text for r in out.collect()})
        kept = out
    good, exact, near, mixed = names
    rows = list(good.items())
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    assert set(exact) == set(first.values())
    comps = brute_components(list(exact.items()), 5, 80)
    assert set(near) == {i for i, (_, c) in comps.items() if c == i}
    assert set(mixed) <= set(near) and len(mixed) > 0.8 * len(near)
    packed = packing.pack(kept).agg(F.countDistinct("doc_id")).first()[0]
    assert packed == len(mixed)
    assert {r.doc_id for r in p.run(spark, d).collect()} == set(mixed)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    src = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{src}/documents.parquet")
    names = "doc_id long, text string, digest string, h string, t string, node long, _near_gone long, kept boolean, _exact_id long, _MIX_N int, y int, web boolean"
    good = base.where("length(text) > 300").orderBy("doc_id").limit(3).select("text").collect()
    odd = [(None, good[0].text), (9001, good[1].text), (9001, good[1].text), (9002, None), (9003, ""), (9004, good[2].text + " and a little more"), (9005, good[2].text), (None, "alone " * 50), (9006, "x" * 200_000)]
    rows = spark.createDataFrame([(*r, "d", "h", "t", 1, 2, True, 3, 4, 5, True) for r in odd], names)
    more = base.select("doc_id", "text").withColumns({"digest": F.lit("d"), "h": F.lit("h"), "t": F.lit("t"), "node": F.lit(1).cast("long"), "_near_gone": F.lit(2).cast("long"), "kept": F.lit(True), "_exact_id": F.lit(3).cast("long"), "_MIX_N": F.lit(4), "y": F.lit(5), "web": F.lit(True)})
    for docs in (rows.unionByName(more), rows.limit(0)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{src}/labels.parquet").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
        seen = []
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, kept, str(tmp_path))
            assert out.columns == kept.columns
            kept = exact_dedup.materialise(out, f"odd-{name}")
            seen.append([(r.doc_id, r.text) for r in kept.collect()])
        packed = p.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        assert len({(r.doc_id) for r in packed}) == len({i for i, _ in seen[-1]})
        if not packed:
            continue
        judged = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        assert set(seen[0]) <= judged
        texts = [t or "" for _, t in seen[1]]
        assert len(texts) == len(set(texts)) == len({t or "" for _, t in seen[0]})  # every text once
        near = [(i, t) for i, t in seen[1] if i is not None]
        comps = brute_components(near, 5, 80)
        assert {i for i, _ in seen[2] if i is not None} == {i for i, (_, c) in comps.items() if c == i}
        assert [t for i, t in seen[2] if i is None] == [t for i, t in seen[1] if i is None]
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 0
