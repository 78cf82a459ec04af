"""Tokenizer alignment against the tokenizers' own libraries and a plain loop over tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kbspark.llm import alignment
from kbspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True  # the contract says that their strings in texts are plain text


def byte_level():
    """The public rule that shows bytes as characters in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return shown


SHOWN = byte_level()


def tokens(text):
    if not text:
        return None
    a = TOKENIZER.encode(" " + text, add_special_tokens=False).ids
    b = PIECES.encode(text)
    a_bytes = [bytes(SHOWN[c] for c in TOKENIZER.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return None
    return list(zip(a, a_bytes, strict=True)), list(zip(b, b_bytes, strict=True))


def groups(text):
    found = tokens(text)
    if found is None:
        return []
    a, b = found
    out, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            out[-1][0].append(a[i][0])
            at_a += len(a[i][1])
            i += 1
        else:
            out[-1][1].append(b[j][0])
            at_b += len(b[j][1])
            j += 1
        if at_a == at_b:
            out.append(([], []))
    return out[:-1]


def expected(texts):
    all_groups = [groups(t) for t in texts]
    held = Counter(p for gs in all_groups for p in {(x, y) for a, b in gs for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for gs in all_groups:
        links = [(x, y) for a, b in gs for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        sha = hashlib.sha256(text.encode()).hexdigest() if gs else ""
        best = sum(held[p] == most[p[0]] for p in links)
        out.append((sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), best, sum(held[p] for p in links), sha))
    return out


def rows(df, key):
    return sorted(tuple(r) for r in df.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_query_equals_the_libraries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *e) for d, e in zip(docs, expected([d.text for d in docs]), strict=True))
    assert rows(QUERIES["op13_tokenizer_alignment"](spark, SF), "doc_id") == want


ODD = [
    None, "", " ", "  ", " x", "x ", "a  b", "\n\n a\t b\n", "<|endoftext|>", "hi <|endoftext|> there <s> </s> <unk>", "a▁b", "▁", "\0 a\0b",
    "ﬁne ﬂow Å", "éà", "日本語のテキスト と 中文", "🙂🙃 🙂", "​   x y", "1234567890 3.14159", "don't we'll I'VE", "aaaa" * 300,
    " " * 50 + "x", "x" + "\n" * 40, "﻿bom", "𝔘𝔫𝔦 \U0010ffff", "same words same words", "same words same words", "\x85a\x1cb \x1d c",
]


@pytest.mark.parametrize("hot", [200_000, 3, 10**9])
def test_odd_texts_repeats_and_clashing_names(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment.with_counts, "__defaults__", (hot,))
    rng = random.Random(3)
    texts = [*ODD, *["".join(rng.choice("ab é\n 日x.,'") for _ in range(rng.randrange(1, 90))) for _ in range(150)]]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in enumerate(texts)], "key long, text string, n_a int, pairs string").repartition(3)
    want = sorted((i, *e) for i, e in enumerate(expected(texts)))
    assert rows(alignment.align(docs, "key", "text"), "key") == want


def test_null_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None)], "doc_id long, text string")
    got = alignment.align(docs, "doc_id", "text").collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in got) == [(False, 0, 0), (True, 2, 4), (True, 2, 4)]
    assert alignment.align(docs.limit(0), "doc_id", "text").count() == 0


def test_galloping_finds_what_a_set_finds():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 5000), (5000, 1), (3000, 3000), (40, 100_000), (70_000, 90_000)):
        a, b = np.unique(rng.integers(0, 4 * max(n, m), n)), np.unique(rng.integers(0, 4 * max(n, m), m))
        i, j = alignment.common_ends(a, b)
        assert np.array_equal(a[i], b[j]) and np.array_equal(a[i], np.intersect1d(a, b))


def test_wide_groups_and_blocks_of_links(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 3000).astype("<u4"), rng.integers(0, 9, 3000).astype("<u4")
    ends = np.array([1000, 1001, 1010, 2900, 3000])
    cut = alignment.Groups(a, b, np.array([0, *ends[:-1]]), np.array([0, *ends[:-1]]), np.diff([0, *ends]), np.diff([0, *ends]), np.array([0, 0, 0, 1, 1]))
    want = Counter()
    for g in range(5):
        low, high = cut.a_start[g], ends[g]
        want.update((int(cut.doc[g]), int(x) * 10 + int(y)) for x in a[low:high] for y in b[low:high])
    for wide, block in ((4096, 1 << 20), (0, 1 << 20), (10**9, 50)):
        monkeypatch.setattr(alignment, "_WIDE", wide)
        monkeypatch.setattr(alignment, "_LINKS", block)
        doc, pair, times = alignment.linked(cut, 10)
        assert {(int(d), int(p)): int(t) for d, p, t in zip(doc, pair, times, strict=True)} == want


def test_new_units_are_encoded_together(monkeypatch):
    """A is asked once for many new words, and units that are cut off, forgotten or too long to be kept have the same ids."""
    own = alignment.Tokenizers(alignment.A, alignment.B)
    asked, encode = [], own.words.encode
    monkeypatch.setattr(own.words, "encode", lambda text: asked.append(text) or encode(text))
    words = [f"w{k}x{k * k}" for k in range(3000)]
    own.encode([" ".join(words[:2000]), " ".join(words[1000:])])
    assert len(asked) == 1
    own.encode([" ".join(words)])
    assert len(asked) == 1 and len(own.known) == 3000
    texts = ["b" * 60 + " a", "\na b\x85", "a\x1c \x1cb c", " x  y ", "a▁b c d", "", "b" * 60, "ﬁ a"]
    for units in (300_000, 4, 0):
        monkeypatch.setattr(alignment, "_UNITS", units)
        for some in (texts, texts[3:], texts[:1]):
            has, ids, many = own.encode(some)
            want = [tokens(t) for t in some]
            assert has.tolist() == [i for i, t in enumerate(want) if t]
            for side in range(2):
                assert ids[side].tolist() == [i for t in want if t for i, _ in t[side]]
                assert many[side].tolist() == [len(t[side]) for t in want if t]
            assert not any(len(u) > 48 for u in own.known)


def test_digests_across_blocks_of_groups(monkeypatch):
    own, texts = alignment.tokenizers(alignment.A, alignment.B), ["don't we'll", "one", "naïve 日本 unbelievable", "x y z"]
    has, (a, b), (n_a, n_b) = own.encode(texts)
    a_ends = own.a_bytes[a].cumsum()
    cut = alignment.grouped(a, b, a_ends, own.b_bytes[b].cumsum(), a_ends[n_a.cumsum() - 1])
    edges = np.searchsorted(cut.doc, np.arange(len(has) + 1)).tolist()
    want = [e[-1] for e in expected(texts)]
    for block in (1, 2, 5, 1 << 16):
        monkeypatch.setattr(alignment, "_GROUPS", block)
        assert alignment.digests(cut, edges, own) == want
