"""Operator 12 against a brute-force version and the tokenizer library."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from csilake.llm import token_alignment as ta
from csilake.llm.bpe import vocabulary_path

ONE, TWO = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(ONE)
    tokenizer.encode_special_tokens = True
    return tokenizer


def tricky(rng, n):
    alphabet = ["a", "the ", "Ünï", " ", "  ", "\n", "\n ", "\t", "　", "\x85", "\x1c", "​", "日本", "▁", "<0x41>", "<s>", "<|endoftext|>", "'s", "123", "\0", "\U0001f600", "ﬁ", "é", "é", "!!", "\xa0", "\r\n", "x" * 30]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_ids_are_those_of_the_library(library):
    tokens = ta.ByteTokens(ONE)
    for text in [*tricky(random.Random(1), 3000), " " * 9_990 + "x", "a " * 6000]:
        assert tokens.encode(text) == library.encode(text, add_special_tokens=False).ids
    for text in (" " * 30_000, "a" + "\n" * 30_000 + "b", "y" * 100_000):
        assert tokens.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert all(tokens.bytes[i] for i in range(50_256))


def test_cuts_are_the_common_ends():
    rng = random.Random(2)
    for n in range(1, 400):
        whole = sorted(rng.sample(range(1, 5 * n), rng.randrange(n) + 1))
        one, two = (sorted({*(x for x in whole if rng.random() < share), 5 * n}) for share in (rng.choice([0.2, 0.9, 1]), rng.choice([0.2, 0.9, 1])))
        groups = [(i - back, j - back) for i, j, m in ta.cuts(one, two) for back in range(m - 1, -1, -1)]
        assert groups == [(one.index(x) + 1, two.index(x) + 1) for x in one if x in set(two)]


def by_hand(rows, library):
    pieces = ta.PieceTokens(TWO)
    bytes_a = {i: t for i, t in enumerate(ta.ByteTokens(ONE).bytes)}
    out, links, total = [], [], Counter()
    for doc, text, *_ in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode([text])[0] if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(pieces.bytes[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, size in ((a, bytes_a), (b, pieces.bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(size[i]), i))
                at += len(size[i])
            spans.append(own)
        pairs = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        common = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = []
        for low, high in zip([0, *common], common):
            groups.append("|".join(",".join(str(i) for s, _, i in side if low <= s < high) for side in spans))
        total.update(pairs)
        links.append(pairs)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(a), len(b), len(groups), len(pairs), digest))
    most = {}
    for (_, b), n in total.items():
        most[b] = max(n, most.get(b, 0))
    full = [(*r[:5], sum(total[p] == most[p[1]] for p in pairs), sum(total[p] for p in pairs), r[5]) for r, pairs in zip(out, links)]
    return sorted(full, key=str)


@pytest.mark.parametrize("frequent", [0, 5, 200, ta.PAIRS])
def test_rows_are_those_of_the_definition(documents, library, frequent):
    rng = random.Random(frequent)
    words = ["the", "quick", "brüne", "Fox", "überzeugung", "tokenizers", "naïveté", "1999", "日本語", "misalignment", "..."]
    rows = [(i, x) for i, x in enumerate(tricky(rng, 40))]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(40)]
    rows += [(None, "the quick"), (None, None), (7, "the quick"), (7, "the quick"), (200, ""), (201, None), (202, " "), (203, "▁x"), (204, "word " * 3000)]
    docs = documents(rows).withColumns({"row": F.lit("r"), "codes": F.lit(1), "n_a": F.lit(None).cast("string"), "links": F.lit(0)})
    got = sorted((tuple(r) for r in ta.aligned(docs, ONE, TWO, frequent).collect()), key=str)
    assert got == by_hand(rows, library)


def test_no_rows(documents):
    assert ta.aligned(documents([]).limit(0), ONE, TWO).collect() == []
    assert [tuple(r) for r in ta.aligned(documents([(1, None)]), ONE, TWO).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
