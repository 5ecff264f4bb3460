"""Operator 13 against a brute-force version."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from csilake.llm import common, phrase_dedup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def by_hand(rows, window):
    least, out = {}, []
    cut = [(LAST if doc is None else doc, doc, SPACED.findall(text or "")) for doc, text, *_ in rows]
    for order, _, words in cut:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            least[key] = min(order, least.get(key, LAST))
    for order, doc, words in cut:
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < order:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        spans = [(i, i) for i in sorted(gone) if i - 1 not in gone]
        spans = [(a, next(j for j in range(a, len(words) + 1) if j not in gone)) for a, _ in spans]
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), spans))
    return sorted(out, key=str)


def found(docs, **more):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, [tuple(x) for x in r.spans]) for r in phrase_dedup.covered(docs, **more).collect()), key=str)


def corpus(rng, n):
    """Texts of few words with passages in common, copies, odd blanks, repeated and null ids."""
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(30))))
        rows.append((i, rng.choice([" ", "  ", "\n", "\t \x0b"]).join(parts)))
    rows += [(None, rows[3][1]), (None, rows[3][1]), (5, rows[7][1]), (n, rows[2][1]), (n, rows[2][1]), (n + 1, None), (n + 2, ""), (n + 3, " \n "), (n + 4, "é 日本 " * 40), (n + 5, "é 日本 " * 41)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,chunk", [(13, 1 << 20), (13, 300), (5, 300), (2, 1000), (1, 1000)])
def test_removed_words_are_those_of_earlier_documents(documents, window, chunk):
    rows = corpus(random.Random(window * 7 + chunk), 60)
    assert found(documents(rows), window=window, chunk_bytes=chunk) == by_hand(rows, window)


def test_windows_that_only_overlap(documents):
    """Windows of unlike runs with one seed, and copies that begin within each other."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"x{i}_{k}" for k in range(i % 3)), *words[i : i + 13 + i % 9], f"y{i}"])) for i in range(40)]
    assert found(documents(rows)) == by_hand(rows, 13)


def test_a_passage_in_a_third_of_all_documents(documents):
    rng = random.Random(3)
    line = " ".join(f"l{i}" for i in range(20))
    rows = [(i, f"{rng.random()} a{i} {line if i % 3 == 0 else ''} " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(20))) for i in range(900)]
    got = found(documents(rows), chunk_bytes=2000)
    assert got == by_hand(rows, 13) and sum(r[2] for r in got) == 299 * 20


def test_long_text_empty_table_and_further_columns(documents):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(1, text), (0, text[5000:90_000])]
    docs = documents(rows)
    assert found(docs, chunk_bytes=1000) == by_hand(rows, 13)
    more = docs.withColumns({"chunk": F.lit(1), "doc": F.lit("x"), "key": F.lit(2), "kind": F.lit(0), "n_words": F.lit(0)})
    assert found(more) == by_hand(rows, 13)
    assert found(documents([]).limit(0)) == []


def test_hashes_tell_words_apart():
    """Letter sequences that collide in any hash by powers modulo 2^64 (Thue-Morse), and words of all lengths."""
    for n in (1024, 4096, 8192):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        pair = ["".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)]
        data = np.frombuffer("".join(pair).encode(), dtype=np.uint8)
        one, two = common.word_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert one != two
    rng = random.Random(1)
    words = list({"".join(rng.choice("ab\0") for _ in range(rng.randrange(1, 40))) for _ in range(5000)} | {"a" * k for k in (4095, 4096, 4097, 9000)})
    twice = words + words[::-1]
    ends = np.cumsum([len(w) for w in twice])
    data = np.frombuffer("".join(twice).encode(), dtype=np.uint8)
    value = common.word_hashes(data, np.append(0, ends[:-1]), ends).tolist()
    assert value[: len(words)] == value[len(words) :][::-1] and len(set(value)) == len(words)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_like_structure_are_other_words(documents, spark, n):
    """The letters of a Thue-Morse word and of its swapped twin, as one-word texts of operators 5 and 8."""
    from csilake.llm import decontaminate, near_dups

    bits = [bin(i).count("1") % 2 for i in range(n)]
    one, two = ("".join(letters[x] for x in bits) for letters in ("ab", "ba"))
    docs = documents([(1, one), (2, two)])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect()) == [(1, 1, True), (2, 2, True)]
    items = spark.createDataFrame([("i", one)], "item_id string, text string")
    assert sorted((r.doc_id, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, items).collect()) == [(1, 1, True), (2, 0, False)]
