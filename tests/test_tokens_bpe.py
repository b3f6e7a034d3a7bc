"""BPE: rounds over fragments = brute force; encoding of seen, unseen and long words."""

import random
import time
from collections import Counter

import pytest

from corpusworks.operators import bpe
from corpusworks.operators import tokens as tk

TEXT = ("the cat sat on the mat. the cat ate the rat! that hat is flat; "
        "über straße café naïve the theme thesis ") * 3


def joined(segs, a, b):
    """Scan with an index: written apart from the code under test."""
    out, i = [], 0
    while i < len(segs):
        hit = i + 1 < len(segs) and segs[i] == a and segs[i + 1] == b
        out.append(a + b if hit else segs[i])
        i += 2 if hit else 1
    return tuple(out)


def brute_bpe(words, budget, min_freq):
    segs = {w: tuple(f"{b:02x}" for b in w.encode("utf-8")) for w in words}
    merges = []
    while len(merges) < budget:
        pc = Counter()
        for w, n in words.items():
            s = segs[w]
            for p in zip(s, s[1:]):
                pc[p] += n
        if not pc:
            break
        (a, b), c = min(pc.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))
        if c < min_freq:
            break
        merges.append((len(merges), a, b, c))
        segs = {w: joined(s, a, b) for w, s in segs.items()}
    return merges


def table_of(n=1500, seed=4):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9))): rnd.randint(1, 50) for _ in range(n)}
    return words | {"aaaaaaaaab": 77, "é" * 9: 12, "x" * 400: 3}


@pytest.mark.parametrize("fragments,tied", [(100_000, 1 << 17), (60, 1 << 17), (300, 2)])
def test_500_merges_equal_brute_force(spark, fragments, tied):
    """Whatever the bounds of a round: many rounds, or ties merged one by one."""
    words = table_of()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    alphabet = {b for w in words for b in w.encode()}
    budget = 500 if fragments > 60 else 60
    got, alpha, final = bpe.train_bpe(df, 4 + len(alphabet) + budget, 2, max_fragments=fragments, max_tied=tied)
    assert got == brute_bpe(words, budget, 2) and alpha == sorted(f"{b:02x}" for b in alphabet)
    ranks = {(a, b): r for r, a, b, _ in got}
    rows = final.collect()
    assert {r["word"]: r["n"] for r in rows} == words
    assert all(r["syms"].split(" ") == bpe.merge_symbols([f"{b:02x}" for b in r["word"].encode()], ranks) for r in rows)


def test_training_ends_at_the_least_count_and_on_an_empty_table(spark):
    df = spark.createDataFrame([("abab", 1), ("cab", 1), ("q", 9)], "word string, n long")
    got, _, _ = bpe.train_bpe(df, 1000, 2)
    assert got == brute_bpe({"abab": 1, "cab": 1, "q": 9}, 900, 2)
    merges, alphabet, final = bpe.train_bpe(df.where("false"), 1000, 2)
    assert merges == [] and alphabet == [] and final.count() == 0


def test_merging_a_word_of_a_million_characters():
    rnd = random.Random(2)
    words = table_of(300, 9)
    ranks = {(a, b): r for r, a, b, _ in brute_bpe(words, 120, 2)}

    def plain(syms):
        while known := [p for p in zip(syms, syms[1:]) if p in ranks]:
            syms = joined(syms, *min(known, key=ranks.__getitem__))
        return list(syms)

    for size in (0, 1, 2, 7, 60, 300):
        syms = [f"{ord(rnd.choice('abcde')):02x}" for _ in range(size)]
        assert bpe.merge_symbols(syms, ranks) == plain(tuple(syms))
    long = [f"{ord(rnd.choice('abcde')):02x}" for _ in range(1_000_000)]
    begun = time.time()
    got = bpe.merge_symbols(long, ranks)
    assert "".join(got) == "".join(long) and time.time() - begun < 60


def test_vocabulary_and_encoding(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    vocab, merges, final = bpe.train_from_documents(docs, "text", vocab_size=120)
    v = vocab.orderBy("id").collect()
    assert [r["token"] for r in v[:4]] == ["<pad>", "<unk>", "<bos>", "<eos>"]
    assert len(v) <= 120 and [r["id"] for r in v] == list(range(len(v)))
    ids = bpe.encode_texts(docs, "doc_id", "text", bpe.encode_words(final, vocab))
    by_id = {r["id"]: r["symbol"] for r in v if r["symbol"]}
    seq = [by_id[r["token_id"]] for r in ids.orderBy("pos").collect()]
    assert bytes.fromhex("".join(seq)).decode("utf-8") == TEXT
    assert bpe.display("20") == "Ġ" and bpe.display("c3a9") == "Ã©"


def test_unseen_words_are_encoded(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    vocab, merges, final = bpe.train_from_documents(docs, "text", vocab_size=120)
    by_id = {r["id"]: r["symbol"] for r in vocab.collect() if r["symbol"]}
    new = spark.createDataFrame([(7, "thesis rat sat matter"), (8, "cat Z"), (9, "")], "doc_id long, text string")
    got = {}
    for r in bpe.encode_new_texts(new, "doc_id", "text", vocab, merges).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["token_id"])
    assert bytes.fromhex("".join(by_id[i] for i in got[7])).decode() == "thesis rat sat matter"
    assert got[8][-1] == 1 and set(got) == {7, 8}              # "Z" is no symbol of the training texts: <unk>
    known = {r["word"]: r["syms"] for r in final.collect()}
    assert {r["word"]: r["syms"] for r in bpe.apply_merges(final, merges).collect()} == known
    lost = bpe.encode_texts(new, "doc_id", "text", bpe.encode_words(final, vocab)).where("doc_id = 7")
    assert lost.count() >= 4                                    # a word without ids becomes <unk>, none vanishes
