"""The BPE codec against the tokenizers library, and its edge cases."""

import hashlib
import random

import numpy as np
import pytest

from touchline.llm.bpe_codec import Merges, codec, decode, default_vocabulary, digest, encode, words


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def check(library, texts):
    own = codec(default_vocabulary())
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, text[:80]
        raw, ends = own.decode(np.array(ids, np.int64), np.array([len(ids)]))
        assert bytes(raw).decode() == library.decode(ids, skip_special_tokens=False) and ends.tolist() == [len(raw)]


def test_hard_texts(library):
    special = ["", " ", "ΑΣ Σ ΑΣΒ ς", "İİ ı", "<|endoftext|><|startoftext|>x<|endoftext|>", "a<|ENDOFTEXT|>", "</w> a</w>b </w", "it's WE'LL ''S'T 're'd", "é Å 가각", "😀😀a😀", "ᲉꟋabc", "\U00011de0 1", "\x1c\x1d a\x85b c", "١٢٣ ²½ Ⅷ", "x" * 5000, "ab" * 4000]
    check(library, special)


def test_random_texts(library):
    rng = random.Random(7)
    vocabulary = sorted(library.get_vocab())
    texts = []
    for _ in range(1500):
        n = rng.randint(1, 30)
        texts.append("".join(rng.choice(vocabulary).replace("</w>", "") for _ in range(rng.randint(1, 6))))
        texts.append("".join(rng.choice("aeinrst") for _ in range(n)))
        texts.append("".join(rng.choice("!?.#*-_=~' s") for _ in range(n)))
        texts.append("".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(n)))
    check(library, texts)


@pytest.mark.parametrize("blank", [" ", "\n", "\t"])
def test_three_million_blanks(library, blank):
    check(library, [blank * 3_000_000 + "end"])


def test_one_very_long_word(library):
    check(library, ["".join(random.Random(1).choices("abcdefghij", k=300_000)), "!" * 200_000])


def merged(s, merges):
    """Merging by rank, leftmost first, written out."""
    parts = [ord(c) for c in s]
    rank = {(a, b): (n, made) for n, (a, b, made) in enumerate(merges)}
    while True:
        found = min(((rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if found is None:
            return tuple(parts)
        i = found[1]
        parts[i : i + 2] = [rank[parts[i], parts[i + 1]][1]]


def test_small_vocabularies():
    """Random vocabularies over two and three letters, all short words."""
    rng = random.Random(3)
    for _ in range(40):
        letters = "ab" if rng.random() < 0.5 else "abc"
        symbols = {ord(c): c for c in letters}
        text = "".join(rng.choice(letters) for _ in range(400))
        parts, merges, token = [ord(c) for c in text], [], 200
        for _ in range(rng.randint(1, 12)):  # trained on a text, as such vocabularies are
            pairs = sorted(zip(parts, parts[1:]))
            pair = max(pairs, key=lambda p: (pairs.count(p), p))
            made = symbols[pair[0]] + symbols[pair[1]]
            if made in symbols.values():
                break
            symbols[token] = made
            merges.append((*pair, token))
            out = []
            for p in parts:
                if out and (out[-1], p) == pair:
                    out[-1] = token
                else:
                    out.append(p)
            parts, token = out, token + 1
        own = Merges(symbols, merges)
        for _ in range(200):
            s = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
            assert own.encode(s) == merged(s, merges)


def test_words_by_pattern():
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("'''stremvld a1.é²\n　") for _ in range(rng.randint(0, 14)))
        assert words(text) == pattern.findall(text)


def test_query_and_edges(spark, library, tmp_path):
    schema = "doc_id long, text string, ids string, n_tokens int, __id string"
    texts = [(1, "Hello World, it's 2024!"), (1, "Hello World, it's 2024!"), (2, ""), (3, None), (None, "ΑΣ <|endoftext|>"), (4, " \n\t "), (5, "long word " * 60_000)]
    path = str(tmp_path / "d")
    spark.createDataFrame([(*t, "x", 9, "y") for t in texts], schema).repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    got = sorted((tuple(r) for r in digest(docs).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in texts]
    want = [(i, len(n), sha(" ".join(map(str, n))), sha(library.decode(n, skip_special_tokens=False))) for i, n in ids]
    assert got == sorted(want, key=repr)
    assert digest(docs.limit(0)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and digest(docs.filter("doc_id > 99")).count() == 0
    back = decode(encode(docs, carry=("n_tokens",)), carry=("n_tokens",))
    assert back.columns == ["doc_id", "n_tokens", "text"] and back.filter("n_tokens = 9").count() == len(texts)


def test_foreign_ids(spark, library):
    df = spark.createDataFrame([(1, [3306, None, -1, 99_999_999, 1002]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode(df).collect()} == {1: library.decode([3306, 1002], skip_special_tokens=False), 2: "", 3: ""}
