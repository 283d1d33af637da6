"""BPE encoding by backtracking over longest matches, and decoding by an offset table (operator 13).

A word is a string of symbols: its bytes, of which the last one carries the word's end.  An Aho-Corasick
automaton finds the longest token that starts at each symbol.  The encoder takes the longest token that is
compatible with the one before it, else the next shorter prefix that is a token; where none fits, it gives
the last token up and marks its end as a dead end, so that each position is left for good once and the
work is linear in the word.  Two tokens are compatible where no merge across their border would have come
before the merges that made them; a table keeps the answers.  A sequence whose neighbours are all
compatible is the one that merging by rank gives, so the ids are exact, not an approximation.

Before that, a text is cut at the added tokens, normalised (NFC, lower case letter by letter) and split into
words.  Text with code points that this Python's Unicode tables don't know is normalised and split by the
tokenizer file's own rules.

Decoding gathers bytes from one buffer of all tokens by their offsets; tokens are joined by one blank, as
the file names no decoder.  Ids that the file doesn't have give nothing.

Nulls: a null text is empty and has no ids; null ids decode to an empty text.  Repeated and null document
ids each keep a row.  Empty tables give no rows.  Other columns are not looked at and not returned, unless
``carry`` names them.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb

#: Words, and pairs of tokens, that a worker remembers; a full table starts anew.
MOST_WORDS, MOST_PAIRS = 1 << 19, 1 << 20
#: Longer words are encoded each time.
LONGEST_KEPT = 64
#: Ids that are decoded at once.
DECODE_IDS = 1 << 18
#: Bits of a token's id in the key of a pair.
PAIR = 32
#: Added to the last byte of a word: the symbol that ends it.
END = 256
#: What a code point is to the splitter.
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Endings that stay together with the apostrophe before them (fixed values of the tokenizer file's pattern).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


def words(text: str) -> list[str]:
    """The words of a normalised text: endings with an apostrophe, runs of letters, single numbers, runs of the rest but white space."""
    if not text:
        return []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    first = np.empty(len(code), bool)
    first[0] = True
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    for at in np.flatnonzero((code == 39) & first).tolist():
        ending = next((e for e in ENDINGS if text.startswith(e, at + 1)), "")
        if ending:
            first[at + 1 : at + 1 + len(ending)] = False
            if at + 1 + len(ending) < len(code):
                first[at + 1 + len(ending)] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(code))
    dark = kind[start] != SPACE
    return [text[a:b] for a, b in zip(start[dark].tolist(), end[dark].tolist(), strict=True)]


class _Kept(dict):
    """A table of answers that are worked out when first asked for."""

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, key):
        found = self.work(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = found
        return found


class Merges:
    """Tokens as strings of symbols, the merges that make them, and which of them may stand side by side."""

    def __init__(self, symbols: dict[int, str], merges: list[tuple[int, int, int]]):
        """``symbols``: the symbols of each token; ``merges``: (left, right, made) in order of rank."""
        self.made = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        self.rank = dict.fromkeys(symbols, -1) | {made: rank for rank, (_, _, made) in enumerate(merges)}
        self.parts = {made: (a, b) for a, b, made in merges}
        self.fits = _Kept(lambda pair: self.compatible(pair >> PAIR, pair & (1 << PAIR) - 1), MOST_PAIRS)
        self.token = {s: t for t, s in symbols.items() if self._whole(t)}
        self.size: list[int] = [0] * (max(symbols) + 1)
        self.shorter: list[int | None] = [None] * len(self.size)
        for s, t in self.token.items():
            self.size[t], self.shorter[t] = len(s), self._longest_prefix(s)
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for s, t in self.token.items():
            self.automaton.add_word(s, (len(s) - 1, t))
        self.automaton.make_automaton()

    def _whole(self, token: int) -> bool:
        """False for a token that merging its own symbols doesn't give: no text has it."""
        return token not in self.parts or self.compatible(*self.parts[token], below=self.rank[token])

    def _longest_prefix(self, s: str) -> int | None:
        return next((self.token[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.token), None)

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """True where no merge across the border comes before those inside; with ``below``, none before that rank.

        The tokens next to the border are undone, the later one first.  Each stands there from its own rank until
        that of the token that takes it up; of equal ranks the merge farther left comes first.
        """
        left_until = right_until = len(self.made) if below is None else below
        if below is not None:
            right_until -= 1
        while True:
            rank = self.made.get((left, right))
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a >= b:
                left_until, left = a, self.parts[left][1]
            else:
                right_until, right = b, self.parts[right][0]

    def encode(self, s: str) -> tuple[int, ...]:
        """The tokens of a word's symbols."""
        whole = self.token.get(s)
        if whole is not None or not s:
            return (whole,) if s else ()
        n = len(s)
        longest: list[int | None] = [None] * n
        for end, (back, token) in self.automaton.iter(s):
            longest[end - back] = token  # a later end is a longer match
        size, fits, shorter = self.size, self.fits, self.shorter
        alive = [True] * (n + 1)
        out: list[int] = []
        at, last, token = 0, None, longest[0]
        while True:
            while token is not None:
                end = at + size[token]
                if alive[end] and (last is None or fits[last << PAIR | token]):
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                if end == n:
                    return tuple(out)
                at, last, token = end, token, longest[end]
            else:
                if last is None:
                    raise ValueError("the vocabulary lacks one of the word's symbols")
                alive[at] = False
                token = shorter[out.pop()]
                at -= size[last]
                last = out[-1] if out else None


class Codec:
    """The encoder and the offset table of one tokenizer file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        letters = byte_letters()
        byte = {c: b for b, c in letters.items()}

        def symbols(token: str) -> str:
            ends = token.endswith(suffix) and token != suffix
            bytes_ = [byte[c] for c in (token[: -len(suffix)] if ends else token)]
            return "".join(map(chr, [*bytes_[:-1], bytes_[-1] + END * ends]))

        vocabulary = model["vocab"]
        # the end's own letters are also a token of a text that has them, without being an end
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.merges = Merges({i: symbols(t) for t, i in vocabulary.items()}, merges)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.unknown = _Kept(lambda c: unicodedata.category(c) == "Cn", MOST_WORDS)
        own = Tokenizer.from_file(path)
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        self.byte = byte
        self.kept = _Kept(self._word, MOST_WORDS)

        strings = {i: t for t, i in (vocabulary | self.added).items()}
        table = [(strings[i] + " ").encode() if i in strings else b"" for i in range(max(strings) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        self.buffer = np.frombuffer(b"".join(table), np.uint8)

    def _word(self, word: str) -> tuple[int, ...]:
        return self._bytes(word.encode())

    def _bytes(self, raw: bytes) -> tuple[int, ...]:
        s = raw.decode("latin-1")
        return self.merges.encode(s[:-1] + chr(ord(s[-1]) + END)) if s else ()

    def _words(self, found: list[str]) -> Iterator[tuple[int, ...]]:
        kept = self.kept
        if max(map(len, found), default=0) <= LONGEST_KEPT:
            return map(kept.__getitem__, found)
        return (kept[w] if len(w) <= LONGEST_KEPT else self._word(w) for w in found)

    def _part(self, text: str) -> Iterator[int]:
        if not text.isascii() and any(map(self.unknown.__getitem__, set(text))):
            split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
            return chain.from_iterable(self._bytes(bytes(self.byte[c] for c in w)) for w, _ in split)
        # a capital sigma at a word's end is lowered like any other
        return chain.from_iterable(self._words(words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = self.cut.split(text) if self.cut else [text]
        return np.array([*chain.from_iterable((self.added[p],) if p in self.added else self._part(p) for p in parts)], np.int32)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of consecutive runs of ids that end at ``ends``, and the texts' ends."""
        known = (ids >= 0) & (ids < len(self.offsets) - 1)
        known[known] = self.offsets[ids[known] + 1] > self.offsets[ids[known]]
        ends = np.concatenate([[0], np.cumsum(known)])[ends]
        ids = ids[known]
        first, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        size[ends[np.diff(ends, prepend=0) > 0] - 1] -= 1  # no blank after a text's last token
        stop = np.cumsum(size)
        out = np.concatenate([np.zeros(0, np.uint8), *(self._gather(first[a : a + DECODE_IDS], size[a : a + DECODE_IDS]) for a in range(0, len(ids), DECODE_IDS))])
        return out, np.concatenate([[0], stop])[ends]

    def _gather(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        before = np.cumsum(size) - size
        return self.buffer[np.repeat(first - before, size) + np.arange(int(size.sum()))]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a file, built once for each Python worker."""
    return Codec(path)


def _columns(df: DataFrame, doc_id: str, carry: tuple[str, ...]) -> list:
    return [F.col(f"`{c}`") for c in (doc_id, *carry)]


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, ids) for each row of ``docs``: the ids of its whole text."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(*_columns(docs, doc_id, carry), F.col(f"`{text}`").alias("__text"))
    shape = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for s in tb.slices(texts):
                found = [own.encode(t) for t in texts.slice(s.first, s.n).to_pylist()]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*(c.slice(s.first, s.n) for c in batch.columns[:-1]), ids], names=[f.name for f in shape.fields])

    return rows.mapInArrow(run, shape)


def decode(encoded: DataFrame, ids: str = "ids", doc_id: str = "doc_id", vocabulary: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, text) for each row of ``encoded``: its ids as text."""
    path = vocabulary or default_vocabulary()
    rows = encoded.select(*_columns(encoded, doc_id, carry), F.col(f"`{ids}`").cast("array<int>").alias("__ids"))
    shape = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            stop = np.cumsum(size)
            at = 0
            while at < len(lists):
                to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + DECODE_IDS, side="right")))
                flat = lists.slice(at, to - at).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                raw, ends = own.decode(flat.astype(np.int64), np.cumsum(size[at:to]))
                texts = pa.StringArray.from_buffers(to - at, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:-1]), texts], names=[f.name for f in shape.fields])
                at = to

    return rows.mapInArrow(run, shape)


def digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, then decoded from the ids."""
    ids = encode(docs, text, doc_id, vocabulary)
    counted = ids.select(
        F.col(f"`{doc_id}`"), "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
    ).toDF("__id", "ids", "n_tokens", "ids_sha256")
    back = decode(counted, "ids", "__id", vocabulary, ("n_tokens", "ids_sha256"))
    return back.select(F.col("__id").alias(doc_id), "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
