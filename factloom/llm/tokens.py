"""Encoding with public tokenizer files; their paths are parameters."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that NFC leaves alone and lower case keeps among them, besides common punctuation (U+2010 to U+205E without its spaces).
LATIN = [chr(c) for c in range(0x180) if c != 0x130]
LETTER, NUMBER = ("".join(c for c in LATIN if unicodedata.category(c)[0] == kind) for kind in "LN")
SPACE = "\t-\r \x85\xa0"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
#: Ends a word in the byte form of the vocabulary.
STOP = "\x00"
#: What only the library encodes: other code points, special strings, STOP itself.
NOT_PLAIN = re.compile(f"[^\x01-\u012f\u0131-\u017f‐-‧‰-⁞]|<\\|")
ASCII_CHUNK = re.compile("[^ \t-\r]+")


def byte_alphabet() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for: its own, or for those from 256 on one that is not printable."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b) if b in plain else chr(256 + rest.index(b)): b for b in range(256)}


class WordEncoder:
    """Encodes with a lower-casing word vocabulary (word_bpe_49k.json); the ids are those that the tokenizers library gives.

    No token or normalization crosses ASCII white space, so of many texts each distinct chunk between it is encoded once. Chunks of plain
    characters are encoded together, by the vocabulary in byte form (a word's end being a byte of its own, merged with the word's last byte
    first); all others by the library. Nothing is kept between calls."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet, suffix = byte_alphabet(), model["end_of_word_suffix"]

        def as_bytes(token: str) -> bytes:
            return bytes(alphabet[c] for c in token.removesuffix(suffix)) + STOP.encode() * token.endswith(suffix)

        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [*(c + suffix for c in alphabet), *merged, *alphabet]
        self.ids, self.gap = np.array([*(model["vocab"][t] for t in order), 0], np.uint32), len(order)
        ranks = {as_bytes(t): i for i, t in enumerate(order)} | {b" ": self.gap}  # a blank, in no word, stands between chunks
        self.bytes = tiktoken.Encoding("words", pat_str=f"[^{SPACE}{STOP}]+{STOP}| ", mergeable_ranks=ranks, special_tokens={})

    def plain(self, chunks: str) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each chunk of plain characters in lower case, one blank after another, and all the ids."""
        got = np.array(self.bytes.encode_ordinary(LATIN_WORDS.sub(rf"\g<0>{STOP}", chunks) + " "), np.int64)
        is_gap = got == self.gap
        ends = np.flatnonzero(is_gap)
        return np.diff(ends, prepend=-1) - 1, self.ids[got[~is_gap]]

    def plain_texts(self, texts: list[str]) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.string()))
        words = lists.values.dictionary_encode()
        distinct = words.dictionary
        size, flat = self.plain(pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), " ")[0].as_py())
        at = words.indices.to_numpy()
        each = size[at]
        ends = np.cumsum(each)
        ids = flat[np.arange(each.sum()) + np.repeat((np.cumsum(size) - size)[at] - (ends - each), each)]
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def other_text(self, text: str) -> np.ndarray:
        chunks = ASCII_CHUNK.findall(text)
        distinct = list(dict.fromkeys(chunks))
        plain = [c for c in distinct if not NOT_PLAIN.search(c)]
        size, flat = self.plain(" ".join(plain).lower()) if plain else ([], np.empty(0, np.uint32))
        known = dict(zip(plain, np.split(flat, np.cumsum(size)[:-1]) if plain else ()))
        rest = [c for c in distinct if c not in known]
        known.update((c, np.array(e.ids, np.uint32)) for c, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)))
        return np.concatenate([np.empty(0, np.uint32), *map(known.__getitem__, chunks)])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of an array of words, which hold no ASCII white space, and all the ids."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        if not NOT_PLAIN.search(joined):
            return self.plain(joined.lower())
        chunks = joined.split(" ")
        other = np.array([bool(NOT_PLAIN.search(c)) for c in chunks])
        lists = [e.ids for e in self.tokenizer.encode_batch([c for c, o in zip(chunks, other) if o], add_special_tokens=False)]
        size = np.empty(len(chunks), np.int64)
        size[other] = [len(i) for i in lists]
        size[~other], plain = self.plain(" ".join(c for c, o in zip(chunks, other) if not o).lower()) if not other.all() else ([], [])
        from_library = np.repeat(other, size)
        flat = np.empty(len(from_library), np.uint32)
        flat[from_library], flat[~from_library] = [i for ids in lists for i in ids], plain
        return size, flat

    def many(self, texts: Iterable[str | None], step: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of each text, null as empty, in order; texts are worked off together in steps of about that many characters."""
        part, held = [], 0
        for t in texts:
            part.append(t or "")
            held += len(part[-1])
            if held > step:
                yield from self.part(part)
                part, held = [], 0
        yield from self.part(part)

    def part(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [(t.isascii() and "<|" not in t and STOP not in t) or not NOT_PLAIN.search(t) for t in texts]
        done = iter(self.plain_texts([t for t, p in zip(texts, plain) if p]) if any(plain) else ())
        for t, p in zip(texts, plain):
            yield next(done) if p else self.other_text(t)

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.many([text]))


def ragged(lists: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of arrays of ids, and all ids."""
    lists = list(lists)
    return np.array([len(i) for i in lists], np.int64), np.concatenate([np.empty(0, np.uint32), *lists])


def neighbours(size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word of each id, the pair that each id but the last makes with the next one as one number, and whether both are of one word."""
    word = np.repeat(np.arange(len(size)), size)
    return word, (flat[:-1].astype(np.int64) << 32) | flat[1:], word[1:] == word[:-1]


def join_pairs(size: np.ndarray, flat: np.ndarray, rounds: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words (lengths, all ids) with neighbouring ids joined to one. A round is the sorted pairs that it joins and their new ids; of pairs that
    overlap, the first, third and so on are joined."""
    for pairs, ids in rounds:
        if len(flat) < 2 or not len(pairs):
            continue
        word, pair, hit = neighbours(size, flat)
        at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        hit &= pairs[at] == pair
        place = np.arange(len(hit))
        hit &= (place - np.maximum.accumulate(np.where(hit, 0, place + 1))) % 2 == 0
        flat = flat.copy()
        flat[:-1][hit] = ids[at[hit]]
        kept = np.append(True, ~hit)
        size, flat = np.bincount(word[kept], minlength=len(size)), flat[kept]
    return size, flat


@cache
def word_encoder(path: str) -> WordEncoder:
    """One per Python worker and path."""
    return WordEncoder(path)


@cache
def byte_encoding(path: str):
    """A lossless byte-level encoding without special tokens; one per Python worker and path."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
