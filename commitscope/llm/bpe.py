"""BPE encoding by speculation and verification, and decoding.

A word's greedy longest-match split is proposed. It is the BPE result if every token is its own encoding and every two
adjacent tokens are compatible, that is if no merge across their border comes before the merges inside them; the checks
walk down both merge trees for all pairs of a batch at once with NumPy. Only words with a failing pair are merged
exactly, pair by pair. A worker process reads the vocabulary once and keeps up to ``CACHE`` encoded words over its tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm._common import load

CACHE, SLICE = 800_000, 4_000_000
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CONTROL = re.compile("[\x1c-\x1f]")
#: Letters that NFC keeps and the pattern takes as one word, with a following mark.
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[,.]?")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Bpe:
    """A byte-level BPE with an end-of-word suffix, read from a tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {v: k for k, v in {**self.vocab, **self.added}.items()}
        self.reach: dict[str, int] = {}  # longest token, without the suffix, that starts with these three letters
        for token in self.vocab:
            bare = token.removesuffix(self.suffix) if self.suffix and token != self.suffix else token
            self.reach[bare[:3]] = max(self.reach.get(bare[:3], 2), len(bare))
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.split_special = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) or r"(?!)")
        n = max(self.vocab.values()) + 1
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.made = np.full(n, -1, np.int64)  # rank of the merge that makes a token; -1 for single letters
        for k, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            a_id, b_id = self.vocab[a], self.vocab[b]
            c = self.vocab[a + b]
            self.rank[a_id, b_id] = (k, c)
            if self.made[c] < 0:
                self.left[c], self.right[c], self.made[c] = a_id, b_id, k
        self.result = np.array([c for _, c in self.rank.values()], np.int64)  # by rank
        keys = np.array([a << 20 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([k for k, _ in self.rank.values()], np.int64)[order]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace("\\s", _SPACE))
        self.own = np.ones(n, bool)
        # a token is its own encoding if its two parts are and are compatible, its own merge left aside
        for c in np.argsort(self.made, kind="stable"):
            if self.made[c] >= 0 and not (self.own[self.left[c]] and self.own[self.right[c]]):
                self.own[c] = False
        merged = np.flatnonzero(self.made >= 0)
        ok = self._compatible(self.left[merged], self.right[merged], self.made[merged])
        self.own[merged[~ok]] = False
        for c in merged[np.argsort(self.made[merged])]:
            self.own[c] &= self.own[self.left[c]] and self.own[self.right[c]]
        self.own_flags = self.own.tobytes()

    def _compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether encoding the two tokens' joined text gives the two tokens, for all pairs at once.

        Walks the border: a merge across it that comes before ``limit`` would have won, so the pair is not compatible;
        otherwise the later-made border token is opened and its merge is the new limit. ``below``: a first limit.
        """
        ok = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a, b
        limit = np.full(len(a), np.iinfo(np.int64).max) if below is None else below
        while len(live):
            key = x << 20 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            ok[live[clash]] = False
            made_x, made_y = self.made[x], self.made[y]
            go = ~clash & ((made_x >= 0) | (made_y >= 0))
            live, x, y, made_x, made_y = live[go], x[go], y[go], made_x[go], made_y[go]
            left = made_x > made_y  # equal merges: the left one is made first, so the right one is opened first
            limit = np.where(left, made_x, made_y + 1)
            x, y = np.where(left, self.right[x], x), np.where(left, y, self.left[y])
        return ok

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many words at once: each round applies to every word its least-ranked leftmost merge."""
        out: list[list[int]] = [[] for _ in words]
        flat = np.array([t for w in words for t in self.start(w)], np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        none = np.iinfo(np.int64).max
        while len(flat):
            key = flat[:-1] << 20 | flat[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = (self.pair_keys[at] == key) & (owner[1:] == owner[:-1])
            rank = np.append(np.where(hit, self.pair_ranks[at], none), none)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(flat)))
            least = np.minimum.reduceat(rank, first)
            for k in np.flatnonzero(least == none):
                out[owner[first[k]]] = flat[first[k] : first[k] + size[k]].tolist()
            mine = np.flatnonzero((rank == np.repeat(least, size)) & (rank != none))
            _, one = np.unique(owner[mine], return_index=True)
            spot = mine[one]
            flat[spot] = self.result[rank[spot]]
            keep = np.repeat(least != none, size)
            keep[spot + 1] = False
            flat, owner = flat[keep], owner[keep]
        return out

    def start(self, word: str) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]

    def greedy(self, word: str) -> list[int] | None:
        """Longest-match split of a word in byte letters; None where a match is not its own encoding."""
        out, at, n = [], 0, len(word)
        vocab, own, reach, end = self.vocab, self.own_flags, self.reach, word + self.suffix
        while at < n:
            top = at + reach.get(word[at : at + 3], 2)
            t = vocab.get(end[at:]) if top >= n else None
            if t is None:
                for to in range(min(n - 1, top), at, -1):
                    if (t := vocab.get(word[at:to])) is not None:
                        break
                else:
                    return None
                at = to
            else:
                at = n
            if not own[t]:
                return None
            out.append(t)
        return out

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of words in byte letters, and how many of them had to be merged exactly."""
        found = [self.greedy(w) for w in words]
        bad = [f is None for f in found]
        where = [k for k, f in enumerate(found) if f is not None and len(f) > 1]
        if where:
            sizes = np.array([len(found[k]) for k in where])
            flat = np.array([t for k in where for t in found[k]], np.int64)
            owner = np.repeat(np.arange(len(where)), sizes)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            for k in np.unique(owner[inner[~self._compatible(flat[inner], flat[inner + 1])]]):
                bad[where[k]] = True
        failing = [k for k, b in enumerate(bad) if b]
        for k, ids in zip(failing, self.merge_all([words[k] for k in failing]), strict=True):
            found[k] = ids
        return found, len(failing)

    def pretokens(self, chunk: str) -> list[str | int]:
        """Byte-letter words (str) and special ids (int) of a text without the white space that the pattern drops."""
        if _PLAIN.fullmatch(chunk):
            low = chunk.lower()
            word = low.rstrip(",.")
            own = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            return [own] if len(word) == len(low) else [own, low[-1]]
        out: list[str | int] = []
        at = 0
        for m in [*self.split_special.finditer(chunk), None]:
            part = chunk[at : m.start() if m else len(chunk)]
            if part:
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out.extend(w.encode().decode("latin-1").translate(self.letters) for w in self.pattern.findall(low))
            if m:
                out.append(self.added[m[0]])
                at = m.end()
        return out


class Coder:
    """Ids of each chunk between white space, kept in one flat array; texts are gathered from it a slice at a time."""

    def __init__(self, path: str) -> None:
        self.bpe = Bpe(path)
        names = [(self.bpe.names.get(k, "") + " ").encode() for k in range(max(self.bpe.names) + 1)]
        self.name_size = np.array([len(x) for x in names], np.int64)
        self.name_from = np.cumsum(self.name_size) - self.name_size
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin = array("I"), array("q", [0])

    def learn(self, chunks: list[str]) -> None:
        parts = [self.bpe.pretokens(c) for c in chunks]
        words = list({w for p in parts for w in p if isinstance(w, str)})
        ids = dict(zip(words, self.bpe.encode_words(words)[0], strict=True))
        for chunk, part in zip(chunks, parts, strict=True):
            self.known[chunk] = len(self.begin) - 1
            for w in part:
                self.flat.extend(ids[w]) if isinstance(w, str) else self.flat.append(w)
            self.begin.append(len(self.flat))

    def code(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids (little-endian 32-bit) and the decoded UTF-8 text (token strings joined by spaces) of each text."""
        at = 0
        while at < len(texts):  # slices of bounded size, each learned in one go
            to, room = at, SLICE
            while to < len(texts) and (room > 0 or to == at):
                room -= len(texts[to])
                to += 1
            split = [re.split(f"[{_SPACE}]+", t) if _CONTROL.search(t) else t.split() for t in texts[at:to]]
            distinct = set().union(*split)
            missing = [c for c in distinct if c not in self.known]
            if len(self.known) + len(missing) > CACHE:
                self.clear()
                missing = list(distinct)
            self.learn(missing)
            flat, begin = np.array(self.flat, "<u4"), np.array(self.begin)
            index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
            ids = _gather(flat, begin[index], begin[index + 1] - begin[index])
            ends = np.append(0, np.cumsum(begin[index + 1] - begin[index]))[np.cumsum([len(s) for s in split])]
            start = 0
            for end in ends.tolist():
                mine = ids[start:end]
                yield mine, _gather(self.name_bytes, self.name_from[mine], self.name_size[mine])[:-1].tobytes()
                start = end
            at = to


@cache
def coder(path: str) -> Coder:
    """This process's coder: a worker keeps it, and the words it knows, from task to task."""
    return Coder(path)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[start:start + size]`` over all rows."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine_coder = coder(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for mine, back in mine_coder.code(batch.column("text").to_pylist()):
                n.append(len(mine))
                ids.append(hashlib.sha256(mine.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine_coder = coder(path)
        for batch in batches:
            got = [(mine.astype(np.int32), back.decode()) for mine, back in mine_coder.code(batch.column("text").to_pylist())]
            ids = pa.array([x for x, _ in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([x for _, x in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)`` for every row; null text counts as empty (no ids, empty decoded text)."""
    return _slim(docs, id_col, text_col).mapInArrow(_whole(tokenizer), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row, repeated rows included."""
    return _slim(docs, id_col, text_col).mapInArrow(_digests(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    import public_tokenizers

    return digests(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
