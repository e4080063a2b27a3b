"""BPE encoding and decoding with a pair occurrence index.

A worker keeps the ids of words that it has met. The words of a batch that are new to it are laid out in one symbol
sequence; an index maps each adjacent pair to all its positions in it, and the ranks of pairs that occur, the active
ranks, are applied in ascending order, each to all its positions, while the lists of the pairs around them are updated.
Texts are then ids by lookup. The vocabulary file is a parameter; it is read by the driver and broadcast (a fixed size).
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, unused

# White space as the normaliser's regex engine has it, and the word pattern of the vocabulary file.
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
MOST_WORDS = 400_000
NEVER = 1 << 40  # the rank of a pair that no merge joins


def _byte_letters() -> list[str]:
    """The printable letter for each byte: itself where Latin-1 prints it, else the next free one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, free = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Bpe:
    """A word-level BPE vocabulary of the `tokenizers` JSON format (NFC, lower case, byte letters, word-end suffix)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max(vocab.values()) + 1
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.by_rank = merges
        keys = np.array([a * self.size + b for a, b, _ in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        lowest: dict[int, int] = {}
        for rank, (a, b, _) in enumerate(merges):
            lowest.setdefault(a, rank)
            lowest.setdefault(b, rank)
        self.risky = {rank for rank, (_, _, c) in enumerate(merges) if lowest.get(c, NEVER) < rank}
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        self.shown: dict[str, str] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NEVER where no merge joins them."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NEVER)

    def learn(self, words: list[str]) -> None:
        """Encode new words together and remember them."""
        data = [w.encode() for w in words]
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a word's bytes, then a symbol that no pair holds
        n = int(starts[-1])
        raw = np.frombuffer(b"\0".join(data) + b"\0", dtype=np.uint8)
        symbols = self.inner[raw]
        ends = starts[1:] - 1
        symbols[ends - 1] = self.last[raw[ends - 1]]
        symbols[ends] = -1
        word = np.repeat(np.arange(len(words)), sizes + 1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        before[0] = n - 1

        # the index: the positions of each pair that occurs, under its rank; ranks wait in a heap, the lowest first
        first = self._rank(symbols[:-1], symbols[1:])
        order = np.argsort(first, kind="stable")
        order = order[first[order] < NEVER]
        cuts = np.flatnonzero(np.diff(first[order], prepend=-1))
        where: dict[int, list[np.ndarray]] = {int(first[order[lo]]): [order[lo:hi]] for lo, hi in zip(cuts, [*cuts[1:], len(order)])}
        active = sorted(where)
        while active:
            rank = heapq.heappop(active)
            lists = where.pop(rank)
            a, b, merged = self.by_rank[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            nxt = after[at]
            at = at[(symbols[at] == a) & (symbols[nxt] == b)]
            if a == b and len(at) > 1:  # in a run, every second one
                taken, out = set(), []
                for i in at.tolist():
                    if i not in taken:
                        out.append(i)
                        taken.add(int(after[i]))
                at = np.array(out, dtype=np.int64)
            if rank in self.risky and len(at) > 1:  # the merge can activate a lower rank, which then goes first in its word
                lead = np.diff(word[at], prepend=-1) != 0
                rest, at = at[~lead], at[lead]
                if len(rest):
                    where[rank] = [rest]
                    heapq.heappush(active, rank)
            if not len(at):
                continue
            gone = after[at]
            nxt = after[gone]
            symbols[at] = merged
            symbols[gone] = -2
            after[at] = nxt
            before[nxt] = at
            prev = before[at]
            for pos, found in ((prev, self._rank(symbols[prev], symbols[at])), (at, self._rank(symbols[at], symbols[nxt]))):
                held = found < NEVER
                if not held.any():
                    continue
                pos, found = pos[held], found[held]
                order = np.argsort(found, kind="stable")
                pos, found = pos[order], found[order]
                cuts = np.flatnonzero(np.diff(found, prepend=-1)).tolist()
                for lo, hi in zip(cuts, [*cuts[1:], len(found)]):
                    r = int(found[lo])
                    if r in where:
                        where[r].append(pos[lo:hi])
                    else:
                        where[r] = [pos[lo:hi]]
                        heapq.heappush(active, r)
        kept = symbols >= 0
        ids = symbols[kept].tolist()
        cuts = np.concatenate(([0], np.cumsum(kept)))[starts].tolist()
        tokens = self.tokens
        for w, lo, hi in zip(words, cuts, cuts[1:]):
            self.known[w] = mine = tuple(ids[lo:hi])
            self.shown[w] = " ".join([tokens[t] for t in mine])

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter is lowered by itself
        return _SPACE.sub(" ", text).lower()

    def pieces(self, text: str) -> list[tuple[int | None, list[str]]]:
        """The text's special tokens and, between them, its words."""
        if self.split_special is None or "<" not in text:
            return [(None, _WORDS.findall(self.normalise(text)))]
        return [(self.special[p], []) if p in self.special else (None, _WORDS.findall(self.normalise(p))) for p in self.split_special.split(text) if p]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[array.array, str]]:
        """Ids of each text, and the text that decoding them gives (its tokens, joined by spaces)."""
        cut = [self.pieces(t) for t in texts]
        need = {w for pieces in cut for _, words in pieces for w in words}
        if len(self.known) + len(need) > MOST_WORDS:
            self.known.clear()
            self.shown.clear()
        fresh = [w for w in need if w not in self.known]
        if fresh:
            self.learn(fresh)
        known, shown = self.known, self.shown
        for pieces in cut:
            ids, parts = array.array("I"), []
            for special, words in pieces:
                if special is not None:
                    ids.append(special)
                    parts.append(self.tokens[special])
                ids.extend(chain.from_iterable(map(known.__getitem__, words)))
                parts.extend(map(shown.__getitem__, words))
            yield ids, " ".join(parts)

    def decode(self, ids) -> str:
        return " ".join(self.tokens[i] for i in ids)


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _little(ids: array.array) -> bytes:
    if sys.byteorder == "big":
        ids = array.array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def _mapped(handle, each, columns: list[str], passed: list[str], body: str, most_chars: int = 8 << 20):
    """For mapInPandas: batches are joined up to `most_chars` of text, so that the index is shared by many new words."""

    def run(batches):
        bpe = Bpe(handle.value)

        def flush(held):
            pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            rows = [each(ids, decoded) for ids, decoded in bpe.encode_batch([t or "" for t in pdf[body]])]
            out = pdf[passed].copy()
            for k, c in enumerate(columns):
                out[c] = [r[k] for r in rows]
            return out

        held, chars = [], 0
        for pdf in batches:
            held.append(pdf)
            chars += int(pdf[body].str.len().sum())
            if chars >= most_chars:
                yield flush(held)
                held, chars = [], 0
        if held:
            yield flush(held)

    return run


def _encoded(docs: DataFrame, path: str, text: str, each, added: str, passed: list[str]) -> DataFrame:
    handle = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    columns = [c.split()[0] for c in added.split(", ")]
    passed = [c for c in passed if c not in columns]
    body = unused(docs, "body")
    source = docs.select(*passed, F.coalesce(F.col(text), F.lit("")).alias(body))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1]) + added
    return source.mapInPandas(_mapped(handle, each, columns, passed, body), schema)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add `ids` (array<int>) and `decoded` to every row; null and empty texts have no ids and decode to an empty text.

    A text is encoded whole, however long, by the task that holds it. Repeated rows are encoded each; an empty table stays empty; other columns pass through, and existing columns of the
    added names are replaced.
    """
    return _encoded(docs, path, text, lambda ids, decoded: (list(ids), decoded), "ids array<int>, decoded string", docs.columns)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As `encode`, but only the key, the number of ids and digests of ids and decoded text: nothing large comes back.

    Texts, repeated rows and empty tables are as there; of other columns none is read.
    """

    def each(ids, decoded):
        return len(ids), hashlib.sha256(_little(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _encoded(docs, path, text, each, "n_tokens long, ids_sha256 string, decoded_sha256 string", [key])


def query(spark, sf_dir: str) -> DataFrame:
    """`op9_bpe`: every whole text encoded and decoded."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    with small_batches(spark):
        return materialize(digests(docs, public_tokenizers.path("word_bpe_49k.json")), "digests")
