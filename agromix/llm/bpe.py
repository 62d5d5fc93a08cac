"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a text's prefix ends in one token that is unique for each prefix. Let t be a token that ends at position
i. It is that last token just when it joins the last token of the prefix that t leaves, that is, when no merge across
the boundary comes before the merges that form the two. So a forward pass stores one token a prefix: an automaton over
all tokens gives those that end at a position, longest first, and a test of the pair picks the one. The identifiers are
read off by back-pointers from the end. No merge is ever carried out, and time is linear in the text for any input.

The words of an Arrow batch are encoded together: all distinct ones step through their positions at the same time, so
that each step is a few array operations. Words of more than LONG bytes go one by one. Verdicts on pairs and words that
come again are kept in tables of bounded size. The model is read from a ``tokenizers`` file (byte-level BPE); splitting
before the merges is left to the library, whose Unicode tables are the standard here. Literals of added tokens are one
identifier each, as there.

Null texts count as empty; an empty text has no identifiers and decodes to an empty text. Texts of any length are encoded
whole. Rows that repeat are encoded each. Other columns pass through, those named like a result are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agromix.llm.common import apart, hidden, mapped, text_of

__all__ = ["PrefixBPE", "decode_ids", "encode_ids", "model_file"]

NEVER = 1 << 30
#: Words of more bytes are encoded one by one.
LONG = 192
#: Bounds of a Python worker's tables: words, and verdicts on pairs (a power of two).
MEMO = 300_000
VERDICTS = 1 << 20
#: Bytes of words that step together.
TOGETHER = 1 << 21
#: Blanks at which a text may be cut before it is split into words: no other white space touches them.
CUT = re.compile(r"(?<=\S) (?=\S)")
TOUCHING = re.compile(r"\s\s|\s\Z")
LATIN_END = "\u0370"  # which characters before it are letters has not changed since old versions of Unicode
#: The splitting pattern of byte-level BPE, for texts of ASCII characters alone (fixed by the models).
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _alphabet() -> dict[str, int]:
    """The characters that byte-level models write bytes as: themselves where they are visible, else 256 upwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(other)}


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... of each length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class PrefixBPE:
    """A byte-level BPE model that encodes by the last tokens of prefixes."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model, chars = read["model"], _alphabet()
        settings = read["pre_tokenizer"]
        if read["normalizer"] or settings["type"] != "ByteLevel" or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE model without normalisation is needed")
        if settings["add_prefix_space"] or not settings["use_regex"]:
            raise ValueError("models that add a blank before the text, or split it otherwise, are not covered")
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.to_byte = {ord(c): chr(b) for c, b in chars.items()}
        self.added = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.at_added = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        spelled = {t: bytes(chars[c] for c in t) for t in model["vocab"]}
        size = max([*model["vocab"].values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in model["vocab"].items():
            self.bytes[i] = spelled[t]
        self._derive(model, size)
        self._automaton()
        for content, i in self.added.items():
            self.bytes[i] = content.encode()
        lengths = np.array([len(b) for b in self.bytes])
        self.blob, self.blob_start, self.blob_length = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(lengths) - lengths, lengths
        self.known_key, self.known = np.full(VERDICTS, -1, np.int64), np.zeros(VERDICTS, bool)
        self.memo: dict[str, bytes] = {}
        self.first_memo: dict[str, bytes] = {}

    def _derive(self, model: dict, size: int) -> None:
        """The two parts and the rank of each token, and which tokens their own bytes encode to."""
        vocab = model["vocab"]
        self.size, self.left, self.right = size, np.full(size, -1), np.full(size, -1)
        self.rank, self.usable = np.full(size, NEVER), np.zeros(size, bool)
        for i, b in enumerate(self.bytes):
            if len(b) == 1:
                self.rank[i], self.usable[i] = -1, True
        keys, merged = [], []
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            if self.rank[c] != NEVER or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError("each token needs one merge that comes after those of its parts")
            self.left[c], self.right[c], self.rank[c] = a, b, r
            keys.append(a * size + b)
            merged.append(r)
        order = np.argsort(keys) if keys else np.zeros(0, int)
        self.pair_key, self.pair_rank = np.array([*np.array(keys, np.int64)[order], np.iinfo(np.int64).max]), np.array([*np.array(merged, int)[order], NEVER])
        made = np.flatnonzero((self.rank >= 0) & (self.rank < NEVER))
        made = made[np.argsort(self.rank[made])]
        whole = self._unmerged(self.left[made], self.right[made], self.rank[made]) if len(made) else []
        for i, good in zip(made.tolist(), whole, strict=True):
            self.usable[i] = good and self.usable[self.left[i]] and self.usable[self.right[i]]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def _unmerged(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether no merge across the boundary of tokens a and b comes before those that form them (and before ``before``).

        Seen backwards in time, the two tokens at the boundary are a and b, then the parts of whichever was formed last,
        and so on down to bytes. Each was there until the merge into its whole; equal merges are made from the left, so a
        merge across the boundary as late as the right one's own comes first, and as late as the left one's doesn't.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x = np.broadcast_to(np.asarray(before), x.shape).copy()
        until_y, good, open_ = until_x.copy(), np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            rank = self._rank_of(x, y)
            bad = (rank < until_x) & (rank <= until_y)
            good[open_[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~bad & ((rank_x >= 0) | (rank_y >= 0))
            open_, x, y, until_x, until_y, rank_x, rank_y = (v[go] for v in (open_, x, y, until_x, until_y, rank_x, rank_y))
            of_x = rank_x > rank_y  # of two equal tokens the left one was formed first
            until_x, until_y = np.where(of_x, rank_x, until_x), np.where(of_x, until_y, rank_y)
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
        return good

    def _automaton(self) -> None:
        """States are the beginnings of usable tokens; each knows the longest token that ends there, each token the next shorter one."""
        tokens = np.flatnonzero(self.usable)
        self.length = np.array([len(b) for b in self.bytes])
        deepest = int(self.length[tokens].max(initial=0))
        at, keys, states = np.zeros(len(tokens), np.int64), [], 1
        ends, levels = [], [(0, 1)]
        for depth in range(deepest):
            on = np.flatnonzero(self.length[tokens] > depth)
            byte = np.fromiter((self.bytes[t][depth] for t in tokens[on]), np.int64, len(on))
            found, back = np.unique(at[on] * 256 + byte, return_inverse=True)
            at[on] = states + back
            keys.append(found)
            levels.append((states, states + len(found)))
            states += len(found)
            full = on[self.length[tokens[on]] == depth + 1]
            ends.append((at[full], tokens[full]))
        self.step_key = np.concatenate([*keys, [np.iinfo(np.int64).max]])  # ascending: states are numbered by depth
        own, self.fail, self.longest = np.full(states, -1), np.zeros(states, np.int64), np.full(states, -1)
        for where, which in ends:
            own[where] = which
        for lo, hi in levels[1:]:
            key = self.step_key[lo - 1 : hi - 1]
            parent, byte = key >> 8, key & 255
            if lo > 1:
                target = np.zeros(hi - lo, np.int64)
                above = parent > 0
                target[above] = self._step(self.fail[parent[above]], byte[above])
                self.fail[lo:hi] = target
            self.longest[lo:hi] = np.where(own[lo:hi] >= 0, own[lo:hi], self.longest[self.fail[lo:hi]])
            if lo == 1:
                self.fail[lo:hi] = 0
        self.shorter = np.full(self.size, -1)
        for where, which in ends:
            self.shorter[which] = self.longest[self.fail[where]]
        self.scalar: tuple | None = None

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte: the longest beginning of a token that ends there."""
        out, state = np.zeros(len(state), np.int64), state.copy()
        open_ = np.arange(len(state))
        while len(open_):
            key = state * 256 + byte[open_]
            at = np.searchsorted(self.step_key, key)
            there = self.step_key[at] == key
            out[open_[there]] = at[there] + 1
            go = ~there & (state > 0)
            open_, state = open_[go], self.fail[state[go]]
        return out

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_unmerged() through the table of verdicts: a slot holds the last pair that fell into it."""
        key = a * self.size + b
        slot = (key * 0x9E3779B97F4A7C1 >> 20) & (VERDICTS - 1)
        out, miss = self.known[slot], np.flatnonzero(self.known_key[slot] != key)
        if len(miss):
            out[miss] = self._unmerged(a[miss], b[miss])
            self.known_key[slot[miss]] = -1  # two pairs of one call may share a slot; only one of them is written below
            at, first = np.unique(slot[miss], return_index=True)
            self.known[at], self.known_key[at] = out[miss[first]], key[miss[first]]
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """The identifiers of each word (what the library splits a text into), as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        order = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: -len(words[i]))
        at = 0
        while at < len(order):
            n = max(TOGETHER // max(len(words[order[at]]), 1), 1)
            part = order[at : at + n]
            for i, ids in zip(part, self._together([words[i] for i in part]), strict=True):
                out[i] = ids
            at += n
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._alone(w)
        return out

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Words from the longest to the shortest, a position of all at a time."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths[0])
        grid = np.zeros((width, len(words)), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        grid[_ranges(lengths), np.repeat(np.arange(len(words)), lengths)] = flat
        last = np.zeros((width + 1, len(words)), np.int32)
        state, alive = np.zeros(len(words), np.int64), len(words)
        for p in range(width):
            alive = int(np.searchsorted(-lengths[:alive], -p, "left"))  # those with more than p bytes
            state = self._step(state[:alive], grid[p, :alive].astype(np.int64))
            open_, token = np.arange(alive), self.longest[state]
            while len(open_):
                before = p + 1 - self.length[token]
                good = before == 0
                inner = np.flatnonzero(~good)
                good[inner] = self._joined(last[before[inner], open_[inner]].astype(np.int64), token[inner])
                last[p + 1, open_[good]] = token[good]
                open_, token = open_[~good], self.shorter[token[~good]]
        at, active, found = lengths.copy(), np.flatnonzero(lengths), []
        while len(active):
            token = last[at[active], active]
            found.append((active, token))
            at[active] -= self.length[token]
            active = active[at[active] > 0]
        if not found:
            return [b""] * len(words)
        word, token = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(word[::-1], kind="stable")
        flat, ends = token[::-1][by].astype("<i4").tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _alone(self, word: bytes) -> bytes:
        """The same for one long word, without arrays that are as wide as it is long."""
        if self.scalar is None:
            self.scalar = ({int(k): i + 1 for i, k in enumerate(self.step_key[:-1])}, self.fail.tolist(), self.longest.tolist(), self.shorter.tolist(), self.length.tolist(), {})
        step, fail, longest, shorter, length, verdicts = self.scalar
        last, state = np.zeros(len(word) + 1, np.int32), 0
        for p, byte in enumerate(word):
            while (there := step.get(state << 8 | byte)) is None and state:
                state = fail[state]
            state = there or 0
            token = longest[state]
            while (before := p + 1 - length[token]) > 0:
                pair = (int(last[before]), token)
                if (good := verdicts.get(pair)) is None:
                    if len(verdicts) >= MEMO:
                        verdicts.clear()
                    good = verdicts[pair] = bool(self._unmerged(np.array([pair[0]]), np.array([token]))[0])
                if good:
                    break
                token = shorter[token]
            last[p + 1] = token
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return np.array(out[::-1], "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The identifiers of each text."""
        parts: list[tuple[int, str | int]] = []
        for i, text in enumerate(texts):
            at = 0
            for m in self.at_added.finditer(text) if self.at_added else ():
                parts += [(i, text[at : m.start()]), (i, self.added[m[0]])]
                at = m.end()
            parts.append((i, text[at:]))
        cut = [x if isinstance(x, int) else x.split(" ") if not TOUCHING.search(x) else CUT.split(x) for _, x in parts]
        firsts, rests = set(), set()
        for x in cut:
            if not isinstance(x, int):
                firsts.add(x[0])
                rests.update(x[1:])
        over = self._learn(firsts, self.first_memo, ""), self._learn(rests, self.memo, " ")
        out: list[list[bytes]] = [[] for _ in texts]
        for (i, _), x in zip(parts, cut, strict=True):
            if isinstance(x, int):
                out[i].append(np.int32(x).tobytes())
            else:
                out[i].append(self.first_memo[x[0]])
                out[i] += map(self.memo.__getitem__, x[1:])
        for memo, some in zip((self.first_memo, self.memo), over, strict=True):
            for w in some:
                del memo[w]
        return [np.frombuffer(b"".join(x), "<i4") for x in out]

    def _learn(self, wanted: set[str], memo: dict[str, bytes], blank: str) -> list[str]:
        """Puts the pieces, with ``blank`` before each, into the memo; returns those that it has no room for in the long run."""
        missing = list(wanted - memo.keys())
        split = [self._split(blank + w) for w in missing]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for x in split for w in x))}
        ids = self.words(list(distinct))
        room = max(MEMO - len(memo), 0)
        memo.update((w, ids[distinct[s[0]]] if len(s) == 1 else b"".join([ids[distinct[x]] for x in s])) for w, s in zip(missing, split, strict=True))
        return missing[room:]

    def _split(self, piece: str) -> list[bytes]:
        """The words that merges stay within. A blank and Latin letters are one word; the pattern's classes are plain ones where a piece is ASCII."""
        if piece[:1] == " " and piece[1:].isalpha() and max(piece) < LATIN_END:
            return [piece.encode()]
        if piece.isascii():
            return [x.encode() for x in ASCII_WORDS.findall(piece)]
        return [t.translate(self.to_byte).encode("latin-1") for t, _ in self.split(piece)]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of identifiers that lie one after another; bytes that are no UTF-8 become replacement characters."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError(f"identifiers lie between 0 and {self.size - 1}")
        n = self.blob_length[ids]
        flat = self.blob[np.repeat(self.blob_start[ids], n) + _ranges(n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(lengths)].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=2)
def _loaded(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode_ids(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ids array<int>: what the model of the file ``path`` encodes each text to."""
    rows = docs.select(*hidden(docs), text_of(text_col).alias("_body"))
    kept = rows.columns[:-1]
    file = path or model_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(file)
        for batch in batches:
            found = model.encode(batch.column("_body").to_pylist())
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], [*kept, "ids"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "ids array<int>"])
    return mapped(rows, run, schema).select(*apart(docs, "ids"), "ids")


def decode_ids(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with decoded, the text of their identifiers (null: none); added tokens are spelled out."""
    rows_ = rows.select(*hidden(rows), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("_ids"))
    kept = rows_.columns[:-1]
    file = path or model_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(file)
        for batch in batches:
            ids = batch.column("_ids")
            texts = model.decode(ids.flatten().to_numpy(zero_copy_only=False), np.diff(ids.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows_.schema.fields[:-1]), "decoded string"])
    return mapped(rows_, run, schema).select(*apart(rows, "decoded"), "decoded")
