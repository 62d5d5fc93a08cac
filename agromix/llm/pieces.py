"""SentencePiece encoding into the n best segmentations, and decoding.

The lattice of a word has an edge for every piece that matches, scored as in the model; a character without a piece has
one edge of its byte pieces, which costs one penalty, as in the library's lattices. Forward Viterbi gives each position
the best score from the start. These scores are exact heuristics for an A-star search from the end: a path's priority is
what it has gathered plus the best score of its open beginning. Paths leave the queue best first, so the first is the
best and the next n - 1 are the next best.

No piece holds a word's end before a blank, so the lattice falls apart at blanks and a text's n best combine those of its
words. The distinct words of an Arrow batch that no earlier batch had are searched, each for all n paths: the trie of
pieces is walked from all positions at once, scores go forward over all words of a length, and the words' queues are
worked off together, an entry of each a round. A text's n best choose among the paths of the n - 1 words that lose least.

The model's table is of BPE type: its scores are negative merge ranks, and the best path by them is often not what the
model's merges give. encode_merged() returns the model's own encoding.

Equal scores are ordered by the search, the same each time: longer pieces at the end first. Null text counts as empty and
has one empty segmentation. Rows that repeat, or have a null identifier, are segmented each. Other columns are not read.
Long texts stay whole; words of over LONG characters are searched one by one. An empty table gives an empty result. What
a task holds is bounded by its Arrow batch. The character that stands for blanks counts as a blank in texts.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agromix.llm.common import mapped, text_of

__all__ = ["Pieces", "Segments", "decode", "encode_merged", "encode_nbest", "model_file"]

SPACE = "▁"
#: Characters of words that are searched many at a time; cells of one such block; bytes of texts or ids worked on at once.
LONG, CELLS, PART = 64, 100_000, 3 << 19
#: Words whose paths a Python worker keeps when it tidies up; it holds up to twice as many.
MEMO = 120_000


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` at ``starts``, one after another."""
    before = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


class Segments:
    """The n best paths of words, kept from batch to batch: scores, and where in ``ids`` each path lies.

    A row is a word, a column a rank; absent paths have a score of -inf.
    """

    def __init__(self, n: int):
        self.n, self.rows, self.used = n, {}, 0
        self.ids, self.again = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, bool)
        self.score, self.start, self.length = np.zeros((1 << 12, n)), np.zeros((1 << 12, n), np.int64), np.zeros((1 << 12, n), np.int32)

    def add(self, words: list[str], score: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Paths of new words; ``ids`` has them by word and, within a word, by rank."""
        first, end = len(self.rows), len(self.rows) + len(words)
        while end > len(self.score):
            self.score, self.start, self.length, self.again = (np.concatenate((x, np.zeros_like(x))) for x in (self.score, self.start, self.length, self.again))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.rows.update(zip(words, range(first, end), strict=True))
        flat = length.ravel()
        self.score[first:end], self.length[first:end] = score, length
        self.start[first:end] = (self.used + np.cumsum(flat) - flat).reshape(length.shape)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def forget(self) -> None:
        """Once there are over twice as many words as MEMO, keeps that many: those that came again, then the latest."""
        count = len(self.rows)
        if count <= 2 * MEMO:
            return
        again = np.flatnonzero(self.again[:count])[:MEMO]
        late = np.flatnonzero(~self.again[:count])
        keep = np.sort(np.concatenate((again, late[len(late) - (MEMO - len(again)) :])))
        names, length = list(self.rows), self.length[keep].astype(np.int64)
        ids = gather(self.ids, self.start[keep].ravel(), length.ravel())
        kept, score = [names[i] for i in keep.tolist()], self.score[keep]
        self.rows, self.used = {}, 0
        self.again[:] = False
        self.add(kept, score, length, ids)

    def path(self, word: str, rank: int) -> list[int]:
        row = self.rows[word]
        return self.ids[self.start[row, rank] : self.start[row, rank] + self.length[row, rank]].tolist()


class _Trie:
    """Beginnings of pieces as numbered states: a hash table from (state, character) to state, probed for many at once."""

    def __init__(self, pieces: list[tuple[str, int, float]]):
        step: dict[int, int] = {}
        self.ids, self.scores = [-1], [0.0]
        for name, one, score in pieces:
            state = 0
            for x in name:
                key = state << 21 | ord(x)
                if (state := step.get(key)) is None:
                    state = step[key] = len(self.ids)
                    self.ids.append(-1)
                    self.scores.append(0.0)
            self.ids[state], self.scores[state] = one, score
        self.ids, self.scores = np.array(self.ids, np.int32), np.array(self.scores)
        keys, values = np.array(list(step), np.uint64), np.array(list(step.values()), np.int32)
        self.bits = max(10, (8 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], probe)
            free = np.flatnonzero(self.values[slot] < 0)
            slots, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slots], self.values[slots] = keys[left[placed]], values[left[placed]]
            left = np.delete(left, placed)
            probe += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)) + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)

    def step(self, states: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The next states, -1 where no piece goes on so."""
        keys = states.astype(np.uint64) << np.uint64(21) | characters.astype(np.uint64)
        slot = self._slot(keys, 0)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        left, probe = np.flatnonzero((self.keys[slot] != keys) & (self.values[slot] >= 0)), 1
        while len(left):
            slot = self._slot(keys[left], probe)
            hit = self.keys[slot] == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            left = left[~hit & (self.values[slot] >= 0)]
            probe += 1
        return out


class Pieces:
    """The model's table of pieces and the searches over it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = table = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(table.id_to_piece(i), i) for i in range(table.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for p, i in names if table.is_byte(i)}
        self.surface = [b"" if table.is_control(i) else bytes([int(p[3:5], 16)]) if table.is_byte(i) else p.replace(SPACE, " ").encode() for p, i in names]
        self.known: dict[int, Segments] = {}
        self.pops = 0  # entries that left the queues
        self.scored = [(p, i, table.get_score(i)) for p, i in names if not (table.is_byte(i) or table.is_control(i) or table.is_unknown(i) or table.is_unused(i))]

    @cached_property
    def score(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for p, i, s in self.scored}

    @cached_property
    def lost(self) -> float:
        """The score of a character without a piece, whatever its number of bytes."""
        return min(s for _, _, s in self.scored if s > -1e8) - 10

    @cached_property
    def table(self) -> dict:
        """Beginnings of pieces, and pieces: what search() walks."""
        return {p[:n]: None for p in self.score for n in range(1, len(p))} | self.score

    @cached_property
    def trie(self) -> _Trie:
        return _Trie([(p.replace(SPACE, " "), i, s) for p, i, s in self.scored])

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.bytes.get(b, 0) for b in range(256)], np.int32)

    @cached_property
    def surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All surfaces in one, where each starts, and their lengths."""
        lengths = np.array([len(x) for x in self.surface])
        return np.frombuffer(b"".join(self.surface), np.uint8), np.cumsum(lengths) - lengths, lengths

    def search(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a word (blanks as SPACE): (score, ids), best first."""
        size, edges = len(word), self._lattice(word)
        best, ending = [0.0] + [-1e300] * size, [[] for _ in range(size + 1)]
        for start, end, ids, cost in edges:
            ending[end].append((start, ids, cost))
            if best[start] + cost > best[end]:
                best[end] = best[start] + cost
        # queue: (-(score from the start at best + score of the tail), position, order, score of the tail, tail)
        queue, order, out = [(-best[size], size, 0, 0.0, None)], 0, []
        while queue and len(out) < n:
            _, at, _, tail_score, tail = heapq.heappop(queue)
            if not at:
                ids: list = []
                while tail is not None:
                    ids += tail[0] if isinstance(tail[0], tuple) else (tail[0],)
                    tail = tail[1]
                out.append((tail_score, tuple(ids)))
                continue
            for start, ids, cost in ending[at]:
                order += 1
                heapq.heappush(queue, (-(best[start] + cost + tail_score), start, order, cost + tail_score, (ids, tail)))
        return out

    def _lattice(self, word: str) -> list[tuple]:
        """Edges (start, end, id or byte ids, score), by start: a piece each, or bytes for a character without one."""
        table, out, size, none = self.table, [], len(word), 0
        for i in range(size):
            j = i + 1
            first = found = table.get(word[i:j], none)
            while found != none:
                if found is not None:
                    out.append((i, j, found[0], found[1]))
                j += 1
                if j > size:
                    break
                found = table.get(word[i:j], none)
            if not first:
                ids = tuple([self.bytes[b] for b in word[i].encode()])
                out.append((i, i + 1, ids, self.lost))
        return out

    def _nbest(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The n best paths of words of one length; codes: a row for each place, a column for each word.

        Gives the scores (words by ranks, -inf where there are no more paths) and, for each rank, ids by word and their
        numbers. An id under zero is a character without a piece.

        Forward scores are the exact value of each open beginning, so the queue of a word need not hold more than n
        entries: each leads to a path of just its priority. All words' queues are rows of one array. An entry is an edge
        with the tail behind it. When one leaves, the next edge beside it comes into the queue. The best edge before it has
        the same priority and so leaves next; it is worked on at once. An edge that starts the word ends the next best
        path, and the word takes the best entry off its queue. In a round each word that owes paths has one entry.
        """
        size, count = codes.shape
        flat, trie = codes.ravel(), self.trie
        at, state = np.arange(size * count), np.zeros(size * count, np.int32)
        scores, ids = [], []
        for length in range(1, size + 1):
            here = int(np.searchsorted(at, (size - length + 1) * count))
            state = trie.step(state[:here], flat[at[:here] + (length - 1) * count])
            at, state = at[:here][state >= 0], state[state >= 0]
            if length > 1 and not len(at):
                break
            end = trie.ids[state] >= 0
            scores.append(np.full(size * count, -np.inf if length > 1 else self.lost))
            ids.append(-1 - flat.astype(np.int32) if length == 1 else np.zeros(size * count, np.int32))
            scores[-1][at[end]], ids[-1][at[end]] = trie.scores[state[end]], trie.ids[state[end]]
        most, ids = len(scores), np.concatenate(ids)
        used = [(x.reshape(size, count) > -np.inf).any(axis=1) for x in scores]
        best, width = np.zeros((size + 1, count)), min(most, n)
        # of each end, the edges that lead to it from the best down: their lengths, and their scores with the best before them
        lengths, through = np.zeros((size + 1, count, width), np.int8), np.full((size + 1, count, width + 1), -np.inf)
        for end in range(1, size + 1):
            some = [x for x in range(1, min(end, most) + 1) if used[x - 1][end - x]]
            found = np.stack([best[end - x] + scores[x - 1][(end - x) * count : (end - x + 1) * count] for x in some], axis=1)
            if len(some) > 1:
                order = np.argsort(-found, axis=1, kind="stable")[:, :width]
                found = np.take_along_axis(found, order, axis=1)
                lengths[end, :, : order.shape[1]] = np.array(some, np.int8)[order]
            else:
                lengths[end, :, 0] = some[0]
            through[end, :, : found.shape[1]] = found
            best[end] = found[:, 0]
        # entries: priority; place where the next edge ends, which edge that is, score and node of the tail after it
        queue = np.full((count, n), -np.inf)
        cells, row = queue.ravel(), through.shape[2]
        place, which, tail, after = np.zeros(count * n, np.int64), np.zeros(count * n, np.int64), np.zeros(count * n), np.zeros(count * n, np.int64)
        through, lengths, before = through.ravel(), lengths.ravel(), best.ravel()
        node_edge, node_after, made = [np.full(1, -1, np.int32)], [np.full(1, -1, np.int64)], 1  # node 0 is the end of all words
        out, final, owed = np.full((count, n), -np.inf), np.full((count, n), -1, np.int64), np.full(count, n)
        # the entry that each word works on, off its queue
        active, spot, edge, score, node, value = np.arange(count), np.full(count, size), np.zeros(count, np.int64), np.zeros(count), np.zeros(count, np.int64), best[size].copy()
        while len(active):
            self.pops += len(active)
            at = spot * count + active
            length = lengths.take(at * width + edge).astype(np.int64)
            start = spot - length
            node_edge.append(ids.take(((length - 1) * size + start) * count + active))
            node_after.append(node)
            beside = through.take(at * row + edge + 1) + score
            enter = np.flatnonzero(beside > -np.inf)
            if len(enter):
                word = active[enter]
                worst = word * n + queue.take(word, axis=0).argmin(axis=1)
                better = beside[enter] > cells.take(worst)
                enter, worst = enter[better], worst[better]
                cells[worst], place[worst], which[worst], tail[worst], after[worst] = beside[enter], spot[enter], edge[enter] + 1, score[enter], node[enter]
            # the best edge before this one has the same priority, so it's next
            node = np.arange(made, made + len(active))
            made += len(active)
            spot, edge, score = start, np.zeros(len(active), np.int64), value - before.take(start * count + active)
            done = np.flatnonzero(start == 0)
            if len(done):
                ended = active[done]
                rank = n - owed[ended]
                out[ended, rank], final[ended, rank] = score[done], node[done]
                owed[ended] -= 1
                slot = ended * n + queue.take(ended, axis=0).argmax(axis=1)
                value[done] = np.where(owed[ended] > 0, cells.take(slot), -np.inf)
                spot[done], edge[done], score[done], node[done] = place.take(slot), which.take(slot), tail.take(slot), after.take(slot)
                cells[slot] = -np.inf
                go = value > -np.inf
                if not go.all():
                    active, spot, edge, score, node, value = (x[go] for x in (active, spot, edge, score, node, value))
        node_edge, node_after = np.concatenate(node_edge), np.concatenate(node_after)
        return out, [self._walk(node_edge, node_after, final[:, r]) for r in range(n)]

    @staticmethod
    def _walk(edge: np.ndarray, after: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (by word, in order) and their numbers of the paths that end in ``node`` (-1: none)."""
        steps = []
        while True:
            there = (node >= 0) & (after[node] >= 0)  # the root has no edge
            if not there.any():
                break
            steps.append(np.where(there, edge[node], np.iinfo(np.int32).min))
            node = np.where(there, after[node], -1)
        if not steps:
            return np.empty(0, np.int32), np.zeros(len(node), np.int64)
        table = np.stack(steps, axis=1)
        there = table != np.iinfo(np.int32).min
        return table[there].astype(np.int32), there.sum(axis=1)

    def _with_bytes(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece replaced by the ids of their bytes."""
        if not (ids < 0).any():
            return ids, lengths
        code = np.where(ids < 0, -1 - ids, 0)
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        ends = np.cumsum(width)
        owner = np.repeat(np.arange(len(ids)), width)
        later = ends[owner] - 1 - np.arange(len(owner))  # bytes of the character after this one
        code, width_ = code[owner], width[owner]
        lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0])[width_]
        value = np.where(later == width_ - 1, lead | code >> 6 * later, 0x80 | code >> 6 * later & 0x3F)
        out = np.where(ids[owner] < 0, self.byte_ids[value], ids[owner]).astype(np.int32)
        edges = _offsets(lengths)
        return out, np.diff(_offsets(width)[edges])

    def segments(self, n: int) -> Segments:
        """The words that have been searched for n paths."""
        return self.known.setdefault(n, Segments(n))

    def segment(self, words: list[str], n: int) -> Segments:
        """The n best segmentations of distinct words, which begin with their blanks; those that are known aren't searched again."""
        found = self.segments(n)
        words = [w for w in words if w not in found.rows]
        if not words:
            return found
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            those = np.flatnonzero(sizes == size)
            if size > LONG:
                for i in those.tolist():
                    paths = self.search(words[i].replace(" ", SPACE), n)
                    more = n - len(paths)
                    found.add([words[i]], np.array([[x for x, _ in paths] + [-np.inf] * more]), np.array([[len(x) for _, x in paths] + [0] * more]), np.array([k for _, x in paths for k in x], np.int32))
                continue
            step = max(1, CELLS // size)
            for k in range(0, len(those), step):
                some = those[k : k + step]
                score, paths = self._nbest(np.ascontiguousarray(codes[starts[some] + np.arange(size)[:, None]]), n)
                spelled = [self._with_bytes(*x) for x in paths]
                length = np.stack([x for _, x in spelled], axis=1)
                # from rank by rank to word by word
                base = np.cumsum([0, *(len(x) for x, _ in spelled[:-1])])
                begin = np.stack([b + np.cumsum(x) - x for b, (_, x) in zip(base, spelled, strict=True)], axis=1)
                found.add([words[i] for i in some.tolist()], score, length, gather(np.concatenate([x for x, _ in spelled]), begin.ravel(), length.ravel()))
        return found

    def encode(self, texts: pa.Array, n: int) -> pa.ListArray:
        """The n best segmentations of each text (fewer if there are no more), best first, as structs of score and ids."""
        column = pc.replace_substring(texts.cast(pa.string()).fill_null(""), SPACE, " ").cast(pa.binary())
        bodies = [b" " + t if t else b"" for t in column.to_pylist()]
        data = b"".join(bodies)
        text_at = _offsets(np.fromiter(map(len, bodies), np.int64, len(bodies)))
        blank = np.frombuffer(data, np.uint8) == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[text_at[:-1][np.diff(text_at) > 0]] = True
        word_at = np.flatnonzero(begins)
        edges = np.append(word_at, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(word_at), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        before = len(self.segments(n).rows)
        found = self.segment(distinct, n)
        own = np.fromiter(map(found.rows.__getitem__, distinct), np.int64, len(distinct))
        found.again[own[own < before]] = True
        row = own[words.indices.to_numpy()]
        first = np.searchsorted(word_at, text_at)  # of each text, its first word
        full = np.flatnonzero(np.diff(first) > 0)
        score = np.zeros(len(bodies))
        if len(full):
            score[full] = np.add.reduceat(found.score[row, 0], first[full])
        loss = found.score[row, 0] - found.score[row, 1] if n > 1 else np.zeros(len(row))
        choices = [self._combined(found.score, row[a:b], loss[a:b], n) if n > 1 else [(0.0, ())] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        count = np.fromiter(map(len, choices), np.int64, len(choices))
        starts, lengths = found.start[row, 0].astype(np.int64), found.length[row, 0].astype(np.int64)
        there, scores, lists = [], [], []
        for r in range(n):
            has = count > r
            some = np.flatnonzero(has).tolist()
            lost = np.zeros(len(bodies))
            lost[has] = [choices[t][r][0] for t in some]
            own, size = starts, lengths
            if r:
                swaps = [(a + i, k) for a, c in zip(first[:-1][has].tolist(), (choices[t][r][1] for t in some), strict=True) for i, k in c]
                at, rank = (np.array(x, np.int64) for x in zip(*swaps, strict=True)) if swaps else (np.zeros(0, np.int64),) * 2
                own, size = starts.copy(), np.where(np.repeat(has, np.diff(first)), lengths, 0)
                own[at], size[at] = found.start[row[at], rank], found.length[row[at], rank]
            there.append(has.astype(np.int64))
            scores.append(score - lost)
            lists.append(self._lists(found.ids, own, size, first))
        found.forget()
        return self._nested(there, scores, lists)

    @staticmethod
    def _combined(scores: np.ndarray, row: np.ndarray, loss: np.ndarray, n: int) -> list[tuple[float, tuple]]:
        """The n best choices of a path for each word of a text: (what it loses, (word, rank) where it isn't the best).

        A choice that is among the n best differs from the best in words among the n - 1 that lose least.
        """
        some = np.argpartition(loss, n - 2)[: n - 1] if len(loss) >= n else np.arange(len(loss))
        some = some[np.lexsort((some, loss[some]))]
        choices: list[tuple[float, tuple]] = [(0.0, ())]
        for i in some.tolist():
            lost = (scores[row[i], 0] - scores[row[i], 1:]).tolist()
            if lost[0] == np.inf or (len(choices) == n and lost[0] >= choices[-1][0]):
                break
            more = [(own + x, (*swaps, (i, k + 1))) for own, swaps in choices for k, x in enumerate(lost) if x < np.inf]
            choices = sorted(choices + more)[:n]
        return choices

    @staticmethod
    def _lists(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(_offsets(lengths)[first].astype(np.int32), pa.array(gather(pool, starts, lengths)))

    @staticmethod
    def _nested(there: list[np.ndarray], scores: list[np.ndarray], lists: list[pa.ListArray]) -> pa.ListArray:
        """For each text the structs of those ranks that are there."""
        n = len(scores[0])
        ranks = np.stack(there, axis=1)
        order = (np.arange(len(scores))[None, :] * n + np.arange(n)[:, None])[ranks > 0]
        inner = pa.StructArray.from_arrays([pa.array(np.concatenate(scores)[order]), pa.concat_arrays(lists).take(pa.array(order))], names=["score", "ids"])
        return pa.ListArray.from_arrays(_offsets(ranks.sum(axis=1)).astype(np.int32), inner)

    def nbest(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of one text: (score, ids as 32-bit integers)."""
        return [(x["score"], array("i", x["ids"]).tobytes()) for x in self.encode(pa.array([text]), n)[0].as_py()]

    def text(self, ids) -> str:
        out = b"".join(map(self.surface.__getitem__, ids))
        return out[1:].decode("utf-8", "replace") if out[:1] == b" " else out.decode("utf-8", "replace")

    def texts(self, ids: pa.ListArray) -> pa.StringArray:
        """The texts that lists of ids stand for; null stays null. Bytes that are no UTF-8 are replaced."""
        pool, starts, widths = self.surfaces
        at = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy()[at[0] : at[-1]]
        ends = _offsets(widths[flat])[at - at[0]]
        data = gather(pool, starts[flat], widths[flat])
        blank = np.flatnonzero(np.diff(ends) > 0)
        blank = blank[data[ends[blank]] == 32]  # the blank before a text's first word
        keep = np.ones(len(data), bool)
        keep[ends[blank]] = False
        sizes = np.diff(ends)
        sizes[blank] -= 1
        out = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(_offsets(sizes).astype(np.int32)), pa.py_buffer(data[keep].tobytes())])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([b.decode("utf-8", "replace") for b in out.cast(pa.binary(), safe=False).to_pylist()], pa.string())
        return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.string())) if ids.null_count else out


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, batch.num_rows * PART // max(batch.nbytes, PART))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _encoder(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in (x for whole in batches for x in _parts(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pieces.encode(batch.column(1), n)], names=["doc_id", "nbest"])

    return run


def encode_nbest(docs: DataFrame, n: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, nbest: array of score and ids, best first) for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return mapped(rows, _encoder(path or model_file(), n), "doc_id long, nbest array<struct<score double, ids array<int>>>")


def _merger(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _pieces(path).library
        for batch in batches:
            ids = [library.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_merged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the library's own encoding, by the model's merges."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return mapped(rows, _merger(path or model_file()), "doc_id long, ids array<int>")


def _decoder(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in (x for whole in batches for x in _parts(whole)):
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pieces.texts(batch.column(at)), *batch.columns[at + 1 :]], names=["text" if i == at else x for i, x in enumerate(batch.schema.names)])

    return run


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with the column of ids replaced by the text they stand for (column text). Null stays null."""
    at = rows.columns.index(ids_col)
    schema = ", ".join(f"`{'text' if c == ids_col else c}` {'string' if c == ids_col else t}" for c, t in rows.dtypes)
    return mapped(rows, _decoder(path or model_file(), at), schema)
