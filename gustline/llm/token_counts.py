"""Token counts by a byte-level BPE vocabulary compiled to two transducers.

The first splits text into pieces, as the vocabulary's pattern does: a table of
twelve states over eleven classes of characters, whose transitions say where
pieces begin.  A long text is cut into chunks; each chunk becomes a map from
every state before it to the state after it, and a parallel prefix scan over the
maps gives the state in which each chunk begins.

The second counts the tokens of a piece: an automaton over the bytes of all
tokens, whose state names the longest token that ends at a byte.  The last token
of a prefix is the longest one that can stand after the last token before it, so
each transition adds one to the count at that token's start.  Pieces that occur
again are looked up.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gustline.llm.staging import bound_batches
from gustline.llm.words import mix, parts, powers, text_bytes

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters of a chunk; pieces whose counts a worker remembers.
CHUNK, REMEMBERED = 4096, 2_000_000

# Classes of characters: letters apart from those of contractions, letters that end a contraction alone, r and v, l, e,
# numbers, the space, other white space, the apostrophe, and the rest.
LETTER, ENDING, RV, EL, EE, NUMBER, SPACE, WHITE, QUOTE, OTHER = range(10)
UNSEEN = 255
# States: before any character, in letters, in numbers, in others, after a quote that begins a piece, after r or v or l
# behind such a quote, after a contraction, and in white space of one or more characters that ends in a space or not.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, QUOTED_RV, QUOTED_L, DONE, SPACE1, SPACES, WHITE1, WHITES = range(12)
STATES, CLASSES = 12, 10
#: Marks of a transition: a piece begins at this character; at the one before.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for each state and class, flat."""
    after = np.zeros((STATES, CLASSES), np.int64)
    marks = np.zeros((STATES, CLASSES), np.uint8)
    fresh = {NUMBER: IN_NUMBERS, SPACE: SPACE1, WHITE: WHITE1, QUOTE: QUOTED, OTHER: IN_OTHERS}
    letters = (LETTER, ENDING, RV, EL, EE)
    for c in range(CLASSES):
        begin = fresh.get(c, IN_LETTERS)
        white = c in (SPACE, WHITE)
        for s in range(STATES):
            after[s, c], marks[s, c] = begin, HERE
        if c in letters:
            after[IN_LETTERS, c], marks[IN_LETTERS, c] = IN_LETTERS, 0
        if c == NUMBER:
            marks[IN_NUMBERS, c] = 0
        if c in (QUOTE, OTHER):
            for s in (IN_OTHERS, QUOTED):
                after[s, c], marks[s, c] = IN_OTHERS, 0
        for s in (SPACE1, SPACES):
            if not white:
                after[s, c] = IN_OTHERS if c == QUOTE else begin
                marks[s, c] = BEFORE if s == SPACES else 0
        for s in (SPACE1, SPACES, WHITE1, WHITES):
            if white:
                after[s, c], marks[s, c] = (SPACES if c == SPACE else WHITES), 0
        if not white:
            marks[WHITES, c] = HERE | BEFORE
        for s in (QUOTED_RV, QUOTED_L):
            marks[s, c] = BEFORE if c in letters else HERE | BEFORE
            if c in letters:
                after[s, c] = IN_LETTERS
    after[QUOTED, ENDING], marks[QUOTED, ENDING] = DONE, 0
    after[QUOTED, RV], marks[QUOTED, RV] = QUOTED_RV, 0
    after[QUOTED, EL], marks[QUOTED, EL] = QUOTED_L, 0
    after[QUOTED_RV, EE], marks[QUOTED_RV, EE] = DONE, 0
    after[QUOTED_L, EL], marks[QUOTED_L, EL] = DONE, 0
    return after.reshape(-1), marks.reshape(-1)


AFTER, MARKS = _splitter()


def _walk(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray, marks: np.ndarray | None):
    """Runs all chunks in step, longest first; ``state`` has a row for each chunk and is replaced by the last states."""
    alive = len(starts)
    for k in range(int(lengths[0]) if alive else 0):
        while alive and lengths[alive - 1] <= k:
            alive -= 1
        at = starts[:alive] + k
        cell = state[:alive] * CLASSES + (classes[at] if state.ndim == 1 else classes[at][:, None])
        if marks is not None:
            marks[at] = MARKS[cell]
        state[:alive] = AFTER[cell]
    return state


def split_marks(classes: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a piece begins, for texts classes[offsets[i]:offsets[i + 1]]."""
    sizes = np.diff(offsets)
    count = -(-sizes // chunk)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[:-1][owner] + nth * chunk
    lengths = np.minimum(chunk, offsets[1:][owner] - starts)
    entry = np.full(len(owner), START)
    inner = np.flatnonzero(count[owner] > 1)
    if len(inner):
        # maps of the chunks of long texts; a text's first chunk sends every state where START goes
        order = inner[np.argsort(-lengths[inner], kind="stable")]
        maps = np.tile(np.arange(STATES), (len(owner), 1))
        begin = np.tile(np.arange(STATES), (len(order), 1))
        begin[nth[order] == 0] = START
        maps[order] = _walk(classes, starts[order], lengths[order], begin, None)
        reach = 1
        while reach < int(count.max()):
            far = np.flatnonzero(nth >= reach)
            maps[far] = np.take_along_axis(maps[far], maps[far - reach], axis=1)
            reach *= 2
        later = np.flatnonzero(nth > 0)
        entry[later] = maps[later - 1, START]
    order = np.argsort(-lengths, kind="stable")
    marks = np.zeros(len(classes), np.uint8)
    last = _walk(classes, starts[order], lengths[order], entry[order], marks)
    begins = (marks & HERE).astype(bool)
    back = np.flatnonzero(marks & BEFORE) - 1
    begins[back] = True
    final = np.isin(last, (QUOTED_RV, QUOTED_L)) & (nth[order] == count[owner[order]] - 1)
    begins[(starts[order] + lengths[order] - 1)[final]] = True
    return begins


def _bytes_of(symbols: dict[str, int], token: str) -> bytes:
    return bytes(symbols[c] for c in token)


class Compiled:
    """The transducers of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        self.pattern = Tokenizer.from_file(path).pre_tokenizer
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        symbols = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = given["model"]["vocab"]
        self.special = [t["content"].encode() for t in given["added_tokens"]]
        tokens = {_bytes_of(symbols, t): i for t, i in vocabulary.items() if t.encode() not in self.special}
        size = max(tokens.values()) + 1
        self.length = np.zeros(size, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for text, i in tokens.items():
            self.length[i] = len(text)
        keys, ranks = [], []
        for rank, merge in enumerate(given["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = vocabulary[a], vocabulary[b]
            made = tokens[_bytes_of(symbols, "".join(merge) if isinstance(merge, list) else merge.replace(" ", ""))]
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
            keys.append((a << 20) | b)
            ranks.append(rank)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = np.array(keys)[order], np.array(ranks)[order]
        self._automaton(tokens)
        self.pairs = np.full(1 << 22, -1, np.int64)
        self.pair_good = np.zeros(1 << 22, bool)
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for text, i in tokens.items():
            at = 0
            for b in text:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    own.append(-1)
                at = children[at][b]
            own[at] = i
        step = np.zeros((len(children), 256), np.int32)
        longest = np.full(len(children), -1, np.int64)
        self.shorter = np.full(len(self.length), -1, np.int64)
        todo = deque([(0, 0)])
        while todo:
            at, fail = todo.popleft()
            if at:
                step[at] = step[fail]
                longest[at] = longest[fail]
                if own[at] >= 0:
                    self.shorter[own[at]] = longest[fail]
                    longest[at] = own[at]
            for b, child in children[at].items():
                todo.append((child, int(step[at, b]) if at else 0))
                step[at, b] = child
        self.step, self.longest = step.reshape(-1), longest

    def can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a, b are what their joint bytes encode to.

        They aren't if some merge over the border comes before what uses up its halves: merges are undone from the
        latest back, and each pair that meets at the border is looked up.  Equal ranks go from left to right.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        never = np.int64(1) << 40
        used_x, used_y = np.full(len(a), never), np.full(len(a), never)
        while len(live):
            key = (x << 20) | y
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            rank = np.where(self.merge_keys[at] == key, self.merge_ranks[at], never)
            bad = (rank < used_x) & (rank <= used_y) & (rank < never)
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, used_x, used_y, rx, ry = (v[on] for v in (live, x, y, used_x, used_y, rx, ry))
            undo = rx >= ry
            used_x, used_y = np.where(undo, rx, used_x), np.where(undo, used_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return good

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """can_follow() with a memory of fixed size."""
        key = (a << 20) | b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(42)).astype(np.int64)
        new = np.flatnonzero(self.pairs[slot] != key)
        good = self.pair_good[slot]
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.can_follow(a[new][first], b[new][first])
            good[new] = found[back]
            self.pairs[slot[new][first]] = key[new][first]
            self.pair_good[slot[new][first]] = found
        return good

    def piece_counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[start:start + length]."""
        out = np.zeros(len(starts), np.int64)
        order = np.argsort(-lengths, kind="stable")
        low = 0
        while low < len(order):  # as many pieces at once as fit a few million cells
            width = int(lengths[order[low]])
            high = min(len(order), low + max(1, (4 << 20) // (width + 1)))
            rows = order[low:high]
            out[rows] = self._run(data, starts[rows], lengths[rows])
            low = high
        return out

    def _run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n, width = len(starts), int(lengths[0])
        last = np.full((width + 1, n), -1, np.int64)
        count = np.zeros((width + 1, n), np.int32)
        state = np.zeros(n, np.int64)
        alive = n
        for i in range(1, width + 1):
            while alive and lengths[alive - 1] < i:
                alive -= 1
            state[:alive] = self.step[state[:alive] * 256 + data[starts[:alive] + (i - 1)]]
            token = self.longest[state[:alive]]
            open_ = np.arange(alive)
            while len(open_):
                t = token[open_]
                before = last[i - self.length[t], open_]
                inner = np.flatnonzero(before >= 0)
                wrong = inner[~self._follows(before[inner], t[inner])]
                open_ = open_[wrong]
                token[open_] = self.shorter[token[open_]]
            last[i, :alive] = token
            rows = np.arange(alive)
            count[i, :alive] = count[i - self.length[token], rows] + 1
        return count[lengths, np.arange(n)]

    def classes_of(self, points: np.ndarray) -> np.ndarray:
        """Classes of characters; new ones are learned from the pieces that the vocabulary's own pattern makes."""
        found = self.classes[points]
        if (found == UNSEEN).any():
            for point in np.unique(points[found == UNSEEN]).tolist():
                c = chr(point)
                pieces = lambda s: len(self.pattern.pre_tokenize_str(s))
                kind = {"s": ENDING, "t": ENDING, "m": ENDING, "d": ENDING, "r": RV, "v": RV, "l": EL, "e": EE}.get(c)
                if c in (" ", "'"):
                    kind = SPACE if c == " " else QUOTE
                elif kind is None:
                    joins = [k for k, p in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if pieces(p + c) == 1]
                    kind = joins[0] if joins else WHITE
                self.classes[point] = kind
            found = self.classes[points]
        return found

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of the texts data[offsets[i]:offsets[i + 1]], which hold no special strings."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = _code_points(data, at)
        text_ends = np.searchsorted(at, offsets)
        begins = np.flatnonzero(split_marks(self.classes_of(points), text_ends))
        starts = at[begins]
        document = np.searchsorted(offsets, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        names = mix((sums[ends] - sums[starts]) * down[starts] + mix((ends - starts).astype(np.uint64)))
        names, first, back = np.unique(names, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, names), max(0, len(self.known) - 1))
        old = self.known[place] == names if len(self.known) else np.zeros(len(names), bool)
        counts = np.zeros(len(names), np.int64)
        counts[old] = self.counts[place[old]]
        new = np.flatnonzero(~old)
        if len(new):
            counts[new] = self.piece_counts(data, starts[first[new]], (ends - starts)[first[new]])
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.counts = names, counts
            else:
                merged = np.concatenate([self.known, names[new]])
                order = np.argsort(merged, kind="stable")
                self.known, self.counts = merged[order], np.concatenate([self.counts, counts[new]])[order]
        return np.bincount(document, weights=counts[back], minlength=n).astype(np.int64)

    def count_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of texts as the library counts them by default: a special string is a token and cuts the text."""
        raw = data.tobytes()
        cuts = [offsets]
        holes = []
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                owner = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(special) <= offsets[owner + 1]:
                    holes.append((at, at + len(special), owner))
                    at = raw.find(special, at + len(special))
                else:
                    at = raw.find(special, at + 1)
        if not holes:
            return self.count(data, offsets)
        keep = np.ones(len(data), bool)
        for s, e, _ in holes:
            keep[s:e] = False
        cuts = np.unique(np.concatenate([offsets, [h[0] for h in holes], [h[1] for h in holes]]))
        cuts = cuts[(cuts >= offsets[0]) & (cuts <= offsets[-1])]
        owner = np.searchsorted(offsets, cuts[:-1], "right") - 1
        kept = np.concatenate([[0], np.cumsum(keep)])
        counts = self.count(data[keep], kept[cuts])
        total = np.bincount(owner, weights=counts, minlength=len(offsets) - 1)
        total += np.bincount([h[2] for h in holes], minlength=len(offsets) - 1)
        return total.astype(np.int64)


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    lead = data[at].astype(np.int32)
    points = lead.copy()
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        rows = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[rows] & mask
        for k in range(1, more + 1):
            value = (value << 6) | (data[at[rows] + k] & 0x3F)
        points[rows] = value
    return points


@lru_cache(maxsize=2)
def compiled(path: str) -> Compiled:
    return Compiled(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) of every row.

    Reads ``doc_id`` and ``text`` only.  Counts are those of the vocabulary's library over the whole text, with nothing
    added at either end; ``path`` is the vocabulary file, on every machine.  A null or empty text has no bytes and no
    tokens.  Repeated rows are counted each.  An empty table gives no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            counts = [
                machine.count_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in parts(offsets)
            ]
            tokens = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
