"""Counting many fixed words in one pass over the text.

An automaton over bytes: a state is the longest word beginning that ends at the current byte, every state has its
next one for every byte (the jumps of shorter suffixes are resolved when it is built), and states where words end come
last, so that one comparison tells a hit. Texts are cut into lanes of ``LANE`` bytes, all of which advance together, one byte a
step in numpy; a lane begins as many bytes early as the longest word could reach back, so no word is lost or met twice.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa

LANE = 256


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and each text's bounds. Nulls are empty."""
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


class Automaton:
    """Finds every occurrence of ``words`` (distinct, not empty). Arrays only, so that it travels with a task."""

    def __init__(self, words: list[bytes]) -> None:
        self.sizes = np.array([len(w) for w in words], np.int64)
        letters = sorted(set(b"".join(words)))
        self.letter = np.zeros(256, np.int32)  # 0: a byte of no word
        self.letter[letters] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1
        # the tree of beginnings
        step, ends = [[-1] * width], [[]]
        for k, w in enumerate(words):
            at = 0
            for b in w:
                c = self.letter[b]
                if step[at][c] < 0:
                    step[at][c] = len(step)
                    step.append([-1] * width)
                    ends.append([])
                at = step[at][c]
            ends[at].append(k)
        # breadth first: a missing step is that of the longest suffix that is a beginning too
        suffix, waiting = [0] * len(step), deque()
        for c in range(width):
            if step[0][c] < 0:
                step[0][c] = 0
            else:
                waiting.append(step[0][c])
        while waiting:
            at = waiting.popleft()
            ends[at] = ends[at] + ends[suffix[at]]
            for c in range(width):
                follow, shorter = step[at][c], step[suffix[at]][c]
                if follow < 0:
                    step[at][c] = shorter
                else:
                    suffix[follow] = shorter
                    waiting.append(follow)
        order = sorted(range(len(step)), key=lambda s: (bool(ends[s]), s))
        number = np.empty(len(step), np.int32)
        number[order] = np.arange(len(step))
        self.width = width
        self.next = (number[np.array(step)][order] * width).astype(np.int32).ravel()  # states times width
        self.hit = width * sum(not e for e in ends)
        found = [ends[s] for s in order]
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in found])]).astype(np.int64)
        self.found = np.array([k for e in found for k in e], np.int64)

    def occurrences(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, end) of every occurrence in texts end to end; ``end``: the place after its last byte."""
        size = np.diff(bounds)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = np.minimum(start + LANE, bounds[text + 1])
        at = np.maximum(start - (int(self.sizes.max(initial=1)) - 1), bounds[text])
        order = np.argsort(at - stop, kind="stable")  # longest first
        text, start, stop, at = text[order], start[order], stop[order], at[order]
        length = stop - at
        byte = self.letter[data]
        state = np.zeros(len(at), np.int32)
        lane, ends, states = [], [], []
        active = len(at)
        for t in range(int(length[0]) if active else 0):
            while length[active - 1] <= t:
                active = int(np.searchsorted(-length, -t, side="left"))
            state = self.next[state[:active] + byte[at[:active] + t]]
            hits = np.flatnonzero(state >= self.hit)
            if len(hits):
                hits = hits[at[hits] + t >= start[hits]]  # those before the lane's own bytes are the lane's before
                lane.append(hits)
                ends.append(at[hits] + t + 1)
                states.append(state[hits] // self.width)
        if not lane:
            none = np.zeros(0, np.int64)
            return none, none, none
        lane, ends, states = np.concatenate(lane), np.concatenate(ends), np.concatenate(states)
        count = self.first[states + 1] - self.first[states]
        each = np.repeat(np.arange(len(states)), count)
        word = self.found[self.first[states][each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)]
        return text[lane][each], word, ends[each]

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, number) of occurrences that do not overlap, taken from the left, by text and word."""
        text, word, end = self.occurrences(data, bounds)
        order = np.lexsort((end, word, text))
        text, word, end = text[order], word[order], end[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
        close = np.flatnonzero(~new & (np.diff(end, prepend=0) < self.sizes[word]))
        head = np.flatnonzero(new)
        number = np.diff(np.append(head, len(text)))
        # occurrences that meet others of their word are taken one by one
        for g in np.unique(np.searchsorted(head, close, side="right") - 1).tolist():
            taken, last, size = 0, -1, int(self.sizes[word[head[g]]])
            for e in end[head[g]:head[g] + number[g]].tolist():
                if e - size >= last:
                    taken, last = taken + 1, e
            number[g] = taken
        return text[head], word[head], number
