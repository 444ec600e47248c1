"""Suffix order of an integer string by induced sorting, with common-prefix values.

Suffixes that begin a descent (S*) are ordered first, from the string of their names: by
recursion where that string is long, directly in memory once it is short. The order of
all others is induced from them. Both directions of induction run on
a monotone priority queue that holds suffix tuples (first symbol and type, place, common
prefix with the tuple before) and moves what does not fit its memory to disk. Tuples
leave the queue in batches: as many as cannot be overtaken by what they push.
"""

import os
import tempfile

import numpy as np

#: Bytes of tuples that a queue keeps in memory.
MEMORY = 64 << 20
#: Ranges that a queue cuts its keys into, and rows of the front looked at in one go.
RANGES, AHEAD = 48, 16384
#: Names that are ordered directly, in memory.
DIRECT = 1 << 21
FAR = np.iinfo(np.int32).max
_TUPLE = 12  # bytes: place, common prefix


def scratch_folder() -> str | None:
    """Where Spark spills in this task; None outside of one (the system's choice)."""
    folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return folders[0] if folders[0] and os.path.isdir(folders[0]) else None


class MonotoneQueue:
    """Tuples by ascending key of their place, equal keys in the order they came.

    Keys are cut into ranges of about equal load, known beforehand. Only the range in
    front is sorted; what is pushed to the others waits, in memory or, once that
    is full, in one unnamed file that is gone when the queue is. No key
    below the front may be pushed.
    """

    def __init__(self, key: np.ndarray, load: np.ndarray, memory: int = MEMORY):
        self.key, self.memory = key, memory
        before = np.cumsum(load) - load
        self.range_of = (before // max(1, -(-int(load.sum()) // RANGES))).astype(np.int32)
        self.ranges = int(self.range_of[-1]) + 1
        self.ends = np.searchsorted(self.range_of, np.arange(self.ranges), "right")  # first key beyond each range
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = self.spilled = 0
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.ranges)]
        self.stored: list[list[tuple[int, int]]] = [[] for _ in range(self.ranges)]
        self.file = None
        self.now, self.beyond = -1, 0
        self.front_key = self.front_place = np.empty(0, np.int64)
        self.front_common = np.empty(0, np.int32)

    def push(self, place: np.ndarray, common: np.ndarray) -> None:
        key, common = self.key[place], common.astype(np.int32, copy=False)
        here = key < self.beyond
        if here.any():
            own = np.flatnonzero(here)
            own = own[np.argsort(key[own], kind="stable")]
            where = np.searchsorted(self.front_key, key[own], "right")
            self.front_key = np.insert(self.front_key, where, key[own])
            self.front_place = np.insert(self.front_place, where, place[own])
            self.front_common = np.insert(self.front_common, where, common[own])
            place, common = place[~here], common[~here]
        if len(place):
            self.waiting.append((place, common))
            self.count += len(place)
            if self.count * _TUPLE > self.memory:
                self._spill()

    def _deal(self) -> None:
        """Hand what waits to its ranges."""
        place, common = (np.concatenate(c) for c in zip(*self.waiting))
        to = self.range_of[self.key[place]]
        order = np.argsort(to, kind="stable")
        place, common, to = place[order], common[order], to[order]
        starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(to)]):
            self.held[int(to[at])].append((place[at:end], common[at:end]))
        self.waiting = []

    def _spill(self) -> None:
        """Move all tuples of ranges still to come to the file."""
        if self.waiting:
            self._deal()
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=scratch_folder())
        for number, blocks in enumerate(self.held):
            for place, common in blocks:
                self.stored[number].append((self.file.seek(0, os.SEEK_END), len(place)))
                self.file.write(place.tobytes() + common.tobytes())
            blocks.clear()
        self.spilled += self.count
        self.count = 0

    def _advance(self) -> None:
        if self.waiting:
            self._deal()
        self.now += 1
        self.beyond = int(self.ends[self.now])
        blocks = []
        for at, n in self.stored[self.now]:
            self.file.seek(at)
            read = self.file.read(n * _TUPLE)
            blocks.append((np.frombuffer(read, np.int64, n), np.frombuffer(read, np.int32, n, 8 * n)))
        blocks += self.held[self.now]
        self.count -= sum(len(place) for place, _ in self.held[self.now])
        self.held[self.now] = []
        if blocks:
            place, common = (np.concatenate(c) for c in zip(*blocks))
            order = np.argsort(self.key[place], kind="stable")
            self.front_place, self.front_common = place[order], common[order]
            self.front_key = self.key[self.front_place]

    def front(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, places, common prefixes) that come next; empty at the end."""
        while not len(self.front_key) and self.now + 1 < self.ranges:
            self._advance()
        return self.front_key[:AHEAD], self.front_place[:AHEAD], self.front_common[:AHEAD]

    def drop(self, n: int) -> None:
        self.front_key, self.front_place, self.front_common = (
            self.front_key[n:], self.front_place[n:], self.front_common[n:]
        )


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high]) for each pair; low < high."""
    if not len(low):
        return np.empty(0, values.dtype)
    level = np.frexp(high - low)[1] - 1
    out, table = np.empty(len(low), values.dtype), values
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def _induce(text: np.ndarray, rising: np.ndarray, runs: np.ndarray | None, seeds: np.ndarray, common: np.ndarray | None,
            backward: bool, limit: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, common prefixes with the one before) of the seeds and all they induce.

    Forward, suffixes whose next one is smaller are induced in rising order, backward
    those whose next one is larger in falling order. ``common`` of the seeds is with the
    seed before. Common prefixes are cut off at ``limit``; 0 means they are not wanted.
    """
    key = 2 * text.astype(np.int64) + rising
    if backward:
        key = key.max() - key
    load = np.bincount(key[seeds], minlength=int(key.max()) + 1) + np.bincount(
        key[rising == backward], minlength=int(key.max()) + 1
    )
    queue = MonotoneQueue(key, load, memory)
    queue.push(seeds, common if common is not None else np.zeros(len(seeds), np.int32))
    since = np.full(len(load), FAR, np.int32) if limit else None
    target_of = np.append(np.where(rising[:-1] == backward, key[:-1], 2 * FAR), 2 * FAR)  # by the place before; last: none
    places, prefixes, last = [], [], -1
    while True:
        own, at, carried = queue.front()
        if not len(own):
            break
        target = target_of[at - 1]
        # Tuples may leave together while none has a larger key than something pushed before it.
        late = own[1:] > np.minimum.accumulate(target)[:-1]
        n = int(late.argmax()) + 1 if late.any() else len(own)
        own, at, carried, target = own[:n], at[:n], carried[:n], target[:n]
        queue.drop(n)
        places.append(at)
        source = np.flatnonzero(target < 2 * FAR)
        if not limit:
            prefix = np.zeros(len(source), np.int32)
        else:
            to = target[source]
            order = np.argsort(to, kind="stable")
            source, to = source[order], to[order]
            previous = np.concatenate(([last], at[:-1]))
            same = np.concatenate(([last >= 0 and key[last] == own[0]], own[1:] == own[:-1]))
            # Falling and rising suffixes of one first symbol differ where the shorter run of it ends.
            symbol = (previous >= 0) & (text[at] == text[previous])
            shared = np.where(same, carried, np.where(symbol, np.minimum(runs[at], runs[previous]), 0))
            shared = np.minimum(shared, limit).astype(np.int32)
            prefixes.append(shared)
            new = np.concatenate(([True], to[1:] != to[:-1])) if len(to) else np.empty(0, bool)
            low = np.where(new, 0, np.concatenate(([0], source[:-1] + 1))) if len(to) else source
            least = _range_minima(shared, low, source + 1)
            least = np.where(new, np.minimum(least, since[to]), least)
            prefix = np.minimum(least, limit - 1) + 1
            rest = np.append(np.minimum.accumulate(shared[::-1])[::-1], FAR)
            since = np.minimum(since, rest[0])
            ends = np.append(new[1:], True) if len(to) else new
            since[to[ends]] = rest[source[ends] + 1]
        last = int(at[-1])
        if len(source):
            queue.push(at[source] - 1, prefix)
    joined = np.concatenate(places) if places else np.empty(0, np.int64)
    return joined, np.concatenate(prefixes) if prefixes else np.zeros(len(joined), np.int32)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, cut off at ``limit``."""
    out, open_ = np.zeros(len(a), np.int32), np.arange(len(a))
    for k in range(limit):
        open_ = open_[text[a[open_] + k] == text[b[open_] + k]]
        if not len(open_):
            break
        out[open_] = k + 1
    return out


def _names(text: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """(name of each S* substring in text order, number of names); ``ordered`` is sorted."""
    length = np.append(np.diff(starts) + 1, 1)
    number = np.searchsorted(starts, ordered)
    size = length[number]
    differs = size[1:] != size[:-1]
    open_, k = np.flatnonzero(~differs), 0
    while len(open_):
        unequal = text[ordered[open_] + k] != text[ordered[open_ + 1] + k]
        differs[open_[unequal]] = True
        k += 1
        open_ = open_[~unequal]
        open_ = open_[size[open_] > k]
    names = np.empty(len(starts), np.int64)
    names[number] = np.concatenate(([0], np.cumsum(differs)))
    return names, int(differs.sum()) + 1


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a short string: ranks by ever longer prefixes, each twice the last."""
    n, width, rank = len(names), 1, names.astype(np.int64)
    while True:
        behind = np.zeros(n, np.int64)
        behind[:-width] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


def suffix_order(text: np.ndarray, limit: int = 0, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(places of all suffixes in rising order, common prefix with the one before).

    ``text`` holds non-negative integers and ends in one that is smaller than all
    others and occurs once. Common prefixes are cut off at ``limit``; with 0 they are
    not computed (all 0).
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32)
    step = np.append(np.sign(np.diff(text.astype(np.int64))), 1)
    decides = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    rising = step[decides] > 0
    runs = None
    if limit:
        change = np.where(np.append(text[1:] != text[:-1], True), np.arange(n), n)
        runs = np.minimum.accumulate(change[::-1])[::-1] - np.arange(n) + 1
    starts = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    is_start = np.zeros(n, bool)
    is_start[starts] = True

    def induced(seeds: np.ndarray, seeds_common: np.ndarray | None, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        places, shared = _induce(text, rising, runs, seeds, seeds_common, False, wanted, memory)
        falling = ~rising[places]
        # Read backward, a suffix's common prefix is that of the one after it.
        after = np.append(shared[1:], 0)[falling][::-1] if wanted else None
        down, shared = _induce(text, rising, runs, places[falling][::-1], after, True, wanted, memory)
        keep = down != n - 1
        down = np.append(down[keep], n - 1)[::-1]
        return down, np.append([0, 0], shared[keep][:0:-1]).astype(np.int32) if wanted else np.zeros(n, np.int32)

    by_symbol = starts[np.argsort(text[starts], kind="stable")]
    rough = induced(by_symbol, None, 0)[0]
    ordered = rough[is_start[rough]]
    names, kinds = _names(text, starts, ordered)
    if kinds < len(starts):
        inner = _doubled(names) if len(names) <= DIRECT else suffix_order(names, 0, memory)[0]
        ordered = starts[inner]
    shared = None
    if limit:
        shared = np.append(0, _common(text, ordered[:-1], ordered[1:], limit)).astype(np.int32)
    return induced(ordered, shared, limit)
