"""Burrows-Wheeler transforms of shards of strings, merged by interleave refinement.

A shard's transform is built once. Merging reads nothing but the transforms: the rows of all shards are
interleaved by their first characters, and each pass carries the order that holds for ``k`` characters
over to ``k + step``: the rows in their present order, dealt out stably by the ``step`` characters
before them (a counting pass), are the rows that begin with those characters in their new order. Blocks
of one row are settled and are skipped (Holt and McMillan). No suffix is sorted again. The pass that
first tells two neighbours apart gives their common prefix; rows that no pass tells apart form an
interval of repeated strings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """A transform of several strings, each ended by its own mark (0, in the order of the strings).

    symbols: byte before each suffix plus 1, or 0 before a string's first; rows: position of each
    suffix in the concatenation; string and offset of a position follow from begins.
    """

    symbols: np.ndarray
    rows: np.ndarray
    begins: np.ndarray


def build_shard(lengths: np.ndarray, data: np.ndarray, depth: int) -> Shard:
    """lengths: bytes of each string; data: the strings, one after the other. Suffixes in the order of their first ``depth`` bytes at least, then of their end marks.

    Sorted by 7 bytes, then by prefix doubling of what is still open. Equals beyond the depth may come
    in any order: they belong to one interval.
    """
    n = int(lengths.sum()) + len(lengths)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    ends = begins[1:] - 1
    raw = np.zeros(n, np.uint16)
    inner = np.ones(n, bool)
    inner[ends] = False
    raw[inner] = data.astype(np.uint16) + 1
    string = np.repeat(np.arange(len(lengths)), lengths + 1)
    left = ends[string] - np.arange(n)  # bytes before the end mark
    wide = raw.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    k = 7
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[: n - j] = wide[j:]
        part[left < j] = 0
        key = key << np.uint64(9) | part
    rows = np.argsort(key)
    ordered = key[rows]
    starts = np.ones(n, bool)
    starts[1:] = ordered[1:] != ordered[:-1]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[rows] = np.maximum.accumulate(np.where(starts, place, 0))
    at = place
    while k < depth:
        single = starts.copy()
        single[:-1] &= starts[1:]
        at = at[~single[at]]
        if not len(at):
            break
        own = rows[at]
        near = left[own] < k  # the mark lies within what was compared: its string tells
        follow = np.where(near, string[own], rank[np.minimum(own + k, n - 1)] + len(lengths))
        key = rank[own] << 32 | follow
        order = np.argsort(key)
        own, key = own[order], key[order]
        rows[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        starts[at] |= new
        rank[own] = np.maximum.accumulate(np.where(starts[at], at, 0))
        k *= 2
    before = np.zeros(n, np.uint16)
    before[1:] = raw[:-1]
    before[begins[:-1]] = 0
    return Shard(before[rows], rows, begins)


@dataclass
class Merged:
    """rows: shard row (counted through all shards) at each place of the common order; prefixes: characters that a row shares with
    the row before, at least (exact at step 1; ``depth`` where no pass told them apart); passes and moved: passes made and rows moved in them."""

    rows: np.ndarray
    prefixes: np.ndarray
    step: int
    passes: int
    moved: int


def _dense(codes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Codes below size, renumbered in order without gaps."""
    held = np.zeros(size, bool)
    held[codes] = True
    number = np.cumsum(held) - 1
    return number.take(codes), int(number[-1]) + 1


def merge_shards(shards: list[Shard], depth: int, step: int = 4) -> Merged:
    """The common order by ``depth`` characters. step: characters a pass, 1, 2 or 4; lowered where the block holds over 65,536 different ones."""
    follow, first, at = [], [], 0
    for s in shards:
        order = np.argsort(s.symbols, kind="stable")  # the k-th occurrence of a byte is the k-th row that starts with it
        marks = int((s.symbols == 0).sum())
        chars = s.symbols[order]
        order[:marks] = np.arange(marks)  # a mark leads to itself
        follow.append(order + at)
        first.append(chars)
        at += len(order)
    n = at
    jump, grams = {1: np.concatenate(follow)}, {}
    single, size = _dense(np.concatenate(first).astype(np.int64), 258)
    ends = {1: single == 0}
    grams[1] = single.astype(np.uint16)
    while 2 * max(jump) <= min(step, depth) and size * size <= 1 << 27:
        k = max(jump)
        wide, many = _dense(grams[k].astype(np.int64) * size + grams[k].take(jump[k]), size * size)
        if many > 1 << 16:
            break
        size, grams[2 * k] = many, wide.astype(np.uint16)
        jump[2 * k] = jump[k].take(jump[k])
        ends[2 * k] = ends[k].take(jump[k])  # a mark within the characters: no other row has it
    k = width = max(jump)
    rows = np.argsort(grams[k], kind="stable")
    starts = np.ones(n, bool)
    starts[1:] = np.diff(grams[k].take(rows)) != 0
    starts |= ends[k].take(rows)
    prefixes = np.full(n, depth, np.uint8)
    prefixes[starts] = 0
    index = np.arange(n)
    place = np.empty(n, np.int64)
    place[rows] = index
    block = np.maximum.accumulate(np.where(starts, index, 0))
    seen, target = np.zeros(n, bool), np.empty(n, np.int64)
    open_at, passes, moved = index, 0, 0
    while k < depth:
        settled = starts.copy()
        settled[:-1] &= starts[1:]
        open_at = open_at[~settled.take(open_at)]
        if not len(open_at):
            break
        width = max(w for w in jump if w <= min(width, depth - k))
        own = rows.take(open_at)
        source = place.take(jump[width].take(own))
        target[source] = own
        seen[source] = True
        source = np.flatnonzero(seen)  # in the order by k characters
        seen[source] = False
        own = target.take(source)
        order = np.argsort(grams[width].take(own), kind="stable")
        own = own.take(order)
        told, of = block.take(source.take(order)), block.take(place.take(own))
        new = np.ones(len(own), bool)
        new[1:] = (told[1:] != told[:-1]) | (of[1:] != of[:-1])
        fresh = open_at[new & ~starts.take(open_at)]
        prefixes[fresh] = k
        starts[fresh] = True
        rows[open_at] = own
        place[own] = open_at
        block[open_at] = np.maximum.accumulate(np.where(new, open_at, 0))
        passes, moved, k = passes + 1, moved + len(own), k + width
    return Merged(rows, prefixes, max(jump), passes, moved)


def common_prefixes(merged: Merged, strings: list[bytes], string: np.ndarray, offset: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each place with the place before, at most ``depth``; the passes leave at most step - 1 characters to look at. string, offset: of each place."""
    out = merged.prefixes.astype(np.int64)
    for i in range(1, len(out)):
        a, b = strings[string[i - 1]][offset[i - 1] :], strings[string[i]][offset[i] :]
        while out[i] < min(depth, len(a), len(b)) and a[out[i]] == b[out[i]]:
            out[i] += 1
    return out


def interval_minima(lengths: np.ndarray, data: np.ndarray, shard: np.ndarray, values: np.ndarray, window: int, step: int = 4) -> np.ndarray:
    """For each window of each string, in order, the least of ``values`` among the strings that hold the window.

    lengths, data: the strings, one after the other; shard: the shard that each string belongs to. The
    repeated intervals are the runs of rows whose common prefixes reach the window.
    """
    begins = np.concatenate([[0], np.cumsum(lengths)])
    shards, string, offset = [], [], []
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        n = lengths[own]
        at = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        built = build_shard(n, data.take(at), window)
        of = np.searchsorted(built.begins, built.rows, side="right") - 1
        shards.append(built)
        string.append(own[of])
        offset.append(built.rows - built.begins[of])
    merged = merge_shards(shards, window, step)
    string, offset = np.concatenate(string).take(merged.rows), np.concatenate(offset).take(merged.rows)
    whole = offset + window <= lengths[string]
    starts = np.flatnonzero(merged.prefixes < window)
    least = np.minimum.reduceat(np.where(whole, values[string], np.iinfo(np.int64).max), starts)
    value = np.repeat(least, np.diff(np.append(starts, len(string))))
    many = np.maximum(lengths - window + 1, 0)
    out = np.empty(int(many.sum()), np.int64)
    out[(np.cumsum(many) - many)[string[whole]] + offset[whole]] = value[whole]
    return out
