"""Shortest edit scripts on arrays of token codes, by divide and conquer.

Searches from both ends meet on a shortest script after about half its edits each; the meeting point cuts the pair in
two, and so on until one side of a part is empty. Memory grows with the length of the arrays only.
"""

from __future__ import annotations

import re
from array import array

import numpy as np


def _advance(a: np.ndarray, b: np.ndarray, reach: np.ndarray, origin: int, d: int) -> np.ndarray:
    """The furthest x on every diagonal -d, -d+2, …, d, given the reach after d-1 edits; updates `reach`."""
    k = np.arange(-d, d + 1, 2)
    below, above = reach[origin + k - 1], reach[origin + k + 1]
    down = below < above
    down[0] = True
    if d > 0:
        down[-1] = False
    x = np.where(down, above, below + 1)
    y = x - k
    live = np.flatnonzero((x < len(a)) & (y < len(b)) & (y >= 0))
    while live.size:
        live = live[a[x[live]] == b[y[live]]]
        x[live] += 1
        y[live] += 1
        live = live[(x[live] < len(a)) & (y[live] < len(b))]
    reach[origin + k] = x
    return x


def _meeting(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A point inside the grid on a shortest path; the arrays differ in their first and in their last token."""
    n, m = len(a), len(b)
    origin, shift = n + m + 2, n - m
    forth, back = np.full(2 * origin + 1, -1, np.int64), np.full(2 * origin + 1, -1, np.int64)
    forth[origin + 1] = back[origin + 1] = 0
    for d in range(n + m + 1):
        for own, other, ends in ((forth, back, False), (back, forth, True)):
            x = _advance(a[::-1] if ends else a, b[::-1] if ends else b, own, origin, d)
            if (shift % 2 == 0) != ends:
                continue  # paths of these lengths cannot meet on one diagonal
            k = np.arange(-d, d + 1, 2)
            facing = shift - k  # the same diagonal, counted from the other corner
            done = d if ends else d - 1
            seen = np.abs(facing) <= done
            inside = (x <= n) & (x - k <= m) & (x - k >= 0)
            met = np.flatnonzero(seen & inside & (x + other[origin + np.where(seen, facing, 0)] >= n))
            if met.size:
                at, diagonal = int(x[met[0]]), int(k[met[0]])
                return (n - at, m - (at - diagonal)) if ends else (at, at - diagonal)
    raise AssertionError("two paths always meet")


def edit_script(a: np.ndarray, b: np.ndarray) -> list[tuple[str, int, int]]:
    """('=', i, j) kept, ('-', i, j) deleted and ('+', i, j) inserted, in order."""
    out: list[tuple[str, int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i, to_i, j, to_j = parts.pop()
        while i < to_i and j < to_j and a[i] == b[j]:
            out.append(("=", i, j))
            i, j = i + 1, j + 1
        same = 0
        while i < to_i - same and j < to_j - same and a[to_i - 1 - same] == b[to_j - 1 - same]:
            same += 1
        if same:
            # The equal end comes after what is still between.
            parts.append((to_i - same, to_i, to_j - same, to_j))
            parts.append((i, to_i - same, j, to_j - same))
            continue
        if i == to_i or j == to_j or not np.isin(a[i:to_i], b[j:to_j]).any():
            out += [("-", k, j) for k in range(i, to_i)]
            out += [("+", to_i, k) for k in range(j, to_j)]
            continue
        x, y = _meeting(a[i:to_i], b[j:to_j])
        parts.append((i + x, to_i, j + y, to_j))
        parts.append((i, i + x, j, j + y))
    return out


# Parts of so many cells are worked out as a table.
TABLE = 1 << 12


def _by_table(a: list, b: list) -> list[tuple[str, int, int]]:
    n, m = len(a), len(b)
    left = [[0] * (m + 1) for _ in range(n + 1)]  # tokens kept from here on
    for i in range(n - 1, -1, -1):
        row, under = left[i], left[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = under[j + 1] + 1 if a[i] == b[j] else max(under[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(("=", i, j))
            i, j = i + 1, j + 1
        elif left[i + 1][j] >= left[i][j + 1]:
            out.append(("-", i, j))
            i += 1
        else:
            out.append(("+", i, j))
            j += 1
    return out + [("-", k, j) for k in range(i, n)] + [("+", n, k) for k in range(j, m)]


# Scripts of so many edits are found step by step, with a number for each diagonal after each edit: 67 MB at most.
FEW = 4096


def _by_steps(a: list, b: list) -> str | None:
    """The letters of a shortest script if it has at most FEW edits: the furthest x on every diagonal after each edit, and the way back."""
    n, m = len(a), len(b)
    origin = min(n + m, FEW) + 2
    reach, before = [-1] * (2 * origin + 1), []  # -1: no way there inside the grid
    reach[origin + 1] = 0
    for d in range(origin - 1):
        for k in range(-d, d + 1, 2):
            x, right = reach[origin + k + 1], reach[origin + k - 1]  # from the diagonals above, by an insertion, and below
            if x - k > m:
                x = -1
            if -1 < right < n and x <= right:
                x = right + 1
            if x >= 0:
                y = x - k
                while x < n and y < m and a[x] == b[y]:
                    x, y = x + 1, y + 1
            reach[origin + k] = x
        if abs(n - m) <= d and reach[origin + n - m] == n and (n - m - d) % 2 == 0:
            break
        before.append(array("i", reach[origin - d - 2 : origin + d + 3]))
    else:
        return None
    out, x, k = [], n, n - m
    while d:
        d -= 1
        at, right = before[d][k + d + 3], before[d][k + d + 1]
        at = -1 if at - k > m else at
        if -1 < right < n and at <= right:
            out.append("=" * (x - right - 1) + "-")
            x, k = right, k - 1
        else:
            out.append("=" * (x - at) + "+")
            x, k = at, k + 1
    # Every part was put down from its end on.
    return ("".join(out) + "=" * x)[::-1]


def _letters(a: list, b: list) -> str:
    """The letters of a shortest script of lists that differ in their first and in their last token."""
    if not a or not b or set(a).isdisjoint(b):
        return "-" * len(a) + "+" * len(b)
    letters = _by_steps(a, b)
    if letters is None and len(a) * len(b) <= TABLE:
        letters = "".join(step[0] for step in _by_table(a, b))
    if letters is None:
        codes = {t: k for k, t in enumerate(dict.fromkeys(a + b))}
        letters = "".join(step[0] for step in edit_script(np.array([codes[t] for t in a]), np.array([codes[t] for t in b])))
    return letters


def gap_runs(a: list, b: list) -> list[tuple[str, int, int, int]]:
    """A shortest script between two lists of tokens as runs (op, i, j, how many), deletions first between kept tokens."""
    head, tail, most = 0, 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [("=", 0, 0, head)] if head else []
    i = j = head
    for part in re.findall("=+|[-+]+", _letters(a[head : len(a) - tail], b[head : len(b) - tail])):
        gone, come = (0, 0) if part[0] == "=" else (part.count("-"), part.count("+"))
        if part[0] == "=":
            out.append(("=", i, j, len(part)))
            i, j = i + len(part), j + len(part)
        if gone:
            out.append(("-", i, j, gone))
            i += gone
        if come:
            out.append(("+", i, j, come))
            j += come
    return out + ([("=", i, j, tail)] if tail else [])


def gap_script(a: list, b: list) -> list[tuple[str, int, int]]:
    """A shortest script between two lists of tokens, deletions first between kept tokens."""
    return [(op, i + (k if op != "+" else 0), j + (k if op != "-" else 0)) for op, i, j, n in gap_runs(a, b) for k in range(n)]
