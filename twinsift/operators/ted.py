"""Tree edit distance with unit costs, exact up to a bound, over post-order arrays; and the UDF that confirms pairs."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame

#: A tree in post-order: each node's label, and the index of the leftmost leaf below it.
Tree = tuple[list[int], list[int]]


def string_distance(a: list[int], b: list[int], bound: int) -> int:
    """Edit distance of two label sequences, or ``bound + 1`` if it is larger."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return min(len(a) + len(b), bound + 1)
    over = bound + 1
    row = [j if j <= bound else over for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - bound), min(len(b), i + bound)
        last, row_low = row[low - 1], over
        row[low - 1] = i if low == 1 and i <= bound else over
        for j in range(low, high + 1):
            here = row[j]
            best = last if x == b[j - 1] else 1 + min(last, here if j < i + bound else over, row[j - 1])
            last, row[j] = here, min(best, over)
            row_low = min(row_low, row[j])
        if high < len(b):
            row[high + 1] = over
        if min(row_low, row[low - 1]) > bound:
            return over
    return row[len(b)]


def mirrored(tree: Tree) -> Tree:
    """The tree with the children of every node in reverse order."""
    labels, leftmost = tree
    n = len(labels)
    kids: list[list[int]] = [[] for _ in range(n)]
    stack: list[int] = []
    for i in range(n):
        own = []
        while stack and stack[-1] >= leftmost[i]:
            own.append(stack.pop())
        kids[i] = own  # already right to left
        stack.append(i)
    out_labels: list[int] = []
    out_left: list[int] = []
    work: list[tuple[int, int, int]] = [(n - 1, 0, 0)] if n else []
    begin = [0] * n
    while work:
        node, k, _ = work.pop()
        if k == 0:
            begin[node] = len(out_labels)
        if k < len(kids[node]):
            work.append((node, k + 1, 0))
            work.append((kids[node][k], 0, 0))
        else:
            out_left.append(begin[node])
            out_labels.append(labels[node])
    return out_labels, out_left


def keyroots(leftmost: list[int]) -> list[int]:
    """The last node of each leftmost leaf, ascending."""
    last: dict[int, int] = {}
    for i, x in enumerate(leftmost):
        last[x] = i
    return sorted(last.values())


def _cost(leftmost: list[int]) -> int:
    return sum(k - leftmost[k] + 1 for k in keyroots(leftmost))


def edit_distance(a: Tree, b: Tree, bound: int | None = None) -> int:
    """Fewest insertions, deletions and relabellings that turn ``a`` into ``b``; ``bound + 1`` if more are needed.

    The size gap and the string distances of the post-order and of the mirrored post-order are lower bounds. The table
    is computed for the child order that costs less, only as wide as the bound, which starts just above the lower bound
    and doubles until it suffices.
    """
    la, lb = len(a[0]), len(b[0])
    limit = la + lb if bound is None else min(bound, la + lb)
    if abs(la - lb) > limit:
        return limit + 1
    if not la or not lb:
        return la + lb
    lower = max(abs(la - lb), string_distance(a[0], b[0], limit))
    if lower > limit:
        return limit + 1
    ma, mb = mirrored(a), mirrored(b)
    lower = max(lower, string_distance(ma[0], mb[0], limit))
    if lower > limit:
        return limit + 1
    if _cost(ma[1]) * _cost(mb[1]) < _cost(a[1]) * _cost(b[1]):
        a, b = ma, mb
    width = min(lower + 8, limit)
    while True:
        found = _banded(a, b, width)
        if found <= width or width >= limit:
            return min(found, limit + 1)
        width = min(width * 2 + 1, limit)


def _banded(a: Tree, b: Tree, band: int) -> int:
    """Zhang and Shasha's recurrence over keyroot pairs, with cells further than ``band`` off the diagonal as too far."""
    al, alm = a
    bl, blm = b
    over = band + 1
    tree: dict[int, dict[int, int]] = {}
    roots_b = keyroots(blm)
    for i in keyroots(alm):
        li = alm[i]
        for j in roots_b:
            lj = blm[j]
            if abs(li - lj) > band:
                continue
            rows, cols = i - li + 2, j - lj + 2
            prior_rows: list[list[int]] = [[min(c, over) for c in range(cols)]]
            for r in range(1, rows):
                x = li + r - 1
                row = [over] * cols
                row[0] = min(r, over)
                left_x = alm[x]
                straight = left_x == li
                above = prior_rows[r - 1]
                skip_row = prior_rows[left_x - li]
                own = tree.setdefault(x, {})
                label = al[x]
                shift = (li + r) - lj
                for c in range(max(1, shift - band), min(cols - 1, shift + band) + 1):
                    y = lj + c - 1
                    best = above[c] if above[c] < row[c - 1] else row[c - 1]
                    best += 1
                    left_y = blm[y]
                    if straight and left_y == lj:
                        other = above[c - 1] + (label != bl[y])
                        if other < best:
                            best = other
                        if best > over:
                            best = over
                        own[y] = best
                    else:
                        other = skip_row[left_y - lj] + own.get(y, over)
                        if other < best:
                            best = other
                        if best > over:
                            best = over
                    row[c] = best
                prior_rows.append(row)
    return tree.get(len(al) - 1, {}).get(len(bl) - 1, over)


def similarity(a: Tree, b: Tree, threshold: float) -> float:
    """``1 - distance / larger size``; below the threshold only known to be below it."""
    larger = max(len(a[0]), len(b[0]))
    if not larger:
        return 1.0
    return 1.0 - edit_distance(a, b, ceil((1 - threshold) * larger - 1e-9)) / larger


def confirm_trees(threshold: float):
    """For ``cluster_units``: pairs with ``labels_a, leftmost_a, labels_b, leftmost_b`` to ``(a, b, similarity)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                similarity((list(la), list(ma)), (list(lb), list(mb)), threshold)
                for la, ma, lb, mb in zip(batch["labels_a"], batch["leftmost_a"], batch["labels_b"], batch["leftmost_b"])
            ]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": out})

    def confirm(pairs: DataFrame) -> DataFrame:
        chosen = pairs.select("a", "b", "labels_a", "leftmost_a", "labels_b", "leftmost_b")
        return chosen.repartition("a", "b").mapInPandas(run, "a bigint, b bigint, similarity double")

    return confirm
