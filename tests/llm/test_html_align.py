"""The matching of skeletons of any size against the plain table."""

import random

from ledgerline.llm.html_extract import _aligned


def plain(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal labels in order, by the whole table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y))
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs


def test_large_pages_are_matched_as_small_ones():
    draw = random.Random(6)
    for n in (30, 800):  # 800 children a side were over the limit of before, which paired them from both ends
        a, b = ([f"p.{draw.randrange(9)}" for _ in range(n)] for _ in range(2))
        want = [0] + [-1] * n
        for i, j in plain(a, b):
            want[i + 1] = j + 1
        assert _aligned("\n".join(["0 #", *[f"0 {x}" for x in a]]), "\n".join(["0 #", *[f"0 {x}" for x in b]])) == want
