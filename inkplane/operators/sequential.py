"""More operators that decide in order within one page: labels, cells, tables, growth and wrapping.

They work on plain values, so that applyInPandas can run them on a page's rows; boxes are (x, y, w, h).
"""

from __future__ import annotations

from collections import Counter, defaultdict

from inkplane.functions import vocab as V
from inkplane.operators.align import _iou, _lcs

Box = tuple[float, float, float, float]
LABEL_GROUPS = {"account_name": V.ACCOUNT_NAME_LABELS, "bank": V.BANK_LABELS, "account_number": V.ACCOUNT_NUMBER_LABELS}
MUNCH_MARGIN = 0.03


def ratio(a: str, b: str) -> float:
    """Token-sort Indel ratio; 0 if either is blank."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return 2 * _lcs(masks, len(a), b) / (len(a) + len(b))


def as_label(text: str) -> str:
    """Ends trimmed, lower case, look-alike digits as letters unless digits prevail."""
    bare = text.strip(" :.-").lower()
    digits = sum(c.isdigit() for c in bare)
    return bare.translate(str.maketrans(*V.CONFUSIONS)) if digits * 2 <= len(bare) else bare


def label_windows(tokens: list[str], groups: dict[str, tuple[str, ...]] = LABEL_GROUPS, least: float = 0.72, last: int | None = None) -> list[tuple[int, int, str, float]]:
    """(start, stop, group, ratio) of labels in a row, leftmost first and without overlap, the best ratio at each start.

    A window has as many tokens as some label, six at most, and a letter or digit in each. A token of it that is, at
    0.7, a one-word label of another group belongs there; and each token resembles one of the label's at 0.55. Labels
    that start after token ``last`` are not looked for.
    """
    widths = sorted({len(p.split()) for ps in groups.values() for p in ps if len(p.split()) <= 6}, reverse=True)
    words = [as_label(t) for t in tokens]
    single = {g: [p for p in ps if " " not in p] for g, ps in groups.items()}
    out, i = [], 0
    while i < len(words) and (last is None or i <= last):
        best: tuple[float, int, str] | None = None
        for n in widths:
            part = words[i : i + n]
            if len(part) < n or not all(any(c.isalnum() for c in w) for w in part):
                continue
            for g, phrases in groups.items():
                if n > 1 and any(ratio(w, s) >= 0.7 for w in part for h, ss in single.items() if h != g for s in ss):
                    continue
                for p in phrases:
                    r = ratio(" ".join(part), p)
                    if r >= least and all(max(ratio(w, q) for q in p.split()) >= 0.55 for w in part) and (best is None or r > best[0]):
                        best = (r, n, g)
        if best is None:
            i += 1
            continue
        out.append((i, i + best[1], best[2], best[0]))
        i += best[1]
    return out


def munched(windows: list[tuple[str, float]]) -> int:
    """Which of some windows (text, ratio) is taken: the longest within MUNCH_MARGIN of the best, the first on ties."""
    top = max(r for _, r in windows)
    return max((i for i, (_, r) in enumerate(windows) if r >= top - MUNCH_MARGIN), key=lambda i: (len(windows[i][0]), -i))


def _groups(n: int, links) -> list[int]:
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def merged_cells(cells: list[tuple[Box, bool]]) -> list[int]:
    """The group of each cell (box, bordered): unbordered cells of one column join where they nearly touch.

    Columns gather cells, by x, that overlap the column's extent; within one, by y, a gap of half the upper-median
    height, 1 at least, or less joins neighbours.
    """
    free = sorted((i for i, (_, bordered) in enumerate(cells) if not bordered), key=lambda i: cells[i][0][0])
    columns: list[list] = []
    for i in free:
        x, _, w, _ = cells[i][0]
        for c in columns:
            if min(c[1], x + w) > max(c[0], x):
                c[0], c[1] = min(c[0], x), max(c[1], x + w)
                c[2].append(i)
                break
        else:
            columns.append([x, x + w, [i]])
    links = []
    for _, _, members in columns:
        members.sort(key=lambda i: cells[i][0][1])
        heights = sorted(cells[i][0][3] for i in members)
        limit = max(1, 0.5 * heights[len(heights) // 2])
        links += [(a, b) for a, b in zip(members, members[1:]) if cells[b][0][1] - cells[a][0][1] - cells[a][0][3] <= limit]
    return _groups(len(cells), links)


def stitched_rows(rows: list[list[Box]], cells: list[Box]) -> list[int]:
    """The group of each row of words: rows join that support one cell.

    A row supports the cell that 60 % of its words lie in, each by 60 % of its area, if 70 % of its height does too.
    """

    def share(a: Box, b: Box) -> float:
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        return max(w, 0) * max(h, 0) / (a[2] * a[3]) if a[2] * a[3] else 0.0

    by_cell = defaultdict(list)
    for i, row in enumerate(rows):
        homes = []
        for b in row:
            covers = [share(b, c) for c in cells]
            k = max(range(len(cells)), key=lambda j: (covers[j], -j), default=None)
            homes.append(k if k is not None and covers[k] >= 0.6 else None)
        top, bottom = min(b[1] for b in row), max(b[1] + b[3] for b in row)
        for k, n in Counter(h for h in homes if h is not None).items():
            inside = min(bottom, cells[k][1] + cells[k][3]) - max(top, cells[k][1])
            if n >= 0.6 * len(row) and inside >= 0.7 * (bottom - top):
                by_cell[k].append(i)
    return _groups(len(rows), [(a, b) for m in by_cell.values() for a, b in zip(m, m[1:])])


def matched_tables(tables: list[Box], others: list[Box], least: float = 0.3) -> tuple[list[int | None], list[int]]:
    """For each table, in order, the unclaimed table of another reading that overlaps it most; and those left over."""
    claimed: set[int] = set()
    out: list[int | None] = []
    for t in tables:
        scores = [(_iou(t, o), -j) for j, o in enumerate(others) if j not in claimed]
        best = max(scores, default=(0.0, 0))
        out.append(-best[1] if scores and best[0] >= least else None)
        if out[-1] is not None:
            claimed.add(out[-1])
    return out, [j for j in range(len(others)) if j not in claimed]


def wraps(rows: list[Box], digital: bool) -> bool:
    """Whether a span over several rows is covered row by row: always on digital pages, else where the box around it is
    over 1.05 times as wide as its rows together."""
    if len(rows) < 2:
        return False
    around = max(x + w for x, _, w, _ in rows) - min(x for x, *_ in rows)
    return digital or around > 1.05 * sum(w for _, _, w, _ in rows)


def spilled(regions: list[Box], words: list[tuple[Box, str]], is_name, cells: list[Box | None] | None = None) -> list[Box]:
    """Regions grown by name-shaped words beside them, one word after the other; later words meet grown regions.

    A word joins the nearest region to its left or right on the same row within 1.5 of its heights, unless half of it
    is covered already or the region's cell does not hold the word's center.
    """
    regions = list(regions)
    cells = cells or [None] * len(regions)
    for (x, y, w, h), text in words:
        cover = [max(0, min(x + w, r[0] + r[2]) - max(x, r[0])) * max(0, min(y + h, r[1] + r[3]) - max(y, r[1])) / (w * h) for r in regions]
        if not is_name(text) or any(c >= 0.5 for c in cover):
            continue
        near = []
        for k, r in enumerate(regions):
            gap = max(r[0] - x - w, x - r[0] - r[2])
            if min(y + h, r[1] + r[3]) - max(y, r[1]) > 0.5 * min(h, r[3]) and 0 <= gap <= 1.5 * h:
                near.append((gap, k))
        if not near:
            continue
        k = min(near)[1]
        c = cells[k]
        if c is not None and not (c[0] <= x + w / 2 <= c[0] + c[2] and c[1] <= y + h / 2 <= c[1] + c[3]):
            continue
        r = regions[k]
        left, top = min(x, r[0]), min(y, r[1])
        regions[k] = (left, top, max(x + w, r[0] + r[2]) - left, max(y + h, r[1] + r[3]) - top)
    return regions


def reconciled_picture(picture: Box, texts: list[Box], deep: bool, least_area: float) -> Box | None:
    """A picture beside the text boxes on it: kept if a word lies deep inside; dropped if half of it is text or too little
    is left; else cut, one text box after the other, to the largest strip beside it."""
    if deep:
        return picture
    for t in texts:
        x, y, w, h = picture
        ow, oh = min(x + w, t[0] + t[2]) - max(x, t[0]), min(y + h, t[1] + t[3]) - max(y, t[1])
        if ow <= 0 or oh <= 0:
            continue
        if ow * oh >= 0.5 * w * h:
            return None
        strips = [(x, y, w, t[1] - y), (x, t[1] + t[3], w, y + h - t[1] - t[3]), (x, y, t[0] - x, h), (t[0] + t[2], y, x + w - t[0] - t[2], h)]
        strips = [s for s in strips if s[2] > 0 and s[3] > 0]
        if not strips:
            return None
        picture = max(strips, key=lambda s: s[2] * s[3])
        if picture[2] * picture[3] < least_area:
            return None
    return picture
