"""Operators that decide in order: each decision depends on those before, within one page."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

ALIGNED = "page_id long, cluster int, text string, x int, y int, w int, h int, conf double, agreement double, engines string"


#: Width of the strips in which overlapping boxes are looked for.
BAND = 200


def _iou(a, b) -> float:
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def align_page(words: pd.DataFrame, least: float = 0.5, prefer: str = "tesseract") -> pd.DataFrame:
    """Readings of one page by several engines, joined into words.

    In the order of y, x and input, a reading joins the first cluster whose first member it overlaps enough, unless the
    box around both is wider than 1.5 upper-median widths; else it opens a cluster. A cluster's text is its most
    frequent one: on ties that of the preferred engine if it has exactly one of them, else that of highest confidence.
    Only clusters that start above a reading's lower edge and end below its upper edge, in the BAND px wide strips that
    the reading touches, are looked at.
    """
    words = words.sort_values("seq", kind="stable")
    total = words["engine"].nunique()
    cap = int(1.5 * np.sort(words["w"].to_numpy())[len(words) // 2])
    clusters: list[list] = []
    strips: dict[int, list[int]] = {}  # clusters whose first member may still be reached from below, by strip
    for r in words.sort_values(["y", "x"], kind="stable").itertuples():
        b = (r.x, r.y, r.w, r.h)
        mine = range(int(r.x // BAND), int((r.x + r.w) // BAND) + 1)
        for s in mine:
            strips[s] = [k for k in strips.get(s, ()) if clusters[k][0].y + clusters[k][0].h > r.y]
        for k in sorted({k for s in mine for k in strips[s]}):
            f = clusters[k][0]
            if _iou(b, (f.x, f.y, f.w, f.h)) >= least and max(r.x + r.w, f.x + f.w) - min(r.x, f.x) <= cap:
                clusters[k].append(r)
                break
        else:
            for s in mine:
                strips[s].append(len(clusters))
            clusters.append([r])
    out = []
    for k, rs in enumerate(clusters):
        votes: dict[str, int] = {}
        for r in rs:
            votes[r.text.strip()] = votes.get(r.text.strip(), 0) + 1
        tied = [t for t, n in votes.items() if n == max(votes.values())]
        mine = [t for t in dict.fromkeys(r.text.strip() for r in rs if r.engine == prefer) if t in tied]
        text = tied[0] if len(tied) == 1 else mine[0] if len(mine) == 1 else max((r for r in rs if r.text.strip() in tied), key=lambda r: r.conf).text.strip()
        x, y = min(r.x for r in rs), min(r.y for r in rs)
        engines = list(dict.fromkeys(r.engine for r in rs))
        out.append((rs[0].page_id, k, text, x, y, max(r.x + r.w for r in rs) - x, max(r.y + r.h for r in rs) - y, sum(r.conf for r in rs) / len(rs), len(engines) / total, "+".join(sorted(engines))))
    return pd.DataFrame(out, columns=[c.split()[0] for c in ALIGNED.split(", ")])


#: Rounds in which clusters are opened side by side; what is left then, in places where many boxes overlap, goes one by one.
ROUNDS = 32


def _leaders(x, y, w, h, cap: int, least: float) -> np.ndarray:
    """For each of some readings in order, the first member of the cluster that it joins, as ``align_page`` has it.

    Readings are parted where no box reaches across. A part's first reading opens a cluster, which takes all that fit;
    the first of those left opens the next one, in all parts at once.
    """
    n = len(x)
    out, right, bottom = np.arange(n), x + w, y + h
    band = np.cumsum(np.concatenate(([0], y[1:] >= np.maximum.accumulate(bottom)[:-1]))) if n else out
    by_x = np.lexsort((x, band))
    shift = band[by_x] * (max(right.max(), x.max()) - x.min() + 1) if n else out
    edge = np.maximum.accumulate(np.maximum(right, x)[by_x] + shift)
    part = np.empty(n, np.int64)
    part[by_x] = np.cumsum(np.concatenate(([0], (x[by_x] + shift)[1:] >= edge[:-1]))) if n else out
    left = np.argsort(part, kind="stable")

    def fits(i, j):
        wide, high = np.minimum(right[i], right[j]) - np.maximum(x[i], x[j]), np.minimum(bottom[i], bottom[j]) - np.maximum(y[i], y[j])
        both = np.maximum(wide, 0) * np.maximum(high, 0)
        area = w[i] * h[i] + w[j] * h[j] - both
        return (both > 0) & (both / np.where(both > 0, area, 1) >= least) & (np.maximum(right[i], right[j]) - np.minimum(x[i], x[j]) <= cap)

    for _ in range(ROUNDS):
        if not len(left):
            return out
        first = np.concatenate(([True], part[left][1:] != part[left][:-1]))
        lead = left[first][np.cumsum(first) - 1]
        taken = first | fits(left, lead)
        out[left[taken]] = lead[taken]
        left = left[~taken]
    strips: dict[int, list[int]] = {}  # clusters whose first member may still be reached from below, by strip
    for i in np.sort(left).tolist():
        mine = range(int(x[i] // BAND), int(right[i] // BAND) + 1)
        for s in mine:
            strips[s] = [k for k in strips.get(s, ()) if bottom[k] > y[i]]
        near = np.array(sorted({k for s in mine for k in strips[s]}), np.int64)
        ok = near[fits(near, i)]
        if len(ok):
            out[i] = ok[0]
            continue
        for s in mine:
            strips[s].append(i)
    return out


def align_columns(page: pa.Table, least: float = 0.5, prefer: str = "tesseract") -> pa.Table:
    """``align_page`` over whole columns: only texts that differ within a cluster are looked at one by one."""
    names, kinds = zip(*(c.split() for c in ALIGNED.split(", ")), strict=True)
    schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[k]) for c, k in zip(names, kinds, strict=True)])
    engines = page["engine"].combine_chunks().dictionary_encode()
    plain = not any(c.null_count for c in page.columns) and all(pa.types.is_integer(page.schema.field(c).type) for c in ("seq", *"xywh"))
    if not plain or not least > 0 or not 0 < len(engines.dictionary) < 63 or not page.num_rows:
        return pa.Table.from_pandas(align_page(page.to_pandas(), least, prefer), schema, preserve_index=False)
    seq, x, y, w, h = (page[c].to_numpy().astype(np.int64) for c in ("seq", *"xywh"))
    cap = int(1.5 * np.sort(w)[len(w) // 2])
    order = np.lexsort((seq, x, y))
    lead = _leaders(x[order], y[order], w[order], h[order], cap, least)
    order = order[np.argsort(lead, kind="stable")]
    lead = np.sort(lead)
    at = np.flatnonzero(np.concatenate(([True], lead[1:] != lead[:-1])))
    size = np.diff(np.append(at, len(lead)))
    x, y, right, bottom, conf = x[order], y[order], (x + w)[order], (y + h)[order], page["conf"].to_numpy().astype(float)[order]
    texts = page["text"].combine_chunks().dictionary_encode()
    stripped = [t.strip() for t in texts.dictionary.to_pylist()]
    known = {t: k for k, t in enumerate(dict.fromkeys(stripped))}
    text = np.array([known[t] for t in stripped], np.int64)[texts.indices.to_numpy()][order]
    engine = engines.indices.to_numpy().astype(np.int64)[order]
    chosen = text[at].copy()
    readers = engines.dictionary.to_pylist()
    best = readers.index(prefer) if prefer in readers else -1
    differ = np.minimum.reduceat(text, at) != np.maximum.reduceat(text, at)
    a, b, c = (text[np.minimum(at + i, len(text) - 1)] for i in range(3))
    two = (size == 3) & ((a == b) | (a == c) | (b == c))  # two of three readings agree
    chosen[two & (b == c)] = b[two & (b == c)]
    for k in np.flatnonzero(differ & ~two).tolist():
        rows = range(at[k], at[k] + size[k])
        votes: dict[int, int] = {}
        for i in rows:
            votes[text[i]] = votes.get(text[i], 0) + 1
        most = max(votes.values())
        tied = [t for t, n in votes.items() if n == most]
        mine = [t for t in dict.fromkeys(text[i] for i in rows if engine[i] == best) if t in tied]
        chosen[k] = tied[0] if len(tied) == 1 else mine[0] if len(mine) == 1 else text[max((i for i in rows if text[i] in tied), key=lambda i: conf[i])]
    masks, which = np.unique(np.bitwise_or.reduceat(np.int64(1) << engine, at), return_inverse=True)
    sets = pa.array(["+".join(sorted(r for k, r in enumerate(readers) if m >> k & 1)) for m in masks.tolist()])
    x0, y0 = np.minimum.reduceat(x, at), np.minimum.reduceat(y, at)
    columns = [
        pa.repeat(page["page_id"][0], len(at)), np.arange(len(at)), pa.array(list(known)).take(pa.array(chosen)), x0, y0, np.maximum.reduceat(right, at) - x0, np.maximum.reduceat(bottom, at) - y0,
        np.add.reduceat(conf, at) / size, np.bitwise_count(masks)[which] / len(readers), sets.take(pa.array(which)),
    ]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def align(words: DataFrame, readings: str | None = None) -> DataFrame:
    """ALIGNED of words(page_id, engine, seq, text, x, y, w, h, conf); a page is a task's unit.

    With ``readings``, all but page_id stand in that column, an array of structs, which spares a row for each of them.
    """

    def page(rows: pa.Table) -> pa.Table:
        if readings is not None:
            lists = rows[readings].combine_chunks()
            flat = pa.Table.from_batches([pa.RecordBatch.from_struct_array(lists.flatten())])
            rows = flat.append_column("page_id", pa.repeat(rows["page_id"][0], flat.num_rows))
        return align_columns(rows)

    return words.groupBy("page_id").applyInArrow(page, ALIGNED)


def row_clusters(words: pd.DataFrame) -> list[list[int]]:
    """Rows of words (columns x, y, w, h) as lists of places, by overlap of heights capped at 1.5 upper medians."""
    heights = np.sort(words["h"][words["h"] > 0].to_numpy())
    median = float(heights[len(heights) // 2]) if len(heights) else 1.0
    rows: list[list] = []  # top, bottom, members
    for i, y, h in sorted(zip(range(len(words)), words["y"], words["h"], strict=True), key=lambda t: (t[1], words["x"].iloc[t[0]])):
        bottom = y + min(h, 1.5 * median)
        for r in rows:
            if min(bottom, r[1]) - max(y, r[0]) > 0.5 * min(r[1] - r[0], bottom - y, median):
                r[0], r[1] = min(r[0], y), max(r[1], bottom)
                r[2].append(i)
                break
        else:
            rows.append([y, bottom, [i]])
    return [r[2] for r in sorted(rows, key=lambda r: r[0])]


def _lcs(masks: dict[str, int], n: int, text: str) -> int:
    v = full = (1 << n) - 1
    for ch in text:
        m = masks.get(ch, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    return n - v.bit_count()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def lowered(text: str) -> str:
    """Lower case, character by character where it would change the text's length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def fuzzy_spans(text: str, term: str, least: float = 0.9, rounds: int = 10, starts: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(start, stop, ratio) of places that read almost like a term of eight characters or more.

    In each round the window of the term's length with the highest ratio, the first on ties, is taken if it reaches
    ``least``; cut inward to word boundaries; kept if its length is within 30 % of the term's; and masked in any case.
    ``starts``, if given, are the windows to look at, in order: all that may reach ``least``.
    """
    low, want, out = lowered(text), lowered(term), []
    n = len(want)
    if n < 8 or not low:
        return out
    masks: dict[str, int] = {}
    for i, ch in enumerate(want):
        masks[ch] = masks.get(ch, 0) | 1 << i
    page = list(low)
    size, cache = min(n, len(page)), {}
    places = range(len(page) - size + 1) if starts is None else starts.tolist()
    for _ in range(rounds):
        best, at = 0.0, -1
        for i in places:
            if i not in cache:
                # Characters in common bound the ratio from above, so most windows are passed over.
                window = page[i : i + size]
                bound = 2 * sum(ch in masks for ch in window) / (n + size)
                cache[i] = 2 * _lcs(masks, n, "".join(window)) / (n + size) if bound >= least else 0.0
            if cache[i] > best:
                best, at = cache[i], i
        if at < 0 or best < least:
            break
        start, stop = at, at + size
        while start < stop and start > 0 and text[start - 1].isalnum() and text[start].isalnum():
            start += 1
        while stop > start and stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum():
            stop -= 1
        if stop > start and abs(stop - start - n) / n <= 0.3:
            out.append((start, stop, best))
        for i in range(at, at + size):
            page[i] = "\0"
        for i in range(max(0, at - size + 1), at + size):
            cache.pop(i, None)
    return out


#: Characters of text looked at in one pass, longest part of a piece that is looked up, signs told apart, anchors met at once.
BLOCK, GRAM, SIGNS, MET_AT_ONCE, TERMS_AT_ONCE = 1 << 18, 6, 128, 1 << 20, 20_000


class _Pieces:
    """Terms cut into pieces, each looked up by a hash of its first characters; hashes that coincide only add places."""

    def __init__(self, signs: np.ndarray, cuts: list[tuple[int, np.ndarray, int]]):
        found: dict[int, list[tuple[int, int, int]]] = {}
        self.bits = max(18, (64 * sum(parts for _, _, parts in cuts)).bit_length())
        for k, codes, parts in cuts:
            edges = [i * len(codes) // parts for i in range(parts + 1)]
            for a, b in zip(edges, edges[1:]):
                size = min(b - a, GRAM)
                for h in self._hashes(signs[codes[a : a + size]], size):
                    pass
                found.setdefault(size, []).append((int(self._slots(h)[0]), k, a))
        self.grams = {}
        for size, rows in sorted(found.items()):
            slot, term, at = np.array(sorted(rows)).T
            slots, first, count = np.unique(slot, return_index=True, return_counts=True)
            known = np.zeros(1 << self.bits, bool)
            known[slots] = True
            self.grams[size] = known, slots, first, count, term, at

    @staticmethod
    def _hashes(text: np.ndarray, longest: int):
        """Hashes of the first 1, 2, ... characters from each place on."""
        text = text.astype(np.uint32)
        h = text
        for size in range(1, longest + 1):
            if size > 1:
                h = h[:-1] * np.uint32(0x01000193) + text[size - 1 :]
            yield h

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return h * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)

    def met(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, term, place in the term) of pieces met in a text of signs, some at a time."""
        for block in range(0, len(text), BLOCK) if self.grams else ():
            for size, h in enumerate(self._hashes(text[block : block + BLOCK + GRAM - 1], max(self.grams)), 1):
                if size not in self.grams:
                    continue
                known, slots, first, count, term, at = self.grams[size]
                slot = self._slots(h[:BLOCK])
                places = np.flatnonzero(known[slot])
                which = np.searchsorted(slots, slot[places])
                ends = np.cumsum(count[which])
                start = 0
                while start < len(places):
                    done = ends[start - 1] if start else 0
                    stop = max(int(np.searchsorted(ends, done + MET_AT_ONCE, "right")), start + 1)
                    n = count[which[start:stop]]
                    rows = np.repeat(first[which[start:stop]] - (ends[start:stop] - n - done), n) + np.arange(ends[stop - 1] - done)
                    yield np.repeat(places[start:stop] + block, n), term[rows], at[rows]
                    start = stop


class TermIndex:
    """Finds the windows of texts that may read like a term, for many terms in one pass over the texts.

    A window of a term's length n and of ratio ``least`` or more lacks d = (1 - least) * n of the term's characters at
    most and has as many others, so of 2d + 1 pieces of the term one stands in it whole, moved by d at most. Around
    each piece met, the characters in common, in order, of the term and of all windows it may belong to are counted,
    for many places at once; the windows are candidates if these are n - d or more. None is lost: characters that share
    a sign, and those of neighbouring texts, only add candidates. Shorter texts are one window, found likewise. Terms
    whose pieces would be of one character, as ``least`` is low, are candidates everywhere.
    """

    def __init__(self, terms: list[str], least: float = 0.9):
        self.least, self.terms, self.everywhere = least, [lowered(t) for t in terms], []
        codes = [_codes(t) for t in self.terms]
        self.size = np.array([len(c) for c in codes], np.int64)
        self.lost = ((1 - least) * self.size + 1e-9).astype(np.int64)
        seen, count = np.unique(np.concatenate([np.empty(0, np.uint32), *codes]), return_counts=True)
        self.sign = np.zeros(sys.maxunicode + 1, np.uint8)  # of characters that no term has: 0
        self.sign[seen[np.argsort(-count, kind="stable")]] = 1 + np.arange(len(seen)) % (SIGNS - 1)
        self.masks = np.zeros(len(terms) * SIGNS, np.uint64)
        windows, wholes = [], []
        for k, c in enumerate(codes):
            if len(c) < 8:
                continue
            np.bitwise_or.at(self.masks, k * SIGNS + self.sign[c[:64]].astype(np.int64), np.uint64(1) << np.arange(len(c[:64]), dtype=np.uint64))
            parts, edits = 2 * int(self.lost[k]) + 1, int((1 - least) * (2 * len(c) - 1) + 1e-9)
            if len(c) < 2 * max(parts, edits + 1):
                self.everywhere.append(k)
            else:
                windows.append((k, c, parts))
                wholes.append((k, c, edits + 1))
        self.windows, self.wholes = _Pieces(self.sign, windows), _Pieces(self.sign, wholes)
        self.longest = max([0, *self.size.tolist()])

    def _alike(self, text: np.ndarray, first: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Which places ``first`` in a text of signs begin a stretch that may hold a window like the term k."""
        ok = np.zeros(len(k), bool)
        for n in np.unique(self.size[k]).tolist():
            mine = np.flatnonzero(self.size[k] == n)
            d, held = int(self.lost[k[mine[0]]]), min(n, 64)
            steps = min(n + 2 * d, held + 3 * d) if n > 64 else n + 2 * d
            half = held // 2  # the term's first half stands in the first half + 3d characters
            row, at = k[mine] * SIGNS, first[mine]
            v = np.full(len(mine), 2**64 - 1, np.uint64)
            for s in range(steps):
                m = v & self.masks[row + text[at + s]]
                v = v + m | v ^ m
                if s + 1 == half + 3 * d < steps:
                    kept = np.bitwise_count(~v & np.uint64((1 << half) - 1)) >= half - d
                    mine, row, at, v = mine[kept], row[kept], at[kept], v[kept]
            ok[mine[64 - np.bitwise_count(v).astype(np.int64) >= held - d]] = True
        return ok

    def _signs(self, lows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The signs of all texts, sign 0 between and around them; where each begins; and their lengths."""
        length = np.array([len(t) for t in lows], np.int64)
        pad = 2 * self.longest + 2 * int(self.lost.max(initial=0)) + GRAM
        begin = pad + np.cumsum(length + 1) - length - 1
        signs = np.zeros(int((length + 1).sum()) + 2 * pad, np.uint8)
        signs[pad : len(signs) - pad] = self.sign[_codes("\0".join([*lows, ""]))]
        signs[begin + length] = 0
        return signs, begin, length

    def starts(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, term, first characters of the candidate windows, ascending) for each term that may stand in a text."""
        lows = [lowered(t) for t in texts]
        signs, begin, length = self._signs(lows)
        for i in np.flatnonzero(length).tolist() if self.everywhere else ():
            for k in self.everywhere:
                yield i, k, np.arange(max(length[i] - self.size[k], 0) + 1)
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for place, k, at in self.windows.met(signs):
            row = np.searchsorted(begin, place, "right") - 1
            kept = np.flatnonzero((signs[place] > 0) & (length[row] >= self.size[k]))
            place, k, at, row = place[kept], k[kept], at[kept], row[kept]
            first = place - at - self.lost[k]
            kept = self._alike(signs, first, k)
            for i, t, f in zip(row[kept].tolist(), k[kept].tolist(), (first - begin[row])[kept].tolist()):
                n, d = int(self.size[t]), int(self.lost[t])
                found.setdefault((i, t), []).append(np.arange(max(f, 0), min(f + 2 * d, int(length[i]) - n) + 1))
        short = np.flatnonzero((length > 0) & (length < self.longest))
        signs, begin, length = self._signs([lows[i] for i in short.tolist()])
        for place, k, _ in self.wholes.met(signs):
            row = np.searchsorted(begin, place, "right") - 1
            # The shorter of the two has all characters in common, at most.
            kept = (signs[place] > 0) & (self.size[k] > length[row]) & (2 * length[row] >= self.least * (self.size[k] + length[row]) - 1e-9)
            found.update({(i, t): [np.zeros(1, np.int64)] for i, t in zip(short[row[kept]].tolist(), k[kept].tolist())})
        for (i, t), places in sorted(found.items()):
            if len(places := np.unique(np.concatenate(places))):
                yield i, t, places


def fuzzy_terms(docs: DataFrame, terms: DataFrame, least: float = 0.9) -> DataFrame:
    """(doc_id, item_id, start, stop, ratio) of places in docs(doc_id, text) that read almost like terms(item_id, term).

    Texts are scanned once for every TERMS_AT_ONCE distinct terms, which bounds what is shipped to the tasks. Null and
    empty texts and terms, and terms below eight characters, are found nowhere.
    """
    spark, out = docs.sparkSession, None
    distinct = [r.term for r in terms.filter("term IS NOT NULL").select("term").distinct().orderBy("term").toLocalIterator()]
    for k in range(0, max(len(distinct), 1), TERMS_AT_ONCE):
        index = spark.sparkContext.broadcast(TermIndex(distinct[k : k + TERMS_AT_ONCE], least))
        found = docs.mapInPandas(_scan(index, distinct[k : k + TERMS_AT_ONCE], least), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, start int, stop int, ratio double")
        out = found if out is None else out.unionByName(found)
    return out.join(terms.select("item_id", "term"), "term").select("doc_id", "item_id", "start", "stop", "ratio")


def _stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of the texts that hold BLOCK characters at most, but for longer ones."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) >= BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _scan(index, terms: list[str], least: float):
    def scan(batches):
        for batch in batches:
            rows, texts = [], [t or "" for t in batch["text"]]
            for first, last in _stretches(texts):
                for i, k, starts in index.value.starts(texts[first:last]):
                    rows += [(first + i, terms[k], a, b, r) for a, b, r in fuzzy_spans(texts[first + i], terms[k], least, starts=starts)]
            at = [r[0] for r in rows]
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at].to_numpy(), "term": [r[1] for r in rows], "start": [r[2] for r in rows], "stop": [r[3] for r in rows], "ratio": [r[4] for r in rows]})

    return scan
