"""Which numbers of short pages prove each other, for many pages at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# All amounts are whole ten-thousandths, below 10^16. Two cents; percentages; pages and triples of
# numbers that are worked on at a time.
_CENTS, _PERCENTAGES = 200, (500, 700, 1000, 1200, 1500, 1700, 1800, 2000)
_PAGES, _TRIPLES, _BITS = 1000, 1 << 21, np.uint64(54)
KINDS = ("product", "sum", "near", "column sum", "ratio sum", "percentage")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _pairs(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place with each later one before its end."""
    at = np.arange(len(ends))
    return np.repeat(at, ends - at - 1), _ranges(at + 1, ends - at - 1)


def _distinct(keys: list[np.ndarray], first: np.ndarray | None = None, size: np.ndarray | None = None, values: np.ndarray | None = None) -> np.ndarray:
    """Places of the distinct findings: equal in all keys, and in the values from first on where these are given."""
    order = np.lexsort(keys)
    if not len(order):
        return order
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    keep = np.concatenate([[True], ~same])
    if first is not None and same.any():
        known: set[tuple] = set()
        for at in np.flatnonzero(np.concatenate([same, [False]]) | ~keep).tolist():
            if keep[at]:
                known = set()
            terms = tuple(values[first[order[at]] : first[order[at]] + size[order[at]]].tolist())
            keep[at] = terms not in known
            known.add(terms)
    return np.sort(order[keep])


class Proofs:
    """Findings of a chunk of pages.

    value, page, line: the numbers, ordered by page, row and place; page counts from 0; line numbers the rows of a page
    in their order, and is -1 where the row is null (such numbers belong to the page only).
    found: (kind, page, line or -1, first term, terms, total, delta) arrays, terms as places in `terms`.
    proven: for each number whether a finding (near ones apart) has its value.
    """

    def __init__(self, value: np.ndarray, page: np.ndarray, line: np.ndarray):
        self.found: list[tuple] = []
        self.pools, self.pooled = [value], len(value)
        # Distinct numbers of each page, in their order.
        order = np.lexsort((value, page))
        fresh = np.concatenate([[True], (np.diff(value[order]) != 0) | (np.diff(page[order]) != 0)])
        self.code = np.empty(len(value), np.int64)
        self.code[order] = np.cumsum(fresh) - 1
        self.own, self.of_page = value[order][fresh], page[order][fresh]
        self.arith = np.zeros(len(self.own), bool)
        self.above = np.flatnonzero(self.own > 0)
        self.keys = (self.of_page[self.above].astype(np.uint64) << _BITS) + self.own[self.above].astype(np.uint64)
        self._columns(page, *self._rows(value, page, line))
        self._ratios()
        self.proven = self.arith[self.code]

    def _add(self, kind: int, page: np.ndarray, line: np.ndarray, first: np.ndarray, size: np.ndarray, total: np.ndarray, delta: np.ndarray | None = None) -> None:
        self.found.append((np.full(len(page), kind), page, line, first, size, total, np.zeros(len(page), np.int64) if delta is None else delta))

    def _pool(self, *terms: np.ndarray) -> np.ndarray:
        """The first place of each finding's terms, which are put behind the others."""
        self.pools.append(np.stack(terms, 1).ravel())
        first = self.pooled + np.arange(len(terms[0])) * len(terms)
        self.pooled += len(self.pools[-1])
        return first

    def _met(self, page: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, distinct number): the page's positive numbers from low to high."""
        some = np.flatnonzero((low < 1 << 54) & (high > 0))
        base = page[some].astype(np.uint64) << _BITS
        least, most = base + np.maximum(low[some], 1).astype(np.uint64), base + np.minimum(high[some], (1 << 54) - 1).astype(np.uint64)
        at = np.searchsorted(self.keys, least)
        hit = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] <= most)
        hit = hit[at[hit] < len(self.keys)]
        sizes = np.searchsorted(self.keys, most[hit], "right") - at[hit]
        return np.repeat(some[hit], sizes), self.above[_ranges(at[hit], sizes)]

    def _rows(self, value: np.ndarray, page: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products and sums of rows; the rows with an amount, and the amounts."""
        held = np.flatnonzero(line >= 0)
        start, stop = np.searchsorted(line[held], line[held]), np.searchsorted(line[held], line[held], "right")
        v, of, code = value[held], line[held], self.code[held]
        i, j = _pairs(stop)
        # Two numbers and their product.
        a = np.flatnonzero((v[i] > 0) & (v[j] > 0))
        size = (stop - start)[i[a]]
        pair, k = np.repeat(a, size), _ranges(start[i[a]], size)
        product = v[i[a]].astype(float) * v[j[a]].astype(float) * 1e-8
        near = np.abs(np.repeat(product, size) - v[k] * 1e-4) <= np.maximum(0.021, v[k] * 1.1e-13)
        near = np.flatnonzero(near & (v[k] > 0) & (k != i[pair]) & (k != j[pair]))
        x, y, k = i[pair[near]], j[pair[near]], k[near]
        off = np.abs(v[x] * v[y] - v[k] * 10000)  # modulo 2^64, but what is left is small
        good = np.flatnonzero((off <= 2_000_000) | (off <= v[k] // 100_000))
        x, y, k = x[good], y[good], k[good]
        once = _distinct([code[k], code[y], code[x], of[x]])
        x, y, k = x[once], y[once], k[once]
        self._add(0, page[held[x]], of[x], self._pool(v[x], v[y]), np.full(len(x), 2), v[k])
        self.arith[code[x]] = self.arith[code[y]] = self.arith[code[k]] = True
        lines = int(of.max(initial=-1)) + 1
        amount = np.zeros(lines, np.int64)
        np.maximum.at(amount, of[x], v[k])
        # Runs and a number further right.
        upto = np.concatenate([[0], np.cumsum(v)])
        total = upto[j + 1] - upto[i]
        a = np.flatnonzero(total > 0)
        size = stop[j[a]] - j[a] - 1
        run, k = np.repeat(a, size), _ranges(j[a] + 1, size)
        off = np.abs(v[k] - total[run])
        closed = (v[k] > 0) & ((off <= _CENTS) | (off <= v[k] // 1_000_000_000))
        near = np.flatnonzero(closed | (v[k] > 0) & (off <= v[k] // 200))
        run, k, closed = run[near], k[near], closed[near]
        some = np.zeros(lines, bool)
        some[of[k[closed]]] = True
        kept = np.flatnonzero(closed | ~some[of[k]])
        run, k, closed = run[kept], k[kept], closed[kept]
        x, size = i[run], j[run] - i[run] + 1
        once = _distinct([total[run], code[k], size, of[k]], x, size, v)
        run, k, closed, x, size = run[once], k[once], closed[once], x[once], size[once]
        for kind, at in ((1, np.flatnonzero(closed)), (2, np.flatnonzero(~closed))):
            self._add(kind, page[held[k[at]]], of[k[at]], held[x[at]], size[at], v[k[at]], None if kind == 1 else v[k[at]] - total[run[at]])
        at = np.flatnonzero(closed)
        self.arith[code[k[at]]] = True
        self.arith[code[_ranges(x[at], size[at])]] = True
        at = at[np.lexsort((v[k[at]], size[at], of[k[at]]))]
        last = at[np.append(of[k[at]][1:] != of[k[at]][:-1], True)] if len(at) else at
        last = last[amount[of[k[last]]] == 0]
        amount[of[k[last]]] = v[k[last]]
        page_of = np.zeros(lines, np.int64)
        page_of[of] = page[held]
        having = np.flatnonzero(amount > 0)
        return page_of[having], amount[having]

    def _columns(self, page: np.ndarray, of: np.ndarray, amount: np.ndarray) -> None:
        """Runs of rows' amounts that some number of the page repeats."""
        i, j = _pairs(np.searchsorted(of, of, "right"))
        upto, size = np.concatenate([[0], np.cumsum(amount)]), j - i + 1
        total = upto[j + 1] - upto[i]
        run, number = self._met(of[i], total - _CENTS * size, total + _CENTS * size)
        once = _distinct([total[run], number, size[run]], i[run], size[run], amount)
        run, number = run[once], number[once]
        self.pools.append(amount)
        self._add(3, of[i[run]], np.full(len(run), -1), self.pooled + i[run], size[run], self.own[number])
        self.pooled += len(amount)
        self.arith[number] = True

    def _ratios(self) -> None:
        """Of a page's distinct positive numbers, a + b = c with a > b, and usual percentages."""
        of, v = self.of_page[self.above], self.own[self.above]
        b, a = _pairs(np.searchsorted(of, of, "right"))
        total = v[a] + v[b]
        highest = v[np.searchsorted(of, of, "right") - 1] if len(of) else v
        some = np.flatnonzero(total <= highest[a] + _CENTS)
        a, b, total = a[some], b[some], total[some]
        pair, c = self._met(of[a], total - _CENTS, total + _CENTS)
        a, b = a[pair], b[pair]
        kept = np.flatnonzero((c != self.above[a]) & (c != self.above[b]))
        a, b, c = a[kept], b[kept], c[kept]
        self._add(4, of[a], np.full(len(a), -1), self._pool(v[a], v[b]), np.full(len(a), 2), self.own[c])
        self.arith[self.above[a]] = self.arith[self.above[b]] = self.arith[c] = True
        for share in _PERCENTAGES:
            whole, rest = v // 10000 * share, v % 10000 * share
            reach = v // 5000 + 2
            a, c = self._met(of, whole + rest // 10000 - reach, whole + rest // 10000 + reach)
            kept = np.flatnonzero((np.abs((self.own[c] - whole[a]) * 10000 - rest[a]) <= 2 * v[a]) & (c != self.above[a]))
            a, c = a[kept], c[kept]
            self._add(5, of[a], np.full(len(a), -1), self._pool(v[a], np.full(len(a), share)), np.full(len(a), 2), self.own[c])
            self.arith[self.above[a]] = self.arith[c] = True


def money(v: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """Whole ten-thousandths as decimal(16,4), null where not known."""
    both = np.stack([v, v >> 63], 1)
    valid = None if known is None else pa.py_buffer(np.packbits(known, bitorder="little"))
    return pa.Array.from_buffers(pa.decimal128(16, 4), len(v), [valid, pa.py_buffer(both)])


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut anew, so that none ends within a page."""
    held = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        page = np.asarray(batch.column(0).dictionary_encode().indices)
        last = int(np.searchsorted(page, page[-1]))  # pages are numbered as they come
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None and held.num_rows:
        yield held


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, Proofs | None]]:
    """(cells, page and line of each, cells with a number, their proofs) of some pages at a time. Cells are (page, row, x, v,
    ...), those of a page next to each other, v whole ten-thousandths or null; they come out ordered by row and x."""
    for batch in _whole_pages(batches):
        page = np.asarray(batch.column(0).dictionary_encode().indices).astype(np.int64)
        keys = pa.table({"page": page, "row": batch.column(1), "x": batch.column(2), "v": batch.column(3)})
        batch = batch.take(pc.sort_indices(keys, [(n, "ascending") for n in keys.column_names], null_placement="at_start"))
        rows = np.asarray(batch.column(1).dictionary_encode().indices.fill_null(-1))
        known, value = np.asarray(batch.column(3).is_valid()), np.asarray(batch.column(3).fill_null(0))
        fresh = np.ones(len(page), bool)
        fresh[1:] = (page[1:] != page[:-1]) | (rows[1:] != rows[:-1])
        starts, edges = np.flatnonzero(fresh), np.concatenate([[0], np.cumsum(np.bincount(page))])
        pages = len(edges) - 1
        weight = np.bincount(page[starts], np.diff(np.append(starts, len(page))).astype(float) ** 3, pages) + np.diff(edges).astype(float) ** 2
        weight = np.concatenate([[0], np.cumsum(weight)])
        first = 0
        while first < pages:
            last = min(first + _PAGES, max(first + 1, int(np.searchsorted(weight, weight[first] + _TRIPLES, "right")) - 1), pages)
            a, b = int(edges[first]), int(edges[last])
            at = np.flatnonzero(known[a:b])
            line = np.cumsum(fresh[a:b]) - 1
            own = page[a:b] - first
            yield batch.slice(a, b - a), own, line, at, Proofs(value[a:b][at], own[at], np.where(rows[a:b] < 0, -1, line)[at]) if len(at) else None
            first = last


def findings(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(page, row, kind, terms, total, delta) of cells as chunks takes them."""
    for cells, own, lines, _, proofs in chunks(batches):
        if proofs is None:
            continue
        kind, page, line, first, size, total, delta = (np.concatenate(x) for x in zip(*proofs.found, strict=True))
        pool = np.concatenate(proofs.pools)
        rows = pa.array(np.searchsorted(lines, line), mask=line < 0)
        terms = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), money(pool[_ranges(first, size)]))
        pages = cells.column(0).take(pa.array(np.searchsorted(own, page)))
        yield pa.RecordBatch.from_arrays([pages, cells.column(1).take(rows), pa.array(KINDS).take(pa.array(kind)), terms, money(total), money(delta, kind == 2)], names=names)


def grades(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Cells (page, row, x, v, dual, ...) as chunks takes them: page, the columns after dual, and grade."""
    words = pa.array(["none", "dual", "arith"])
    for cells, own, _, at, proofs in chunks(batches):
        grade = np.asarray(cells.column(4).fill_null(False)).astype(np.int64)
        known = np.zeros(len(own), bool)
        known[at] = True
        if proofs is not None:
            grade[at[proofs.proven]] = 2
        yield pa.RecordBatch.from_arrays([cells.column(0), *cells.columns[5:], words.take(pa.array(grade, mask=~known))], names=names)
