"""Exact block scoring: corpus rows against requests, one matrix product per Arrow batch.

Each task keeps only the best `top_k` rows per request plus a match count, so what leaves a task is bounded
by its requests, never by the pairs it looked at. Two ways feed it:

* few requests (a checked number of floats): they travel to every task and the corpus is scanned in place,
  without a shuffle;
* many requests: both sides are cut into blocks of bounded size that meet in a cogroup.

Products run in float32 with a proven error bound; every row near a cut is scored again in float64, in an
order that does not depend on its position, so equal vectors tie exactly and fall back to the id order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REQUEST_BLOCK = 512
RESCORE_FLOATS = 4_000_000
# More candidates than this many times the wanted rows point to copies.
COPY_CHECK = 4
PARTIAL_SCHEMA = "query_id long, part int, id long, score double, matched long, top_k int"


@dataclass
class PairRule:
    """A predicate between a corpus column and a request column; a null request value switches it off.

    `eq` compares strings, `ge` and `le` compare whole numbers, `among` looks the corpus number up in the
    request's list, where an empty list counts as null.
    """

    kind: str
    corpus_col: str
    request_col: str


@dataclass
class RequestSet:
    """All requests of one dimension, ready for matrix products."""

    ids: np.ndarray
    vectors: np.ndarray
    unit: np.ndarray
    lengths: np.ndarray
    top_k: np.ndarray
    threshold: np.ndarray
    params: dict[str, list] = field(default_factory=dict)
    probes: dict[int, np.ndarray] | None = None

    def pick(self, rows: np.ndarray) -> RequestSet:
        return RequestSet(
            self.ids[rows], self.vectors[rows], self.unit[rows], self.lengths[rows],
            self.top_k[rows], self.threshold[rows],
            {name: [values[i] for i in rows] for name, values in self.params.items()},
        )


def matrices_by_dim(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float32 matrix) for each vector size present.

    Null and empty vectors are left out, and so are vectors that hold a null, NaN or infinite element.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        matrix = flat.reshape(-1, dim) if len(rows) == len(sizes) else flat[starts[rows][:, None] + np.arange(dim)]
        usable = np.isfinite(matrix).all(axis=1)
        yield (rows, matrix) if usable.all() else (rows[usable], matrix[usable])


def _lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))


def _unit(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return (matrix / np.where(lengths == 0.0, 1.0, lengths)[:, None]).astype(np.float32)


def pack_requests(table: pa.Table, params: Sequence[str] = (), probes_col: str | None = None) -> dict[int, RequestSet]:
    """Requests by dimension from columns query_id, query_vec, top_k, threshold and the named parameters."""
    packed: dict[int, RequestSet] = {}
    if table.num_rows == 0:
        return packed
    for rows, matrix in matrices_by_dim(table.column("query_vec")):
        part = table.take(pa.array(rows))
        lengths = _lengths(matrix)
        chosen = RequestSet(
            ids=part.column("query_id").to_numpy(),
            vectors=matrix.astype(np.float64),
            unit=_unit(matrix, lengths),
            lengths=lengths,
            top_k=part.column("top_k").to_numpy().astype(np.int64),
            threshold=part.column("threshold").fill_null(-np.inf).to_numpy().astype(np.float64),
            params={name: part.column(name).to_pylist() for name in params},
        )
        if probes_col:
            cells = part.column(probes_col).combine_chunks()
            owner = np.repeat(np.arange(len(rows)), cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = cells.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(flat, kind="stable")
            names, first = np.unique(flat[order], return_index=True)
            chosen.probes = dict(zip(names.tolist(), np.split(owner[order], first[1:])))
        packed[matrix.shape[1]] = chosen
    return packed


@dataclass
class CorpusRows:
    """The scorable rows of one Arrow batch, all of one dimension."""

    ids: np.ndarray
    parts: np.ndarray
    matrix: np.ndarray
    lengths: np.ndarray
    unit: np.ndarray
    columns: dict[str, pa.Array]
    _copies: tuple[np.ndarray, np.ndarray] | None = None

    def copies(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of the distinct vector of each row, place of each row among its copies by part and id)."""
        if self._copies is None:
            width = self.matrix.shape[1] * self.matrix.itemsize
            raw = np.ascontiguousarray(self.matrix).view(np.dtype((np.void, width))).ravel()
            _, group = np.unique(raw, return_inverse=True)
            order = np.lexsort((self.ids, self.parts, group))
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order)) - np.searchsorted(group[order], group[order], side="left")
            self._copies = group, place
        return self._copies

    def pick(self, rows: np.ndarray) -> CorpusRows:
        return CorpusRows(
            self.ids[rows], self.parts[rows], self.matrix[rows], self.lengths[rows], self.unit[rows],
            {name: column.take(pa.array(rows)) for name, column in self.columns.items()},
        )


def _allowed(rules: Sequence[PairRule], corpus: CorpusRows, requests: RequestSet) -> np.ndarray | None:
    """Boolean (request, row) matrix of the pairs all rules admit; None when everything passes."""
    allowed: np.ndarray | None = None
    for rule in rules:
        column = corpus.columns[rule.corpus_col]
        wanted = requests.params[rule.request_col]
        if all(value is None or (rule.kind == "among" and not len(value)) for value in wanted):
            continue
        if allowed is None:
            allowed = np.ones((len(requests.ids), len(corpus.ids)), dtype=bool)
        if rule.kind == "eq":
            by_value: dict[str, list[int]] = {}
            for i, value in enumerate(wanted):
                if value is not None:
                    by_value.setdefault(value, []).append(i)
            for value, owners in by_value.items():
                hit = pc.fill_null(pc.equal(column, value), False).to_numpy(zero_copy_only=False)
                allowed[owners] &= hit
            continue
        known = column.is_valid().to_numpy(zero_copy_only=False)
        numbers = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
        for i, value in enumerate(wanted):
            if value is None or (rule.kind == "among" and not len(value)):
                continue
            if rule.kind == "ge":
                allowed[i] &= known & (numbers >= value)
            elif rule.kind == "le":
                allowed[i] &= known & (numbers <= value)
            else:
                allowed[i] &= known & np.isin(numbers, np.asarray(value))
    return allowed


def _bound(cut: np.ndarray, kind: np.dtype, toward: float) -> np.ndarray:
    """A cut in the type of the rough scores, so that comparing converts no score; rounded up or down, and above the mark of ruled-out pairs."""
    rounded = np.nextafter(cut.astype(kind), kind.type(toward))
    return np.maximum(rounded, np.finfo(kind).min)


class Ranking:
    """Running best rows and match counts of one request set."""

    def __init__(self, requests: RequestSet, metric: str, totals: bool, rules: Sequence[PairRule]):
        self.requests, self.metric, self.totals, self.rules = requests, metric, totals, rules
        self.matched = np.zeros(len(requests.ids), dtype=np.int64)
        self.floor = np.full(len(requests.ids), -np.inf)
        self.query = np.empty(0, np.int64)
        self.part = np.empty(0, np.int32)
        self.id = np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)

    def add(self, corpus: CorpusRows, among: np.ndarray | None = None) -> None:
        total = len(self.requests.ids) if among is None else len(among)
        for start in range(0, total, REQUEST_BLOCK):
            stop = min(start + REQUEST_BLOCK, total)
            self._add_block(corpus, np.arange(start, stop) if among is None else among[start:stop])

    def _add_block(self, corpus: CorpusRows, members: np.ndarray) -> None:
        requests = self.requests.pick(members) if len(members) < len(self.requests.ids) else self.requests
        rough, slack = self._rough(corpus, requests)
        allowed = _allowed(self.rules, corpus, requests)
        if allowed is not None:
            rough = np.where(allowed, rough, -np.inf)
        threshold = requests.threshold[:, None]
        if self.totals:
            sure = rough >= _bound(threshold + slack, rough.dtype, np.inf)
            maybe = rough >= _bound(threshold - slack, rough.dtype, -np.inf)
            certain = np.count_nonzero(sure, axis=1)
            self.matched[members] += certain
            open_rows = np.flatnonzero(np.count_nonzero(maybe, axis=1) != certain)
            q, c = np.nonzero(maybe[open_rows] & ~sure[open_rows])
            if len(q):
                q = open_rows[q]
                exact = self._exact(corpus, requests, q, c)
                np.add.at(self.matched, members[q[exact >= requests.threshold[q]]], 1)
        rows = rough.shape[1]
        widest = int(requests.top_k.max())
        cut = np.maximum(threshold, self.floor[members][:, None])
        near = rough >= _bound(cut - slack, rough.dtype, -np.inf)
        if 0 < widest < rows and np.count_nonzero(near) > COPY_CHECK * widest * len(members):
            own = np.partition(rough, rows - widest, axis=1)[:, rows - widest, None]
            near = rough >= _bound(np.maximum(cut, own) - slack, rough.dtype, -np.inf)
        q, c = np.divmod(np.flatnonzero(near), rows)
        if len(q) > COPY_CHECK * widest * len(members) and allowed is None:
            # Mostly copies of one vector: of equal rows only the first `widest` by id can rank.
            first = corpus.copies()[1][c] < widest
            q, c = q[first], c[first]
        if not len(q):
            return
        score = self._exact(corpus, requests, q, c)
        keep = score >= requests.threshold[q]
        self._merge(members[q[keep]], corpus.parts[c[keep]], corpus.ids[c[keep]], score[keep])

    def _rough(self, corpus: CorpusRows, requests: RequestSet) -> tuple[np.ndarray, np.ndarray | float]:
        """float32 scores and a bound on their distance from the exact score."""
        unit_error = (corpus.matrix.shape[1] + 8) * 2.0**-23
        if self.metric == "cosine":
            return requests.unit @ corpus.unit.T, unit_error
        rough = requests.vectors.astype(np.float32) @ corpus.matrix.T
        size_c, size_q = np.square(corpus.lengths), np.square(requests.lengths)
        rough = 2.0 * rough.astype(np.float64) - size_c[None, :] - size_q[:, None]
        longest = corpus.lengths.max(initial=0.0)
        return rough, (4.0 * unit_error * np.square(requests.lengths + longest))[:, None]

    def _exact(self, corpus: CorpusRows, requests: RequestSet, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """float64 scores of the listed pairs; the sum order depends on the dimension only."""
        step = max(1, RESCORE_FLOATS // corpus.matrix.shape[1])
        if len(q) > step:
            # Score each distinct vector once per request.
            group = corpus.copies()[0]
            pair, sample, place = np.unique(q * (group.max() + 1) + group[c], return_index=True, return_inverse=True)
            if len(pair) < len(q):
                return self._exact_rows(corpus, requests, q[sample], c[sample], step)[place]
        return self._exact_rows(corpus, requests, q, c, step)

    def _exact_rows(self, corpus, requests, q, c, step) -> np.ndarray:
        score = np.empty(len(q))
        for start in range(0, len(q), step):
            some = slice(start, start + step)
            left, right = requests.vectors[q[some]], corpus.matrix[c[some]].astype(np.float64)
            if self.metric == "cosine":
                scale = requests.lengths[q[some]] * corpus.lengths[c[some]]
                product = (left * right).sum(axis=1)
                score[some] = np.where(scale == 0.0, 0.0, product / np.where(scale == 0.0, 1.0, scale))
            else:
                score[some] = -np.square(left - right).sum(axis=1)
        return score

    def _merge(self, query: np.ndarray, part: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        touched = np.zeros(len(self.requests.ids), dtype=bool)
        touched[query] = True
        old = touched[self.query]
        query = np.concatenate([self.query[old], query])
        part = np.concatenate([self.part[old], part])
        id_ = np.concatenate([self.id[old], id_])
        score = np.concatenate([self.score[old], score])
        order = np.lexsort((id_, part, -score, query))
        query, part, id_, score = query[order], part[order], id_[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        kept = place < self.requests.top_k[query]
        last = place == self.requests.top_k[query] - 1
        self.floor[query[last]] = score[last]
        self.query = np.concatenate([self.query[~old], query[kept]])
        self.part = np.concatenate([self.part[~old], part[kept]])
        self.id = np.concatenate([self.id[~old], id_[kept]])
        self.score = np.concatenate([self.score[~old], score[kept]])

    def rows(self) -> pa.RecordBatch:
        counted = np.flatnonzero(self.matched) if self.totals else np.empty(0, np.int64)
        best, extra = len(self.query), len(counted)
        owner = np.concatenate([self.query, counted])
        is_count = np.arange(best + extra) >= best

        def padded(values: np.ndarray, kind: pa.DataType, blank: np.ndarray) -> pa.Array:
            return pa.array(values, type=kind, mask=blank)

        zeros = np.zeros(extra)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.requests.ids[owner], type=pa.int64()),
                padded(np.concatenate([self.part, zeros.astype(np.int32)]), pa.int32(), is_count),
                padded(np.concatenate([self.id, zeros.astype(np.int64)]), pa.int64(), is_count),
                padded(np.concatenate([self.score, zeros]), pa.float64(), is_count),
                padded(np.concatenate([np.zeros(best, np.int64), self.matched[counted]]), pa.int64(), ~is_count),
                pa.array(self.requests.top_k[owner].astype(np.int32), type=pa.int32()),
            ],
            names=["query_id", "part", "id", "score", "matched", "top_k"],
        )


def corpus_rows(batch: pa.RecordBatch | pa.Table, extra: Sequence[str]) -> Iterator[tuple[int, CorpusRows]]:
    def whole(name: str) -> pa.Array:
        column = batch.column(name)
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    ids = whole("id").to_numpy(zero_copy_only=False)
    parts = whole("part").to_numpy(zero_copy_only=False).astype(np.int32)
    columns = {name: whole(name) for name in extra}
    for rows, matrix in matrices_by_dim(whole("embedding")):
        lengths = _lengths(matrix)
        every = len(rows) == len(ids)
        yield matrix.shape[1], CorpusRows(
            ids if every else ids[rows],
            parts if every else parts[rows],
            matrix,
            lengths,
            _unit(matrix, lengths),
            columns if every else {n: c.take(pa.array(rows)) for n, c in columns.items()},
        )


class Scorer:
    """Feeds batches of one task into the rankings and hands out what is left at its end."""

    def __init__(
        self,
        requests: dict[int, RequestSet],
        metric: str,
        totals: bool,
        rules: Sequence[PairRule],
        cell_col: str | None = None,
    ):
        self.rankings = {dim: Ranking(some, metric, totals, rules) for dim, some in requests.items()}
        self.cell_col = cell_col
        self.extra = list(dict.fromkeys([rule.corpus_col for rule in rules] + ([cell_col] if cell_col else [])))

    def add(self, batch: pa.RecordBatch | pa.Table) -> None:
        if batch.num_rows == 0:
            return
        for dim, rows in corpus_rows(batch, self.extra):
            ranking = self.rankings.get(dim)
            if ranking is None:
                continue
            if self.cell_col is None:
                ranking.add(rows)
                continue
            cells = rows.columns[self.cell_col].to_numpy(zero_copy_only=False)
            for cell in np.unique(cells).tolist():
                members = (ranking.requests.probes or {}).get(cell)
                if members is not None:
                    ranking.add(rows.pick(np.flatnonzero(cells == cell)), members)

    def results(self) -> Iterator[pa.RecordBatch]:
        for ranking in self.rankings.values():
            yield ranking.rows()
