"""Ordered passes in Python over groups of rows: a partition's groups one after the other, so that a group costs no call
of its own. Only the columns that a pass reads become Python values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()),
}
#: Rows of a batch that is given back.
_ROWS = 5_000


def _schema(rows: DataFrame, columns: Iterable[str], added: dict[str, str]) -> str:
    own = (f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return ", ".join([*own, *(f"`{c}` {kind}" for c, kind in added.items())])


def scanned(rows: DataFrame, reads: list[str], added: dict[str, str], make: Callable[[], Callable]) -> DataFrame:
    """Rows with the columns ``added`` by one pass over each document in the order of ``line_no``.

    ``make()`` begins a document; what it gives is called with the values of ``reads`` of each of its rows and gives the
    values of ``added``. All other columns pass by as they are. Nothing of a document is held but its state.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, doc, step = False, None, None
        for batch in batches:
            out = []
            for own, *values in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *reads)), strict=True):
                if not begun or own != doc:
                    begun, doc, step = True, own, make()
                out.append(step(*values))
            made = zip(*out, strict=True) if out else ((),) * len(added)
            arrays = [pa.array(values, _ARROW[kind]) for values, kind in zip(made, added.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *added])

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "line_no").mapInArrow(run, _schema(rows, rows.columns, added))


def grouped(rows: DataFrame, keys: list[str], order: list[str], added: dict[str, str], work: Callable[[list[tuple]], Iterable[tuple]]) -> DataFrame:
    """For each group of rows with equal ``keys`` the rows that ``work`` makes of it: the keys and the columns ``added``.

    ``work`` gets the group's rows, as tuples of the columns that are no keys, in the given order.
    """
    reads = [c for c in rows.columns if c not in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        of_group, types, out = None, None, []

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * (len(keys) + len(added))
            kinds = [*types, *(_ARROW[kind] for kind in added.values())]
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names=[*keys, *added])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in reads), strict=True), strict=True):
                if group and key != of_group:
                    out += [(*of_group, *found) for found in work(group)]
                    group = []
                of_group = key
                group.append(row)
            if len(out) >= _ROWS:
                yield made()
                out = []
        if group:
            out += [(*of_group, *found) for found in work(group)]
        if out:
            yield made()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, _schema(rows, keys, added))
