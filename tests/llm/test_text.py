import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scoretables.llm import graph, tables, text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aBé \t\n.9Z_\x0b中"), max_size=12)), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for kind, pattern in ((text.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (text.NON_SPACE, r"[^\x20\x09-\x0D]+")):
        found = text.Words(pa.array(texts, pa.string()), kind)
        own = [[found.word(i).decode() for i in range(a, b)] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
        assert own == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        hashes = found.hashes()
        words = [w for ws in own for w in ws]
        assert len(set(hashes.tolist())) == len(set(words))
        assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words))


def test_sliced_arrays_and_starts_of_words():
    column = pa.array(["x", "abcd ab", None, "abce"])
    whole, part = text.Words(column, text.ALNUM), text.Words(column.slice(1), text.ALNUM)
    assert part.hashes().tolist() == whole.hashes()[1:].tolist()
    starts = part.hashes(3)
    assert starts[0] == starts[2] != starts[1]


def test_hashes_are_the_same_in_pieces(monkeypatch):
    column = pa.array(["a bb ccc dddd", None, "e" * 50 + " f", "", "a ccc"])
    found = text.Words(column, text.ALNUM)
    whole, starts = found.hashes().tolist(), found.hashes(3).tolist()
    for piece in (1, 4, 7, 60):
        monkeypatch.setattr(text, "PIECE", piece)
        assert found.hashes().tolist() == whole and found.hashes(3).tolist() == starts
    assert text.Words(pa.array([""]), text.ALNUM).hashes().tolist() == []


def test_shingles_of_short_sequences():
    h = np.array([1, 2, 3], np.uint64)
    assert len(text.shingle_hashes(h, 2)) == 2 and len(text.shingle_hashes(h, 5)) == 1 and len(text.shingle_hashes(h[:0], 2)) == 0


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 5, "b" * 50, None, "", "c" * 4, "d" * 4]})
    parts = list(tables.slices([batch], "t", 8))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and max(p.num_rows for p in parts) > 1


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_forest_is_brute_force_components(pairs):
    u, r = graph.forest(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64))
    groups = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        merged = groups[a] | groups[b]
        for x in merged:
            groups[x] = merged
    assert dict(zip(u.tolist(), r.tolist(), strict=True)) == {x: min(g) for x, g in groups.items() if min(g) != x}


def test_components_of_chains_stars_and_bad_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (50, 41)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    found = {r.id: r.root for r in graph.connected(df).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {50: 41}
    assert graph.connected(df.where("false")).count() == 0
