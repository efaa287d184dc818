import random
from hashlib import sha256

import pyarrow as pa
import pytest

from treeline.llm import suffix_dedup
from treeline.llm.suffix_dedup import BAND, LENGTH, SuffixLevels, repeated_strings


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = {}
    for _, b in texts:
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            if seen[b[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), sha256(r.kept).hexdigest()) for r in df.collect()),
        key=repr,
    )


@pytest.fixture(scope="module")
def rows(prose):
    a, b, c = prose(300, 1), prose(400, 2), prose(200, 3)
    made = [
        (1, a, "s"), (2, a, "s"), (3, "head " + a[100:900] + " tail", "s"), (4, prose(50, 9) + b[:399] + "|", "s"),
        (5, "x" + b[:400] + "y" + b[700:], "s"), (6, b, "s"), (7, c + c, "s"), (8, "ab" * 900, "s"), (9, "z" * 3000, "s"),
        (10, "é" * 500 + c[:300], "s"), (11, "ß" + "é" * 450, "s"), (12, None, "s"), (13, "", "s"), (14, "short", "s"),
        (None, a[:600], "s"), (15, "q" * 399, "s"), (16, "q" * 399, "s"), (17, "w" * 400, "s"), (18, "w" * 400, "s"),
    ]
    passage = prose(100, 44)[:520]
    return made + [(100 + k, prose(90, 100 + k) + passage + prose(90, 200 + k), "s") for k in range(40)]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_against_brute_force(documents, rows, batches):
    assert found(repeated_strings(documents(rows), batches)) == brute(rows)


def test_long_texts_are_read_in_pieces(documents, prose, monkeypatch):
    text = prose(4000, 5)
    rows = [(1, text, "s"), (2, text[3000:9000] + prose(500, 6), "s"), (2, text[3000:9000] + prose(500, 6), "s")]
    assert found(repeated_strings(documents(rows))) == brute(rows)


def test_passages_around_the_length(documents, prose):
    """Passages of over 50 words go from 400 bytes on, wherever they stand; shorter ones stay."""
    rows, expected = [(9, prose(300, 99), "s")], {9: 0}
    for length, removed in ((399, 0), (400, 400), (401, 401)):
        passage = prose(200, length)[:length]
        assert len(passage.split()) > 50
        for k in range(4):
            rows.append((length * 10 + k, f"{prose(20 + k, length + k)}#{k}{passage}{k}#{prose(30, length - 50 - k)}", "s"))
            expected[length * 10 + k] = removed
    got = found(repeated_strings(documents(rows)))
    assert got == brute(rows) and {r[0]: r[2] for r in got} == expected


def test_rows_equal_in_id_and_text(documents, prose):
    """2,000 rows of 9 KB that are one and the same, and 500 of another text without an id."""
    one, other = prose(2000, 3)[:9000], prose(2000, 5)[:9000]
    rows = [(7, one, "s")] * 2000 + [(None, other, "s")] * 500 + [(1, prose(100, 4), "s")]
    got = [(r.doc_id, r.n_bytes, len(r.kept), len(r.removed)) for r in repeated_strings(documents(rows)).collect()]
    assert len(got) == 2501 and {r for r in got if r[0] != 1} == {(7, 9000, 0, 1), (None, 9000, 0, 1)}


def test_empty_table_and_odd_rows(documents, odd):
    assert repeated_strings(documents([])).collect() == []
    assert repeated_strings(odd).count() == odd.count()


def test_levels_merge_only_for_a_batch_to_come(spark, monkeypatch):
    made, table = [], SuffixLevels._table
    monkeypatch.setattr(SuffixLevels, "_table", staticmethod(lambda entries, size: made.append(size) or table(entries, size)))
    index = SuffixLevels(spark)
    for heads in ([1, 2, 2], [3, 4], [5, 3, 6], [6, 7, 8, 8, 8]):
        index.add(spark.createDataFrame([(h, k) for k, h in enumerate(heads)], "head long, whole long"))
    assert made == [0, 0, 1, 0, 0]
    assert {(r.head, r.copies) for r in index.repeated_heads().collect()} == {(2, 2), (3, 0), (6, 0), (8, 3)}


@pytest.mark.parametrize("all_bands", [True, False])
def test_fingerprints_of_a_batch(all_bands, monkeypatch):
    """One pass over the bytes of many stretches, with the spans that each names by itself."""
    pick, rows, calls, hashes = random.Random(5), [], [], suffix_dedup.prefix_hashes
    for k in range(60):
        windows = pick.randint(1, 330)
        shift = pick.randint(0, 336)
        numbers = range(max(0, shift - windows + 1) // BAND, shift // BAND + 1)
        rows.append((k, 2 * k, windows, shift, pick.randbytes(windows + LENGTH - 1), pick.sample(numbers, pick.randint(1, len(numbers)))))
    names = ["head", "whole", "windows", "shift", "bytes", "bands"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    monkeypatch.setattr(suffix_dedup, "prefix_hashes", lambda *a: calls.append(1) or hashes(*a))
    got = [tuple(r.values()) for out in suffix_dedup._fingerprints(all_bands)(iter([batch.slice(3)])) for r in out.to_pylist()]
    assert len(calls) == 2
    expected = []
    for head, whole, windows, shift, raw, bands in rows[3:]:
        for b in range(max(0, shift - windows + 1) // BAND, shift // BAND + 1) if all_bands else bands:
            starts = [shift - b * BAND] if all_bands else range(max(0, shift - b * BAND - BAND + 1), min(windows, shift - b * BAND + 1))
            for at in starts:
                cut = suffix_dedup.np.frombuffer(raw[at : at + (LENGTH - BAND + 1 if all_bands else LENGTH)], "u1")
                sums = [hashes(cut), hashes(cut, suffix_dedup.SECOND)]
                ends = [suffix_dedup.np.array([0]), suffix_dedup.np.array([len(cut)])]
                prints = [int(suffix_dedup.span_hashes(x, *ends).view("i8")[0]) for x in sums]
                expected.append((*prints, head, whole, b if all_bands else at))
    assert got == expected


def test_window_numbers_as_runs():
    at = [[5, 3, 4, 9], [10], [1, 0, 7, 6, 3]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array(at, pa.list_(pa.int32()))], names=["head", "whole", "at"])
    got = [[(r["first"], r["last"]) for r in row["runs"]] for out in suffix_dedup._as_runs(iter([batch.slice(1), batch])) for row in out.to_pylist()]
    assert got == [[(10, 10)], [(0, 1), (3, 3), (6, 7)], [(3, 5), (9, 9)], [(10, 10)], [(0, 1), (3, 3), (6, 7)]]
