import re

import pytest

from treeline.llm.line_dedup import line_dedup, without_boilerplate

LONG = "this line is on many sites of the web"


def brute(rows, sites=5, least=20):
    spread, first = {}, {}
    for row, (doc_id, text, site) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n")):
            own = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
            if len(own) >= least:
                spread.setdefault(own, set()).update([site] if site is not None else [])
                first.setdefault(own, []).append(((doc_id is None, doc_id or 0), at, row))
    out = []
    for row, (doc_id, text, _) in enumerate(rows):
        kept = []
        for at, line in enumerate(text.split("\n") if text is not None else []):
            own = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
            gone = len(own) >= least and len(spread[own]) >= sites and min(first[own])[1:] != (at, row)
            kept += [] if gone else [line]
        out.append((doc_id, None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(prose):
    made = [(k, f"{LONG}\nown line number {k} is here\n  {LONG} \nshort", f"site{k % 6}") for k in range(40)]
    made += [(100 + k, "a line that four sites have\nx", f"site{k % 4}") for k in range(30)]
    made += [(200 + k, "a line of exactly five sites", f"site{k}") for k in range(5)]
    made += [(300, None, "site1"), (301, "", "site2"), (302, LONG, None), (None, LONG, "site9"), (303, "\n\n", "site3")]
    return made


def test_against_brute_force(documents, rows):
    found = [(r.row.doc_id, r.text) for r in line_dedup(documents(rows)).collect()]
    assert sorted(found, key=repr) == brute(rows)


def test_near_threshold_lines_are_counted_exactly(documents, rows):
    """With a margin this wide every candidate is counted; the result is the same."""
    wide = [(r.row.doc_id, r.text) for r in line_dedup(documents(rows), margin=0.99).collect()]
    assert sorted(wide, key=repr) == brute(rows)


def test_all_columns_come_back(documents, odd):
    out = without_boilerplate(odd)
    assert out.columns == odd.columns
    assert sorted(map(repr, out.select(odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert without_boilerplate(documents([])).count() == 0
