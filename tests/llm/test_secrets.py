import random

import pytest
from pyspark.sql import functions as F

from treeline.llm import secrets
from treeline.llm.queries import labelled_findings


@pytest.fixture(scope="module")
def rows(prose):
    pick, made = random.Random(4), []
    for k in range(240):
        hidden = "".join(pick.choice("0123456789abcdef") for _ in range(32))
        false = "".join(pick.choice(["ab", "cde", "fga", "had"]) for _ in range(8))
        middle = f'api_token = "{hidden}"' if k % 2 else f"{false}"
        made.append((k, f"{prose(20, k)} {middle} {prose(20, 1000 + k)}", "src/test" if k % 5 == 0 else "src/main"))
    return made


def test_findings_with_context(documents):
    long = "A1b2C3d4E5f6G7h8"
    rows = [(1, f"x key={long}, and {long}== y", "a"), (2, long, None), (3, None, "a"), (4, "", "a"), (5, "nothing", "a")]
    found = {(r.doc_id, r.nth): (r.candidate, r.before, r.after) for r in secrets.findings(documents(rows)).collect()}
    assert found == {
        (1, 0): (long, "x key=", ", and "), (1, 1): (long + "==", ", and ", " y"), (2, 0): (long, "", ""),
    }


def test_forest_drops_false_findings_of_held_out_documents(documents, rows):
    docs = documents(rows)
    found = secrets.findings(docs)
    labelled = found.where("doc_id % 3 <> 0").withColumn("label", F.col("doc_id") % 2)
    dictionary, pairs = secrets.language(docs)
    model = secrets.train(labelled, dictionary, pairs)
    held = secrets.score(found.where("doc_id % 3 = 0"), model, dictionary, pairs).collect()
    right = sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held)
    assert len(held) >= 80 and right / len(held) > 0.95


def test_features(documents):
    rows = [(1, 'token = "aaaabbbb11112222" the', "x/tests/y"), (2, "thethethethethethe", None)]
    found = secrets.features(secrets.findings(documents(rows)), ["the"], [1 / 37] * 37 * 37).collect()
    first, second = sorted(found, key=lambda r: r.doc_id)
    assert (first.f_length, first.f_distinct, first.f_digits, first.f_changes) == (16, 4, 0.5, 1 / 15)
    assert (first.f_credential, first.f_quoted, first.f_assigned, first.f_aside, first.f_depth) == (1, 1, 1, 1, 2)
    assert (first.f_word_after, first.f_word_before) == (1, 0)
    assert (second.f_dictionary, second.f_hex, second.f_credential) == (1, 6 / 18, 0)
    assert second.f_likely == pytest.approx(-3.6109, abs=1e-3)


def test_without_labels_or_rows(documents, odd):
    found = secrets.findings(odd)
    dictionary, pairs = secrets.language(odd)
    assert secrets.train(found.withColumn("label", F.lit(1)), dictionary, pairs) is None
    assert {r.score for r in secrets.score(found, None, dictionary, pairs).collect()} <= {1.0}
    assert secrets.findings(documents([])).collect() == []
    assert secrets.language(documents([]))[0] == []


def test_short_and_split_values(documents):
    rows = [
        (1, "password=S3cr$t!Pass.w0rd, pwd: 'a b' x", "a"), (2, "see https://bob:p.w%1@db.net/x and joe:pa$s@host", "a"),
        (3, '{"token":"ab.c","api_key":"x"} token:abc,key:def', "a"), (4, "--password hunter2 Bearer a.b.c nokey here: x", "a"),
    ]
    found = secrets.findings(documents(rows))
    values = {}
    for r in found.collect():
        values.setdefault(r.doc_id, []).append((r.nth, r.candidate))
    assert {k: [c for _, c in sorted(v)] for k, v in values.items()} == {
        1: ["S3cr$t!Pass.w0rd", "a"], 2: ["p.w%1", "pa$s"], 3: ["ab.c", "x", "abc", "def"], 4: ["hunter2", "a.b.c"],
    }
    assert secrets.features(found, ["the"], [1 / 37] * 37 * 37).where("f_likely is null or f_changes is null").isEmpty()


def test_labels_only_where_a_form_proves_them(documents, prose):
    pick = random.Random(9)
    def run(n, letters):
        return "".join(pick.choice(letters) for _ in range(n))
    cases = [
        ("ghp_" + run(36, "aB3dE5"), "x {}", 1), ("9f86d081884c7d65", "password={}", 1), ("AKIA" + run(16, "AB12"), "{}", 1),
        ("123e4567-e89b-12d3-a456-426614174000", "{}", 0), ("9f86d081" * 4, "md5: {} ", 0), ("uncharacteristically", "{}", 0),
        ("treeline/llm/secrets", "{}", 0), ("changeme", "password={}", 0), ("4785380592391139", "number {}", 0),
        ("S3cr$t!Pass.w0rd", "password={}", None), ("9f86d081" * 4, "{}", None), ("Zm9vYmFyYmF6cXV4MTIz", "{}", None),
    ]
    rows = [(i, "a " + form.format(value) + " b", "s") for i, (value, form, _) in enumerate(cases * 5)]
    labels = {(r.candidate, r.before): r.label for r in labelled_findings(secrets.findings(documents(rows))).collect()}
    assert labels == {(v, "a " + form.split("{}")[0]): label for v, form, label in cases}


def test_recall_on_forms_without_a_label_rule(documents, prose):
    pick = random.Random(8)
    def run(n, letters="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"):
        return "".join(pick.choice(letters) for _ in range(n))
    forms = {
        "split": lambda: ("password=", f"{run(4)}${run(3)}!{run(4)}.{run(2)}", ""), "short": lambda: ("pwd: ", run(9), ""),
        "host": lambda: ("https://bob:", run(10), "@db.net/x"), "dotted": lambda: ('secret = "', f"S.{run(12)}.{run(9)}", '"'),
    }
    known = [
        lambda: ('token = "', run(40, "0123456789abcdef"), '"'), lambda: ("", "AKIA" + run(16, "ABCDEFGHKL234567"), ""),
        lambda: ("password=", run(18, "0123456789abcdef"), ""),
        lambda: ("", "".join(pick.choice(["ab", "cde", "fga", "had"]) for _ in range(8)), ""),
        lambda: ("", "-".join(run(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)), ""), lambda: ("", run(16, "0123456789"), ""),
    ]
    made, planted = [], {}
    for k in range(600):
        head, value, tail = (forms[list(forms)[k % 4]] if k % 5 == 0 else known[k % 6])()
        if k % 5 == 0:
            planted[k, value] = list(forms)[k % 4]
        made.append((k, f"{prose(20, k)} {head}{value}{tail} {prose(20, 1000 + k)}", "src/main"))
    docs = documents(made)
    found = secrets.findings(docs)
    labelled = labelled_findings(found)
    dictionary, pairs = secrets.language(docs)
    scored = secrets.score(found, secrets.train(labelled, dictionary, pairs), dictionary, pairs).collect()
    right = [planted[r.doc_id, r.candidate] for r in scored if (r.doc_id, r.candidate) in planted and r.score >= 0.5]
    recall = {f: right.count(f) / list(planted.values()).count(f) for f in forms}
    print("recall by form", recall)
    assert min(recall.values()) > 0.9
    named = {(r.doc_id, r.nth) for r in labelled.where("label is not null").collect()}
    assert not any((r.doc_id, r.candidate) in planted and (r.doc_id, r.nth) in named for r in scored)
    harmless = [r.score < 0.5 for r in scored if r.doc_id % 5 and r.doc_id % 6 >= 3]
    assert sum(harmless) / len(harmless) > 0.95
