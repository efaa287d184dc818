import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import session  # noqa: E402
from treeline.operators.facts import facts  # noqa: E402
from treeline.operators.lexical import lex, source_rows  # noqa: E402
from treeline.session import configure, materialize  # noqa: E402

APP = '''import os
from util.text import clean, trim as t

# TODO: split
def run(x):
    if x and x > 1:
        return 1
    elif x:
        return 2
    else:
        return 3
'''
TEXT = '''def clean(s):
    return s
class T:
    def go(self):
        return 1
'''
A = '''import x from './b';
const y = require('lodash');
'''
B = '''import a from './a';
function f(p) { return p && 1 || 2; }
'''
GOLDEN = [("src/app.py", APP), ("util/text.py", TEXT), ("web/a.js", A), ("web/b.js", B)]


@pytest.fixture(scope="session")
def spark():
    return configure(session(4))


@pytest.fixture(scope="session")
def tree(spark):
    """Files given as (path, content) pairs, all in repository ``r``."""
    def make(pairs):
        return spark.createDataFrame([("r", p, c) for p, c in pairs], "repo string, path string, content string")

    return make


@pytest.fixture(scope="session")
def golden(tree):
    return materialize(facts(tree(GOLDEN)), "golden")


@pytest.fixture(scope="session")
def lexed(tree):
    return lambda pairs: lex(source_rows(tree(pairs)))
