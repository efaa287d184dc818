"""Functions sent to executors must not need the package there."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from treeline.operators import minhash, search, simhash

USES = {
    "signature": (minhash.SlotMinima(8), "made([1, 2, 3]).shape"),
    "fingerprint": (simhash.Fingerprints(), "made('some text')"),
    "vector": (search.hashed_terms(16), "made(['a b', '']).sum()"),
}


@pytest.mark.parametrize("name", USES)
def test_unpickles_without_the_package(name, tmp_path):
    made, use = USES[name]
    (tmp_path / "f").write_bytes(cloudpickle.dumps(made))
    code = (
        f"import pickle, numpy as np, sys; made = pickle.load(open('f', 'rb'));"
        f"print({use.replace('[1, 2, 3]', 'np.array([1, 2, 3])')}); assert 'treeline' not in sys.modules"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
