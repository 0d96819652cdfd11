"""One long text passes through each operator's functions in time and memory that grow with its length."""

import json
import os
import subprocess
import sys

import pytest

SCRIPT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "long_text.py")


@pytest.mark.parametrize("kind", ["words", "unbroken", "ideographs"])
@pytest.mark.parametrize("operator", ["op1", "op4", "op5", "op7", "op8", "op9", "op10"])
def test_long_text(operator, kind):
    if operator == "op4":
        pytest.importorskip("public_tokenizers")
    done = subprocess.run([sys.executable, SCRIPT, operator, kind, "6"], capture_output=True, text=True, timeout=300, check=True)
    told = json.loads(done.stdout.splitlines()[-1])
    assert told["seconds"] < 60 and told["mb"] < 6 * 100 + 200, told
