"""The entry without its optional part, and without a library that only this part needs."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"


def listed(folder, first=""):
    done = subprocess.run([sys.executable, "-B", "-c", f"{first}{LISTED}"], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names, strangers = eval(f"({done.stdout.strip().replace('] [', '], [')})")
    assert strangers == []
    return names


@pytest.fixture(scope="module")
def bare(tmp_path_factory):
    """A copy of the library without the optional folders and the pipeline."""
    folder = tmp_path_factory.mktemp("bare")
    shutil.copytree(f"{HERE}/vetline", folder / "vetline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", folder)
    return folder


def test_without_the_optional_part(bare):
    names = listed(bare)
    assert "clean_postings" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)


@pytest.mark.parametrize("missing", ["xxhash", "public_tokenizers", "numpy.nothing", "vetline.llm"])
def test_without_a_library(bare, missing):
    """A library that only the optional part imports may be missing; the other queries stay."""
    names = listed(HERE, f"import sys; sys.modules[{missing!r}] = None; ")
    assert set(listed(bare)) <= set(names)
