"""Names of modules: what one of them takes from another is not replaced by a second thing of the same name."""

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
MODULES = sorted((ROOT / "inkwell").rglob("*.py"))


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(ROOT)))
def test_each_name_is_given_once(path):
    given = []
    for node in ast.parse(path.read_text()).body:
        if isinstance(node, ast.Import | ast.ImportFrom):
            given += [(a.asname or a.name).split(".")[0] for a in node.names]
        elif isinstance(node, ast.FunctionDef | ast.ClassDef):
            given.append(node.name)
    assert sorted(given) == sorted(set(given))
