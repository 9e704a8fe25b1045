"""No module uses a name that nothing defines."""

import builtins
import symtable
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
FILES = sorted(p for p in (*ROOT.glob("*.py"), *ROOT.glob("brookmart/**/*.py"), *ROOT.glob("tests/**/*.py")) if "__pycache__" not in p.parts)


def undefined(source: str, name: str) -> set[str]:
    top = symtable.symtable(source, name, "exec")
    known = {s.get_name() for s in top.get_symbols() if s.is_assigned() or s.is_imported() or s.is_namespace()} | set(dir(builtins)) | {"__file__", "__name__", "__doc__"}
    found, left = set(), [top]
    while left:
        table = left.pop()
        left += table.get_children()
        found |= {s.get_name() for s in table.get_symbols() if s.is_global() and s.is_referenced() and s.get_name() not in known}
        found |= {s.get_name() for s in table.get_symbols() if table is top and s.is_referenced() and s.get_name() not in known}
    return found


def test_a_missing_name_is_found():
    assert undefined("A = 1\ndef f(x):\n    return x in A or x in B\n", "x") == {"B"}


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_names_are_defined(path):
    assert not undefined(path.read_text(), str(path))
