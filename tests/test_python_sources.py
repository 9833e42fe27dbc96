"""Python sources that nest deeper than the parser's stack are files that don't parse."""

import pytest

from lodestrata.operators import chunking, lint

DEEP = "-" * 10_000 + "1\n" + "x = 1\n" * 60


def test_scopes_of_a_source_too_deep_for_the_parser(spark):
    files = spark.createDataFrame([("deep.py", DEEP), ("a.py", "def f():\n    pass\n")], "path string, source string")
    got = {tuple(r) for r in chunking.python_scopes(files).collect()}
    assert got == {("deep.py", None, "lines", 1, 40), ("deep.py", None, "lines", 41, 62), ("a.py", "f", "function", 1, 2)}


def test_short_memory_is_no_syntax_error(monkeypatch):
    def fail(source):
        raise MemoryError

    monkeypatch.setattr(chunking.ast, "parse", fail)
    with pytest.raises(MemoryError):
        chunking.parsed("x")


def test_tripwire_on_a_source_too_deep_for_the_parser(spark):
    files = spark.createDataFrame([("deep.py", DEEP), ("a.py", "open('x')\n")], "path string, source string")
    assert {tuple(r) for r in lint.mutation_tripwire(files, ["ok.py"]).collect()} == {("deep.py", 0, "unparsed"), ("a.py", 1, "open")}
