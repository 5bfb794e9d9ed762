import pytest

from strophe import queries
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    sql = queries.ORACLE.get(name)
    if sql:
        assert rows_of(got) == rows_of(duck.sql(sql).df())
    else:
        assert len(got)


def test_entry_works_without_the_training_subpackage():
    import subprocess
    import sys

    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("strophe.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "corp_dispersion" in e.queries() and "pipeline" not in e.queries() and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True)
