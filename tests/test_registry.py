import __spark_entry__ as se


def test_contract_shapes():
    qs, sql = se.queries(), se.oracle_sql()
    assert len(qs) >= 80 and set(sql) <= set(qs)
    assert all(callable(f) for f in qs.values())
    assert all(isinstance(s, str) and s.strip() for s in sql.values())


def test_works_without_the_training_data_package(tmp_path):
    """The package and its pipeline may be gone: the rest still imports and registers its queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(se.__file__))
    shutil.copytree(os.path.join(root, "postlytics"), tmp_path / "postlytics", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'er_by_weekday' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
