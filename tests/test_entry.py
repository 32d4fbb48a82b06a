"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def imported(folder, code):
    return subprocess.run([sys.executable, "-B", "-c", f"import __spark_entry__ as e; {code}"], cwd=folder, capture_output=True, text=True, timeout=300)


def test_imports_without_a_session_and_without_the_optional_parts(tmp_path):
    whole = imported(ROOT, "print(len(e.queries()), len(e.oracle_sql()))")
    assert whole.returncode == 0, whole.stderr
    shutil.copytree(ROOT / "quoteloom", tmp_path / "quoteloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    rest = imported(tmp_path, "print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))")
    assert rest.returncode == 0 and rest.stdout.split()[-1] == "False", rest.stderr
    # an import error inside an optional part is not taken for its absence
    (tmp_path / "quoteloom" / "llm").mkdir()
    for name, text in (("__init__", ""), ("queries", "import no_such_module_anywhere")):
        (tmp_path / "quoteloom" / "llm" / f"{name}.py").write_text(text)
    broken = imported(tmp_path, "pass")
    assert broken.returncode != 0 and "no_such_module_anywhere" in broken.stderr


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
