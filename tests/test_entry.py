import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:2] == ["tapeweave", "llm"] or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 200 and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
"""


def test_the_rest_works_without_the_training_data_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_them():
    for top in ("tapeweave", "gate"):
        for folder, _, files in os.walk(os.path.join(ROOT, top)):
            if os.path.relpath(folder, ROOT).startswith(os.path.join("tapeweave", "llm")):
                continue
            for name in (f for f in files if f.endswith(".py")):
                with open(os.path.join(folder, name)) as text:
                    assert "tapeweave.llm" not in text.read(), name
