"""What operators write in the shared folder goes when it is no longer needed."""

import subprocess
import sys
from pathlib import Path

from lodestrata.operators.components import both_ways, minimum_labels
from lodestrata.session import Workspace, scratch, settled, shared_dir

ROOT = Path(__file__).resolve().parent.parent


def labels(spark):
    ws = Workspace(spark, "scratch-test")
    links = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)], "src string, dst string")
    return minimum_labels(ws, ws.save(both_ways(links), "arcs"))


def left(spark):
    return sorted(p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.is_dir() and any(p.iterdir()))


def test_scope_leaves_nothing(spark):
    before = left(spark)
    with scratch():
        assert {r.label for r in settled(labels)(spark).collect()} == {"n00"}
    assert left(spark) == before


def test_settled_query_keeps_its_result_only(spark):
    before = left(spark)
    out = settled(labels)(spark)
    new = set(left(spark)) - set(before)
    assert len(new) == 1 and new.pop().startswith("labels-") and out.count() == 41
    lazy = settled(lambda s: s.range(3))(spark)
    assert lazy.count() == 3 and len(left(spark)) == len(before) + 1


def test_core_queries_without_the_packages_of_the_subpackage():
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; names = set(e.queries()); assert 'p3_found' in names and 'p1_found' not in names and names >= set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
