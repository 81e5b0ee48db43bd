import os
import subprocess
import sys
import textwrap
from types import SimpleNamespace

import pytest

from siftstone import session


def test_workers_get_the_package(tmp_path):
    """A function that imports the package runs on workers started elsewhere, without a path to it."""
    root = str(session.Path(session.__file__).resolve().parents[1])
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from siftstone.session import build_session
        from siftstone.operators import forest
        spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
        spark.sparkContext.setLogLevel("ERROR")
        rows = spark.range(200).selectExpr("id", "id % 7 AS a", "id % 11 AS b")
        print("scored", forest.score_rows(rows, ["id"], ["a", "b"], trees=5).where("anomaly > 0").count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "scored 200" in out.stdout, out.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    def fake(master, folder=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda *a: folder, set=lambda *a: None))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master))
        assert session.shared_folder(fake(master, "hdfs://x/y")) == "hdfs://x/y"
    assert session.shared_folder(fake("local[8]"))
