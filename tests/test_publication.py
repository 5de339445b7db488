"""Published folders, digests by executors and chains of contracts, on a path that only Spark's file systems can open."""

import hashlib
import json

import pytest

from palimpsest.sources import artifacts as R
from palimpsest.sources import publication as B


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A URI that open() does not reach, and the folder behind it."""
    folder = tmp_path_factory.mktemp("store")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.published.link./data", f"file://{folder}")
    return "viewfs://published/data", folder


def filled(folder, names=("a/b.bin", "a-b.bin", "ä ö/c.bin", "a/b/c.bin2", "z")):
    for i, n in enumerate(names):
        (folder / n).parent.mkdir(parents=True, exist_ok=True) if "/" in n else folder.mkdir(parents=True, exist_ok=True)
        (folder / n).write_bytes(bytes([i]) * (i * 1000))
    return folder


def test_digest_equals_the_drivers(spark, store, tmp_path):
    names = ("a/b.bin", "a-b.bin", "ä ö/c.bin", "a/c/d", "z")
    here, there = filled(tmp_path / "x", names), filled(store[1] / "x", names)
    wanted = R.folder_digest(here)
    assert B.digest(spark, str(here)) == wanted
    assert B.digest(spark, f"{store[0]}/x") == wanted
    (there / "_SUCCESS").write_text("a marker is not looked at")
    assert B.digest(spark, f"{store[0]}/x") == wanted
    (there / "z").write_bytes(b"changed")
    assert B.digest(spark, f"{store[0]}/x") != wanted
    assert B.digest(spark, f"{store[0]}/x/z") == hashlib.sha256(b"changed").hexdigest()
    (there / "a/b.bin").write_bytes(b"")
    assert B.digest(spark, f"{store[0]}/x/a/b.bin") == hashlib.sha256(b"").hexdigest()
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no files"):
        B.digest(spark, str(tmp_path / "empty"))


def test_published_folder(spark, store):
    uri, folder = store
    path = f"{uri}/deep/out"

    def fill(n):
        def run(at):
            spark.range(n).write.parquet(f"{at}/rows")
            return n

        return run

    assert B.publish(spark, path, fill(3)) == 3
    assert B.is_published(spark, path) and B.check_published(spark, path)
    with pytest.raises(FileExistsError):
        B.publish(spark, path, fill(4))

    def broken(at):
        fill(5)(at)
        raise RuntimeError("ended early")

    with pytest.raises(RuntimeError, match="ended early"):
        B.publish(spark, path, broken, force=True)
    assert spark.read.parquet(f"{path}/rows").count() == 3
    B.publish(spark, path, fill(6), force=True)
    assert spark.read.parquet(f"{path}/rows").count() == 6
    assert sorted(p.name for p in (folder / "deep").iterdir()) == ["out"]
    # what a run that ended before its marker left may be someone else's: it gives way with force alone
    (folder / "deep" / "out" / B.MARKER).unlink()
    with pytest.raises(ValueError, match="not complete"):
        B.check_published(spark, path)
    with pytest.raises(FileExistsError, match="no marker"):
        B.publish(spark, path, fill(7))
    B.publish(spark, path, fill(7), force=True)
    next((folder / "deep" / "out" / "rows").glob("part-*")).unlink()
    with pytest.raises(ValueError, match="was changed"):
        B.check_published(spark, path)


def test_local_path_of_a_cluster(spark, tmp_path, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {"spark.checkpoint.dir": self.shared} if self.shared else {}

        def __getattr__(self, name):
            return getattr(spark.sparkContext, name)

    context = Context()
    context.shared = None

    class Session:
        sparkContext = context

    with pytest.raises(ValueError, match="do not share"):
        B.publish(Session(), str(tmp_path / "out"), lambda at: None)
    context.shared = f"file://{tmp_path}/shared"
    with pytest.raises(ValueError, match="do not share"):
        B.shared_path(Session(), str(tmp_path / "shared2" / "out"))
    assert B.shared_path(Session(), str(tmp_path / "shared" / "out")).endswith("/shared/out")


def test_chain_of_contracts(spark, store):
    uri, folder = store

    def step(name, inputs):
        (folder / name).mkdir()
        (folder / name / "rows").write_text(name)
        B.put_contract(spark, f"{uri}/{name}", B.contract(spark, name, {"seed": 1}, {k: f"{uri}/{k}" for k in inputs}))
        return json.loads(B.get_text(spark, f"{uri}/{name}/{B.CONTRACT}"))

    (folder / "source").mkdir()
    (folder / "source" / "rows").write_text("source")
    step("first", ["source"])
    step("left", ["first"])
    step("right", ["first"])
    last = step("last", ["left", "right"])
    assert B.check_chain(spark, last) == ["first", "left", "right", "last"]
    with pytest.raises(ValueError, match="^last: contract was changed"):
        B.check_chain(spark, last | {"settings": {"seed": 2}})
    # a changed ancestor is found behind links that are whole by themselves
    (folder / "source" / "rows").write_text("changed")
    with pytest.raises(ValueError, match="^first < left < last: input source was changed"):
        B.check_chain(spark, last)
    (folder / "source" / "rows").write_text("source")
    (folder / "right" / "rows").unlink()
    with pytest.raises(ValueError, match="^last: input right was changed"):
        B.check_chain(spark, last)
    (folder / "source" / "rows").unlink()
    (folder / "source").rmdir()
    with pytest.raises(ValueError, match="^first < left < last: input source is gone"):
        B.check_chain(spark, last)
