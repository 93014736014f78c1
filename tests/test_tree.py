"""The tree source against os.walk, what filters leave unread, and its stream."""

from __future__ import annotations

import os
import random

from sparkloom.sources.tree import Tree, Wanted, register, tree


def make(root, n=60):
    r = random.Random(4)
    for i in range(n):
        folder = root.joinpath(*(r.choice("abc") for _ in range(r.randint(0, 4))))
        folder.mkdir(parents=True, exist_ok=True)
        folder.joinpath(r.choice([f"f{i}.py", f"f{i}.MD", f".h{i}", f"_p{i}.py", f"plain{i}"])).write_bytes(r.choice([b"", b"x\n" * i, b"\xff\xfe", "ä".encode()]))
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "node_modules" / "x" / "y.py").write_text("no")


def walked(root, exclude=()):
    out = {}
    for top, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in exclude]
        for n in names:
            p = os.path.join(top, n)
            out[os.path.relpath(p, root)] = (os.path.getsize(p), open(p, "rb").read().decode(errors="replace"))
    return out


def test_equals_walk(spark, tmp_path):
    make(tmp_path)
    for readers in (1, 5, 64):
        got = tree(spark, str(tmp_path), readers=readers).collect()
        assert {x["path"]: (x["size"], x["content"]) for x in got} == walked(tmp_path) and len(got) == len(walked(tmp_path))
    got = tree(spark, f"file:{tmp_path}", exclude="node_modules, a", contents=False).collect()
    want = walked(tmp_path, ("node_modules", "a"))
    assert {x["path"] for x in got} == set(want) and all(x["content"] is None for x in got)
    (tmp_path / "none").mkdir()
    assert tree(spark, str(tmp_path / "none")).count() == 0


def test_filters_reach_the_reader(spark, tmp_path):
    make(tmp_path)
    df = tree(spark, str(tmp_path))
    want = walked(tmp_path)
    for shown, kept in (
        (df.where("ending = 'py'"), lambda p: p.endswith(".py")),
        (df.where("ending IN ('py', 'md') AND path LIKE 'a/%'"), lambda p: p.lower().endswith((".py", ".md")) and p.startswith("a/")),
        (df.where("path LIKE '%.MD' AND size > 2"), lambda p: p.endswith(".MD") and want[p][0] > 2),
    ):
        assert {x["path"] for x in shown.collect()} == {p for p in want if kept(p)}
    plan = df.where("path LIKE 'a/b%'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter StartsWith(path" not in plan
    #: folders outside the beginning are no tasks
    folders = Tree({"path": str(tmp_path)}).folders(64, Wanted(starts=("a/b",)))
    assert all(f.path in ("", "a") or f.path.startswith("a/b") for f in folders) and folders


def test_unreadable_files_stay_closed(spark, tmp_path):
    (tmp_path / "a.py").write_text("1")
    os.mkfifo(tmp_path / "pipe.bin")  # opening it would never end
    assert [x["path"] for x in tree(spark, str(tmp_path)).where("ending = 'py'").collect()] == ["a.py"]


def test_stream_sees_each_change_once(spark, tmp_path):
    root, out, state = tmp_path / "t", str(tmp_path / "out"), str(tmp_path / "state")
    root.mkdir()
    register(spark)
    at = 1_700_000_000

    def put(name, text, when):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
        os.utime(root / name, (when, when))

    def run():
        q = spark.readStream.format("tree").option("lag", "0").load(str(root)).select("path", "content").writeStream.option("checkpointLocation", state).format("json").start(out)
        while not q.recentProgress and q.isActive:
            q.awaitTermination(1)
        q.stop()
        q.awaitTermination(60)
        return sorted((x["path"], x["content"]) for x in spark.read.schema("path string, content string").json(out).collect())

    put("a.py", "one", at)
    put("d/b.py", "two", at + 1)
    assert run() == [("a.py", "one"), ("d/b.py", "two")]
    (root / "a.py").write_text("three")
    assert run() == [("a.py", "one"), ("a.py", "three"), ("d/b.py", "two")]
