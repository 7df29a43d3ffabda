"""The index of a small project, from files to searches and traces."""

import json

import pytest

from quarry import cli
from quarry.plans import index
from quarry.plans.project import Project, ProjectError

AUTH = """import { saveUser } from './store';
import fs from 'fs';

// Checks who may come in.
export class AuthService {
  login(name: string) {
    const user = saveUser(name);
    return this.check(user);
  }
  check(user: any) {
    console.log(user);
    fs.readFileSync('x');
    return setTimeout(user);
  }
}
"""
STORE = """export function saveUser(name: string) {
  return normalize(name);
}
export const normalize = (s: string) => {
  return s.trim();
};
"""
TOOL = """import os
from util import shout

def main():
    print(shout("x"))
    return os.path.join("a", "b")
"""
UTIL = "def shout(x):\n    return x.upper()\n"


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/auth.ts").write_text(AUTH)
    (tmp_path / "src/store.ts").write_text(STORE)
    (tmp_path / "tool.py").write_text(TOOL)
    (tmp_path / "util.py").write_text(UTIL)
    (tmp_path / "notes.yaml").write_text("".join(f"k{i}: v\n" for i in range(600)))
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("function hidden() {}\n")
    (tmp_path / "bad.py").write_bytes(b"a = 1\0")
    (tmp_path / "latin.py").write_bytes(b"def latin():\n    return '\xe9'\n")
    (tmp_path / ".gitignore").write_text("ignored.py\n")
    (tmp_path / "ignored.py").write_text("def nope(): pass\n")
    return Project.init(tmp_path)


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_index_search_trace_and_update(spark, project, capsys):
    done = index.index(spark, project)
    assert done["indexed"] == 6 and done["skipped"] == 1 and done["deleted"] == 0
    assert project.status(spark).first()["verdict"] == "ok"
    chunks = {(r["symbol"], r["kind"]) for r in project.table(spark, "chunks").collect()}
    assert {("AuthService", "class"), ("login", "method"), ("saveUser", "function"), ("normalize", "function"), ("main", "function"), (None, "block")} <= chunks
    assert not {"hidden", "nope"} & {s for s, _ in chunks}
    windows = sorted((r["start_line"], r["end_line"]) for r in project.table(spark, "chunks").where("kind = 'block'").collect())
    assert windows == [(1, 500), (451, 600)]

    at = ["-C", str(project.root)]
    assert cli.run([*at, "search", "AuthService", "-t", "lexical", "-n", "3"]) == 0
    found = lines(capsys)
    assert found[0]["symbol"] == "AuthService" and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    assert cli.run([*at, "search", "saveUser", "--compact"]) == 0
    assert "snippet" not in lines(capsys)[0]
    assert cli.run([*at, "search", "zzzznothing", "-t", "lexical"]) == 2
    assert cli.run([*at, "search", "x", "--excerpt-lines", "0"]) == 1
    assert cli.run([*at, "search", 'open "quote', "-t", "lexical"]) == 1
    capsys.readouterr()

    assert cli.run([*at, "trace", "callers", "saveUser"]) == 0
    assert [(r["file"], r["symbol"]) for r in lines(capsys)] == [("src/auth.ts", "login")]
    assert cli.run([*at, "trace", "callees", "check"]) == 0
    kinds = {r["callee"]: r["kind"] for r in lines(capsys) if r["type"] == "callee"}
    assert kinds == {"log": "builtin", "readFileSync": "stdlib", "setTimeout": "builtin"}
    assert cli.run([*at, "trace", "callees", "main"]) == 0
    kinds = {r["callee"]: (r["kind"], r["file"]) for r in lines(capsys) if r["type"] == "callee"}
    assert kinds == {"print": ("builtin", None), "shout": ("project", "util.py"), "join": ("stdlib", None)}
    assert cli.run([*at, "trace", "graph", "login", "--format", "dot"]) == 0
    dot = capsys.readouterr().out
    assert '"login\\nsrc/auth.ts:6" -> "saveUser\\nsrc/store.ts:1"' in dot and "normalize" in dot
    assert cli.run([*at, "trace", "callees", "absent"]) == 1

    # nothing changed; then one file changes, one goes, one is new
    assert index.index(spark, project)["indexed"] == 0
    before = {r["path"]: r["file_id"] for r in project.table(spark, "files").collect()}
    (project.root / "util.py").write_text("def whisper(x):\n    return x\n")
    (project.root / "latin.py").unlink()
    (project.root / "extra.py").write_text("from util import whisper\ndef more():\n    return whisper(1)\n")
    done = index.index(spark, project)
    assert (done["indexed"], done["deleted"]) == (2, 1)
    after = {r["path"]: r["file_id"] for r in project.table(spark, "files").collect()}
    assert after["util.py"] == before["util.py"] and "latin.py" not in after and after["extra.py"] > max(before.values())
    assert project.status(spark).first()["verdict"] == "ok"
    capsys.readouterr()
    assert cli.run([*at, "trace", "callers", "whisper"]) == 0
    assert [r["file"] for r in lines(capsys)] == ["extra.py"]
    assert cli.run([*at, "search", "shout", "-t", "lexical"]) == 0  # still called in tool.py
    assert all(r["symbol"] != "shout" for r in lines(capsys))
    # a run that died makes the next one a full one
    project.begin()
    assert project.status(spark).first()["verdict"] == "dirty"
    assert index.index(spark, project)["indexed"] == 6 and not project.dirty()
    assert cli.run([*at, "clean", "-y"]) == 0 and project.manifest().version == 0


def test_projects(tmp_path):
    p = Project.init(tmp_path, "light")
    assert Project.find(tmp_path).root == p.root and p.config().profile == "light"
    with pytest.raises(ProjectError):
        Project.init(tmp_path)
    Project.init(tmp_path, force=True)


def test_nested_ignore_files(spark, tmp_path):
    """A folder's patterns hold below it, and the deeper file decides."""
    from quarry.sources import files

    tree = {
        ".gitignore": "*.gen.py\n/only_root.py\n", "a.gen.py": "", "only_root.py": "", "pkg/only_root.py": "",
        "pkg/.gitignore": "# local\nlocal.py\n/top.py\n!keep.gen.py\nsub/deep.py\n", "local.py": "", "top.py": "", "pkg/local.py": "", "pkg/in/local.py": "",
        "pkg/top.py": "", "pkg/in/top.py": "", "pkg/keep.gen.py": "", "pkg/in/keep.gen.py": "", "pkg/sub/deep.py": "", "sub/deep.py": "", "pkg/in/sub/deep.py": "",
        "pkg/in/.gitignore": "keep.gen.py\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text or "x = 1\n")
    found = files.listing(spark, str(tmp_path))
    kept = {"pkg/only_root.py", "local.py", "top.py", "pkg/in/top.py", "pkg/keep.gen.py", "sub/deep.py", "pkg/in/sub/deep.py"}
    assert {r["path"] for r in found.collect()} == kept
    read = files.contents(spark, str(tmp_path), found.where("path in ('local.py', 'top.py')"))
    assert sorted((r["path"], bytes(r["raw"])) for r in read.collect()) == [("local.py", b"x = 1\n"), ("top.py", b"x = 1\n")]
