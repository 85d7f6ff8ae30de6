"""Ignore rules against a plain matcher and, where it is installed, git itself; walks with links, empty folders, errors."""

import os
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from lamina.sources import files, ignore

from .test_sources_and_streams import make


def plain_fits(glob, path):
    """Whether a glob without escapes and classes fits a whole path, by trying all ways."""
    if not glob:
        return not path
    if glob.startswith("**/"):
        return any(plain_fits(glob[3:], path[k:]) for k in range(len(path) + 1) if k == 0 or path[k - 1] == "/")
    if glob == "**":
        return bool(path)
    if glob.startswith("/**/"):
        return path.startswith("/") and plain_fits(glob[1:], path[1:])
    if glob == "/**":
        return path.startswith("/") and len(path) > 1
    if glob[0] == "*":
        return plain_fits(glob.lstrip("*"), path) or bool(path) and path[0] != "/" and plain_fits(glob, path[1:])
    if not path:
        return False
    return (glob[0] == path[0] or glob[0] == "?" and path[0] != "/") and plain_fits(glob[1:], path[1:])


def plain_ignored(path, lines):
    """Of a file: the last line that fits decides for each folder above it and for itself, from the top."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        out = False
        for line in lines:
            keeps, glob = line.startswith("!"), line.removeprefix("!")
            only_folders, glob = glob.endswith("/"), glob.rstrip("/")
            tied, glob = "/" in glob, glob.removeprefix("/")
            here = "/".join(parts[:n])
            if (n < len(parts) or not only_folders) and plain_fits(glob, here if tied else parts[n - 1]):
                out = not keeps
        if out:
            return True
    return False


PIECES = ["a", "b", "ab", "*", "?", "a*", "*.b", "**", "*a*"]


def random_lines(r):
    lines = []
    for _ in range(r.randrange(1, 6)):
        glob = "/".join(r.choice(PIECES) for _ in range(r.randrange(1, 4)))
        lines.append(r.choice(["", "", "!"]) + r.choice(["", "", "/"]) + glob + r.choice(["", "", "/"]))
    return lines


def random_paths(r, n):
    name = lambda: r.choice(["a", "b", "ab", "a.b", "x.b", "xa"])
    return sorted({"/".join(name() for _ in range(r.randrange(1, 5))) for _ in range(n)})


def test_rules_equal_a_plain_matcher(spark):
    r, cases = random.Random(1), []
    for _ in range(150):
        lines, paths = random_lines(r), random_paths(r, 12)
        cases.append((lines, paths, [plain_ignored(p, lines) for p in paths]))
    for lines, paths, want in cases:
        rules = ignore.Rules.of(lines)
        walk = [any(rules.verdict("/".join(p.split("/")[:n]), n <= p.count("/")) for n in range(1, p.count("/") + 2)) for p in paths]
        assert walk == want, (lines, paths)
    for lines, paths, want in cases[:12]:
        frame = spark.createDataFrame([*enumerate(paths)], "k int, path string")
        got = [x[0] for x in frame.select("k", ignore.ignored(F.col("path"), ignore.Rules.of(lines)).alias("x")).orderBy("k").select("x").collect()]
        assert got == want, lines


@pytest.mark.parametrize(
    ("line", "fits", "fails"),
    [
        ("src/*.log", ["src/a.log"], ["src/a/b.log", "a.log"]),
        ("*.log", ["src/a/b.log", "b.log"], ["b.logs"]),
        ("[!a-c]x", ["dx"], ["ax", "/x"]),
        ("[]-]x", ["]x", "-x"], ["ax"]),
        (r"\!x\ ", ["!x "], ["!x", "x "]),
        (r"\#x  ", ["#x"], ["x"]),
        ("x[", [], ["x[", "x"]),
        ("x\\", [], ["x\\", "x"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "b/a/c"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["ab", "x/a/b"]),
        ("**/b", ["b", "x/y/b"], ["xb"]),
        ("a**b", ["axb", "ab"], ["a/b"]),
        ("[a&&b]", ["&", "a"], ["&&"]),
        ("é.?", ["x/é.ü"], ["é."]),
        ("/top", ["top"], ["x/top"]),
    ],
)
def test_lines(spark, line, fits, fails):
    rules = ignore.Rules.of([line])
    assert [p for p in fits + fails if rules.verdict(p, False)] == fits
    rows = spark.createDataFrame([(p,) for p in fits + fails], "path string")
    direct = rows.where(ignore.ignored(F.col("path"), rules))
    assert {r.path for r in direct.collect()} >= {*fits}


def test_blank_lines_comments_and_empty_files():
    assert ignore.Rules.of(["", "   ", "# x", "!", "/", "\n"]).rules == ()
    assert ignore.Rules.of([]).verdict("x", False) is None


@pytest.mark.skipif(not shutil.which("git"), reason="git is not installed")
def test_walk_equals_git(spark, tmp_path):
    r = random.Random(7)
    for k in range(4):
        root = str(tmp_path / str(k))
        make(root, [p + ".f" for p in random_paths(r, 40)])
        subprocess.run(["git", "init", "-q", root], check=True)
        folders = [d for d, _, _ in os.walk(root) if "/.git" not in d]
        for folder in [root, *r.sample(folders, min(4, len(folders)))]:
            with open(os.path.join(folder, ".gitignore"), "w") as f:
                f.write("\n".join([*random_lines(r), "[ab].f", "# note", "", "*.b.f ", "!x?.f"]) + "\n")
        with open(os.path.join(root, ".git/info/exclude"), "w") as f:
            f.write("xa*\n")
        said = subprocess.run(["git", "-C", root, "-c", "core.excludesFile=/dev/null", "ls-files", "--others", "--exclude-standard", "-z"], capture_output=True, text=True, check=True).stdout
        got = {x.path for x in files.file_tree(spark, root, global_file="/dev/null").collect()}
        assert got == {*said.split("\0")} - {""}


def test_precedence_of_the_kinds_of_files(spark, tmp_path):
    root = str(tmp_path / "top/work")
    make(root, ["a.x", "b.x", "c.x", "d.x", "e.x", "sub/a.x", "sub/b.x", "inner/c.x", "inner/.git/HEAD", ".git/info/exclude"])
    write = lambda name, text: open(os.path.join(root, name), "w").write(text)  # noqa: E731, SIM115
    write(".ignore", "!a.x\n")
    write(".gitignore", "a.x\nc.x\n")
    write("sub/.gitignore", "!b.x\n")
    write(".git/info/exclude", "b.x\n!d.x\n")
    write("../everywhere", "d.x\ne.x\n")
    write("../.ignore", "sub/a.x\n")  # tied to the folder above: fits nothing here
    paths = lambda **more: {r.path for r in files.file_tree(spark, root, global_file=f"{tmp_path}/top/everywhere", **more).collect() if r.path.endswith(".x")}
    # inner is a repository of its own, which ends what the .gitignore above says
    assert paths() == {"a.x", "d.x", "sub/a.x", "sub/b.x", "inner/c.x"}
    assert paths(git_files=False) == {"a.x", "b.x", "c.x", "d.x", "e.x", "sub/a.x", "sub/b.x", "inner/c.x"}
    write("../.ignore", "work/sub/a.x\n")
    assert "sub/a.x" in paths()  # the nearer .ignore takes a.x back in
    write(".ignore", "")
    assert "sub/a.x" not in paths() and "a.x" not in paths()
    assert "sub/a.x" in paths(git_files=False, parents=False)


def test_git_files_need_a_work_tree(spark, tmp_path):
    root = str(tmp_path)
    make(root, ["a", "b"])
    with open(os.path.join(root, ".gitignore"), "w") as f:
        f.write("b\n")
    names = lambda **more: {r.path for r in files.file_tree(spark, root, global_file="/dev/null", **more).collect()}
    assert names() == {"a", "b", ".gitignore"} and names(require_git=False) == {"a", ".gitignore"}


def test_links_empty_folders_and_errors(spark, tmp_path):
    root = str(tmp_path / "r")
    make(root, ["f/x", "f/.hidden", "g/y"])
    os.makedirs(f"{root}/empty/inner")
    os.symlink("../f/x", f"{root}/g/link")
    os.symlink("..", f"{root}/g/up")
    os.symlink("nowhere", f"{root}/g/broken")
    tree = lambda **more: {r.path: r for r in files.tree_walk(spark, root, **more).collect()}
    assert set(tree()) == {"f/x", "g/y", "g/link", "g/up", "g/broken"}
    assert {k for k, r in tree().items() if r.mode & 0o170000 == 0o120000} == {"g/link", "g/up", "g/broken"}
    assert set(tree(follow_symlinks=True)) == {"f/x", "g/y", "g/link"}
    assert set(tree(include_empty_dirs=True)) - set(tree()) == {"empty/inner"} and tree(include_empty_dirs=True)["empty/inner"].mode & 0o040000
    assert {r.path for r in files.file_tree(spark, root).collect()} == {"f/x", "f/.hidden", "g/y"}
    walked = files.file_tree(spark, root, links=files.FOLLOW, errors=True)
    assert {r.path for r in walked.where("error is not null").collect()} == {"g/up", "g/broken"}
    assert tuple(files.scan_errors(walked).first()) == (4, 2)
