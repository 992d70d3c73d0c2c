"""Spreadsheets, repositories and trees of files, on files made here."""

import os
import random
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from patchloom.sources import files, patches

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>TOOL_R2</t></is></c><c r="E2" t="s"><v>4</v></c></row>
<row r="3"><c r="B3" t="s"><v>2</v></c><c r="C3" t="s"><v>3</v></c><c r="E3"><v>1.5</v></c></row><row r="4"/>
<row r="5"><c r="B5" t="inlineStr"><is><r><t>CVE-</t></r><r><t xml:space="preserve">2 </t></r></is></c><c r="D5" t="b"><v>1</v></c><c r="E5" t="e"><v>#N/A</v></c></row>
</sheetData></worksheet>"""
STRINGS = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>CVE_ID</t></si><si><t>patch</t></si><si><t>CVE-1</t></si>
<si><t>https://github.com/a/b/commit/abc1234
https://github.com/a/b/commit/def5678_x000D_</t></si><si><t> score </t></si></sst>"""
BOOK = """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="work" sheetId="1" r:id="rId7"/></sheets></workbook>"""
LINKS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/one.xml"/></Relationships>"""


def test_spreadsheet(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        for name, text in (("xl/worksheets/one.xml", SHEET), ("xl/sharedStrings.xml", STRINGS), ("xl/workbook.xml", BOOK), ("xl/_rels/workbook.xml.rels", LINKS)):
            z.writestr(name, text)
    got = files.read_sheets(spark, f"file://{tmp_path}/t.xlsx", "CVE_ID string, score double, absent int, patch string, TOOL_R2 string")
    assert [tuple(r) for r in got.collect()] == [("CVE-1", 1.5, None, "https://github.com/a/b/commit/abc1234\nhttps://github.com/a/b/commit/def5678\r", None), ("CVE-2 ", None, None, None, "1")]
    work = {r["CVE_ID"]: (r["pre_commit"], r["post_commit"]) for r in patches.work_items(files.read_sheets(spark, f"file://{tmp_path}/t.xlsx", patches.WORK, "work")).collect()}
    assert work["CVE-1"] == ("abc1234", "def5678")
    with pytest.raises(Exception, match="no sheet"):
        files.read_sheets(spark, f"file://{tmp_path}/t.xlsx", patches.WORK, "other").collect()


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """A repository with packed history, deltas among it, and one loose commit; the names of its commits."""
    at = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    rng = random.Random(1)
    lines = [f"line {rng.random()}" for _ in range(3000)]
    (at / "src/deep").mkdir(parents=True)
    commits = []
    for i in range(6):
        lines[i * 17] = f"changed {i}"
        (at / "src/deep/big file.c").write_text("\n".join(lines))
        (at / f"src/f{i}.c").write_bytes(b"int x;\xff\n" if i == 0 else f"int f{i};\n".encode())
        git("add", "-A")
        git("commit", "-qm", f"c{i}")
        commits.append(git("rev-parse", "HEAD"))
        if i == 4:
            git("gc", "-q")
    assert list(at.glob(".git/objects/pack/*.pack"))
    return str(at), commits, git


def test_blobs_at_commits(spark, repo):
    path, commits, git = repo
    objects = files.git_objects(spark, path, objects=8)
    assert objects.where("kind = 'commit'").select("sha").distinct().count() == len(commits)
    assert objects.rdd.getNumPartitions() > 17  # two ranges of the pack and more, and the folders of loose objects
    wanted = [(path, c, p, i) for i, c in enumerate(commits) for p in ("src/deep/big file.c", "./src//f1.c", "src/f5.c", "src/deep", "nothing", "", "src/f0.c/x")]
    wanted += [(path, commits[2][:9], "src/f2.c", 9), (path, "0" * 40, "src/f2.c", 9), (path, commits[0], "src/f0.c", 9), (None, commits[0], "src/f0.c", 9), (path, None, None, 9), (path, commits[2][:9], "src/f2.c", 9)]
    got = files.blobs_at(objects, spark.createDataFrame(wanted, "repo string, commit string, path string, i int")).collect()
    assert len(got) == len(wanted)
    for r in got:
        try:
            name = f"{r['commit']}:{os.path.normpath(r['path'])}"
            want = None if r["repo"] is None or git("cat-file", "-t", name) != "blob" else subprocess.run(["git", "-C", path, "cat-file", "blob", name], capture_output=True, check=True).stdout.decode("utf-8", "replace")
        except (subprocess.CalledProcessError, TypeError):
            want = None
        assert r["text"] == want, r
    assert sum(r["text"] is not None for r in got) == 6 + 5 + 1 + 3


def test_code_tree(spark, tmp_path):
    rows = [(f"a b/{i % 7}/f{i}.c", f"int f{i};\r\né") for i in range(40)] + [("top.h", None)]
    df = spark.createDataFrame(rows, "path string, text string").repartition(4)
    at = str(tmp_path / "tree")
    files.write_files(df, at)
    read = lambda: {os.path.relpath(os.path.join(d, f), at): open(os.path.join(d, f), "rb").read().decode() for d, _, fs in os.walk(at) for f in fs}
    assert read() == {p: t or "" for p, t in rows}
    files.write_files(df.withColumn("text", F.lit("new")), at)
    assert read() == {p: t or "" for p, t in rows}
    files.write_files(df.withColumn("text", F.lit("new")), at, overwrite=True)
    assert set(read().values()) == {"new"}
    assert patches.read_texts(spark, f"file://{at}", "UTF-8").where("text = 'new'").count() == len(rows)
    other = str(tmp_path / "other")
    for bad in ("../x.c", "/tmp/x.c", "a/../../x.c", "", None):
        with pytest.raises(Exception, match="no path below"):
            files.write_files(spark.createDataFrame([("ok.c", "1"), (bad, "2")], "path string, text string").coalesce(1), other)
        assert [f for _, _, fs in os.walk(other) for f in fs] == [] and not os.path.exists(tmp_path / "x.c")
