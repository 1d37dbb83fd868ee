"""Release gates: a package that passes all, and one change for each way to offend one."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from oscine.operators import release
from oscine.sources import archives

P = release.Profile()
CELL = {"net": "CH9", "x_mm": "1.0"}


def _files():
    files = {f: b"text" for f in P.files if f != "manifest.json"}
    files["fab_notes.txt"] = ("\n".join(P.clauses) + " é").encode()
    files["fab_profile.yaml"] = ("name: x\nfab_notes:\n  required_keywords:\n" + "".join(f"    - word{k}\n" for k in range(10)) + "other: [1, 2]\n").encode()
    files["vip_vias.csv"] = (",".join(P.via_columns) + "\r\n" + "".join(",".join("1" for _ in P.via_columns) + "\r\n" for _ in range(14))).encode()
    files["order_checklist.txt"] = b"vippo, Microsection; no MATERIAL changes. Sign-off"
    files |= {f"gerbers/b{e}": e.encode() for e in P.layers} | {"drill/b.drl": b"drill"}
    return files


def _package(change=None, manifest=None):
    files = _files()
    if change:
        change(files)
    about = {"files": {n: hashlib.sha256(c).hexdigest() for n, c in files.items()}, "git_sha": "abc1234", "build_timestamp_utc": "2024-01-01T00:00:00Z", "build_inputs": {"board_sha256": "b" * 64}}
    if manifest:
        manifest(about)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
        if about:
            z.writestr("manifest.json", json.dumps(about))
    return out.getvalue()


def _put(name, content):
    return lambda f: f.__setitem__(name, content)


def _drop(name):
    return lambda f: f.pop(name)


NOTES = _files()
CHANGED = {
    "files": (_drop("README_FAB.md"), None, {"README_FAB.md"}), "layers": (_drop("gerbers/b.g2"), None, {".g2"}), "drill": (_drop("drill/b.drl"), None, {".drl"}),
    "clauses": (_put("fab_notes.txt", b"CLAUSE SM-1 CLAUSE VIP-1 CLAUSE FA-1"), None, {"CLAUSE SUB-1"}), "keywords": (_put("fab_profile.yaml", b"required_keywords: [a, b, c]\n"), None, {"10 keywords"}),
    "vias": (_put("vip_vias.csv", NOTES["vip_vias.csv"].replace(b"mask_state", b"mask").rsplit(b"\r\n", 2)[0]), None, {"mask_state", "14 rows"}), "checklist": (_put("order_checklist.txt", b"VIPPO microsection no material"), None, {"SIGN-OFF"}),
    "manifest": (None, lambda m: m["files"].update({"vip_vias.csv": "0" * 64, "gone.txt": "1" * 64}), {"vip_vias.csv differs", "gone.txt is not there"}),
    "unlisted": (None, lambda m: (m["files"].pop("README_FAB.md"), m["files"].pop("gerbers/b.gto"), m.pop("git_sha"), m.pop("build_timestamp_utc")), {"README_FAB.md", ".gto", "git_sha", "build_timestamp_utc"}),
    "commit": (None, lambda m: m.update(git_sha="other"), {"another commit"}), "empty": (None, lambda m: m.update(files={}), {"empty"}), "inputs": (None, lambda m: m.pop("build_inputs"), {"no build_inputs"}),
    "board": (None, lambda m: m["build_inputs"].update(board_sha256="c" * 64), {"another board"}), "baseline": (_put("gerbers/b.gts", b"moved"), None, {"gerbers/b.gts"}),
    "bare": (None, lambda m: m.clear(), {"no manifest"}),
}
GATE = {"unlisted": "manifest", "commit": "manifest", "empty": "manifest", "board": "inputs", "bare": "manifest"}
PROOF = b"IPC-4761 Type VII " * 10


def _repository(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def test_gates(spark):
    packages = [("good", bytearray(_package()))] + [(n, bytearray(_package(c, m))) for n, (c, m, _) in CHANGED.items()] + [("none", bytearray(b"no archive"))]
    members = archives.of(spark.createDataFrame(packages, "name string, content binary"), "name", "content")
    repository = _repository(spark, [(t, b"") for t in P.tools] + [("dfm/vippo_capability_acme_2024-01-02.txt", PROOF)])
    baseline = spark.createDataFrame([(f"gerbers/b{e}", hashlib.sha256(e.encode()).hexdigest()) for e in (".gts", ".gbs")] + [("gerbers/b.gtl", "0")], "path string, sha256 string")
    found = release.offenders(members, repository, baseline, "abc1234", "b" * 64)
    by = {}
    for r in found.collect():
        by.setdefault(r.archive, set()).add((r.gate, r["item"]))
    assert "good" not in by
    also = {"files": {("manifest", "README_FAB.md")}, "layers": {("manifest", ".g2")}, "bare": {("files", "manifest.json")}, "unlisted": set()}
    for name, (_, _, items) in CHANGED.items():
        assert by[name] == {(GATE.get(name, name), i) for i in items} | also.get(name, set()), name
    assert {g for g, _ in by["none"]} == {"files", "layers", "drill", "clauses", "manifest"}
    rows = {(r.archive, r.gate): (r.offenders, r.passed) for r in release.report(members, found).collect()}
    assert len(rows) == len(packages) * 12 and all(rows["good", g] == (0, True) for g in release.GATES) and rows["vias", "vias"] == (2, False)


@pytest.mark.parametrize("files,items", [([], {"no evidence file"}), ([("x/VIPPO_capability_a_20240102.pdf", b"1" * 50)], {"x/VIPPO_capability_a_20240102.pdf is too small"}), ([("vippo_capability_a_20240102.eml", b"Type VII" * 20)], {"vippo_capability_a_20240102.eml lacks IPC-4761"}), ([("vippo_capability_a.txt", PROOF)], {"no evidence file"})])
def test_evidence_beside_the_packages(spark, files, items):
    members = archives.of(spark.createDataFrame([("good", bytearray(_package()))], "name string, content binary"), "name", "content")
    found = release.offenders(members, _repository(spark, [(P.tools[0], b"")] + files))
    assert {(r.gate, r["item"]) for r in found.collect()} == {("tools", P.tools[1])} | {("evidence", i) for i in items}


def test_keyword_lists(spark):
    texts = {"required_keywords:\n- a\n- b\nnext:\n- c\n": 2, "a:\n  required_keywords:\n    # one\n    - a\n\n    - b": 2, "required_keywords: [a, b , c]": 3, "required_keywords: []": 0, "keywords:\n- a": 0}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", release._keywords(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts
