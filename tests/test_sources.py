"""Readers and writers on small files."""

import json
import struct

import numpy as np
import pytest

from oscine.operators import relational
from oscine.sources import frames, reports, rhd, sinks, synthetic
from oscine.streaming import detector

REPORT = """** Drc report for x **
** Found 2 DRC violations **
[clearance]: Clearance violation (0.1 mm)
    @(10 mm, 20 mm): Track [VCC] on F.Cu
    @(11 mm, 20 mm): Pad 1 [GND] of U1 on [F.Cu]
[track_width]: Track too thin
    Track [SIG] on B.Cu
** Found 0 unconnected pads **
ignored [X]
** Found 0 Footprint errors **
"""


def test_reports(spark, tmp_path):
    (tmp_path / "a.rpt").write_text(REPORT)
    rows = reports.report_violations(spark, str(tmp_path / "a.rpt")).orderBy("block").collect()
    assert [(r.type, r.description, r.nets) for r in rows] == [("clearance", "Clearance violation (0.1 mm)", ["GND", "VCC"]), ("track_width", "Track too thin", ["SIG"])]
    assert reports.report_totals(spark, str(tmp_path / "a.rpt")).first().violations == 2
    (tmp_path / "b.rpt").write_text("nothing")
    with pytest.raises(Exception, match="no totals"):
        reports.report_totals(spark, str(tmp_path / "b.rpt")).collect()


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"violations": [{"type": "t", "severity": "error", "items": [{"description": "a"}, {"description": "b"}]}], "unconnected_items": [{"type": "u", "severity": "error", "items": []}]}))
    found = reports.check_json(spark, str(tmp_path / "a.json")).collect()
    assert sorted((r.bucket, r.type, r.item or "") for r in found) == [("unconnected_items", "u", ""), ("violations", "t", "a"), ("violations", "t", "b")]
    (tmp_path / "n.xml").write_text('<export><nets><net code="1" name="VCC"><node ref="U1" pin="1"/><node ref="C1" pin="2"/></net><net code="2" name="GND"><node ref="U1" pin="2"/></net></nets></export>')
    assert {tuple(r) for r in reports.netlist(spark, str(tmp_path / "n.xml")).collect()} == {("VCC", "U1", "1"), ("VCC", "C1", "2"), ("GND", "U1", "2")}


def test_board(spark, tmp_path):
    (tmp_path / "b.kicad_pcb").write_text('(kicad_pcb\n (segment\n  (start 1.5 2) (end 3 -4.25)\n  (width 0.2) (layer "F.Cu") (net 3) (uuid "a"))\n (via (at 7 8) (size 0.6) (drill 0.3) (layers "F.Cu" "B.Cu") (net 4)))')
    segments, vias = reports.board(spark, str(tmp_path / "b.kicad_pcb"))
    assert [tuple(r) for r in segments.collect()] == [(1.5, 2.0, 3.0, -4.25, 0.2, "F.Cu", 3)]
    assert [tuple(r) for r in vias.collect()] == [(7.0, 8.0, 0.6, 0.3, ["F.Cu", "B.Cu"], 4)]


def test_session_log(spark, tmp_path):
    (tmp_path / "s.csv").write_text("session,trial,perturbation_type,perturbation_level,onset_time_s,temperature_C,filename,notes\n1,2,drug,high,5,21.5,f.rhd,\n1,x,none,,,,,\n")
    rows = reports.session_log(spark, str(tmp_path / "s.csv")).collect()
    assert rows[0].perturbation == "drug" and rows[0].temperature_c == 21.5 and rows[1].trial is None


def test_sinks(spark, tmp_path):
    s = synthetic.recordings(spark, "baseline", 2, 2, 100.0, 1.0)
    sinks.recordings(s, str(tmp_path / "rec"))
    assert spark.read.parquet(str(tmp_path / "rec")).where("recording_id = 1").count() == 200
    listed = sinks.manifest(spark, str(tmp_path / "rec"))
    before = spark.createDataFrame(listed.collect(), listed.schema)
    assert before.count() >= 2
    victim = next((tmp_path / "rec").rglob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    (victim.parent / f".{victim.name}.crc").unlink(missing_ok=True)
    after = sinks.manifest(spark, str(tmp_path / "rec"))
    assert [r.change for r in relational.manifest_diff(before, after, "path", "sha256").collect()] == ["changed"]
    assert sinks.latest(spark, str(tmp_path / "rec")).endswith(victim.name)
    rows = frames.build(spark.createDataFrame([(1, 50, [3, -4])], "frame_id long, timestamp long, adc array<int>")).select("raw")
    sinks.frames_csv(frames.decode(rows), str(tmp_path / "csv"))
    line = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert (line.frame_id, line.ch01, line.ch02, line.crc_valid) == ("1", "3", "-4", "true")
    sinks.results_csv(spark.createDataFrame([(1, 1.0, [1]), (2, float("nan"), [2])], "i int, x double, y array<int>"), str(tmp_path / "res"))
    assert sorted(str(r.x) for r in spark.read.option("header", True).csv(str(tmp_path / "res")).collect()) == ["1.0", "None"]


BOARD = """(kicad_pcb (version 1)
  (net 0 "")
  (net 1 "GND")
  (net 2 "V(3)")
  (net_class "Default" "all" (clearance 0.2) (trace_width 0.25) (add_net "GND") (add_net "V(3)"))
  (setup (stackup (layer "F.Cu" (type "copper") (thickness 0.035)) (layer "dielectric 1" (type "core") (thickness 1.5) (material "FR4"))))
  (footprint "R_0402" (layer "F.Cu") (at 10 20 90)
    (property "Reference" "R1" (at 0 0))
    (pad "1" smd rect (at 1 0) (size 0.5 0.6) (layers "F.Cu" "F.Mask") (net 1 "GND"))
    (pad "2" smd rect (at -1 0) (size 0.5 0.6) (layers "F.Cu") (net 2 "V(3)")))
  (segment (start 1 2) (end 3 4) (width 0.25) (layer "F.Cu") (net 1))
  (via (at 5 6) (size 0.8) (drill 0.4) (layers "F.Cu" "B.Cu") (net 2))
  (zone (net 1) (net_name "GND") (layer "F.Cu") (connect_pads (clearance 0.3)) (polygon (pts (xy 0 0) (xy 10 0) (xy 10 5)))))
"""


def test_board_text(spark, tmp_path):
    path = str(tmp_path / "b.kicad_pcb")
    (tmp_path / "b.kicad_pcb").write_text(BOARD)
    segments, vias = reports.board(spark, path)
    assert [tuple(r) for r in segments.collect()] == [(1.0, 2.0, 3.0, 4.0, 0.25, "F.Cu", 1)]
    assert [tuple(r) for r in vias.collect()] == [(5.0, 6.0, 0.8, 0.4, ["F.Cu", "B.Cu"], 2)]
    pads = {r.pin: r for r in reports.pads(spark, path).collect()}
    assert (pads["1"].ref, pads["1"].kind, pads["1"].width, pads["1"].height, pads["1"].layers, pads["1"].net_name) == ("R1", "smd", 0.5, 0.6, ["F.Cu", "F.Mask"], "GND")
    assert (pads["1"].x, pads["1"].y) == (pytest.approx(10), pytest.approx(19)) and (pads["2"].x, pads["2"].y) == (pytest.approx(10), pytest.approx(21))
    assert {tuple(r) for r in reports.declared_nets(spark, path).collect()} == {(0, ""), (1, "GND"), (2, "V(3)")}
    c = reports.netclasses(spark, path).first()
    assert (c.name, c.clearance, c.width, c.nets) == ("Default", 0.2, 0.25, ["GND", "V(3)"])
    z = reports.zones(spark, path).first()
    assert (z.net, z.net_name, z.layers, z.clearance, [tuple(p) for p in z.corners]) == (1, "GND", ["F.Cu"], 0.3, [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0)])
    assert [(r.place, r.kind, r.thickness, r.material) for r in reports.stackup(spark, path).orderBy("place").collect()] == [(0, "copper", 0.035, None), (1, "core", 1.5, "FR4")]
    required = spark.createDataFrame([("R1", "1", "GND"), ("R1", "2", "GND"), ("U9", "1", "GND")], "ref string, pin string, net_name string")
    assert {(r.ref, r.pin, r.is_on) for r in reports.pads_off_net(required, reports.pads(spark, path)).collect()} == {("R1", "2", "V(3)"), ("U9", "1", None)}


def test_report_helpers(spark, tmp_path):
    (tmp_path / "a.rpt").write_text("** Found 1 DRC violations **\n[via]: Bad via\n    @(10.04 mm, -2.36 mm): Via [X] on F.Cu\n    @(1 mm, 2 mm): Track [Y] on F.Cu\n")
    found = reports.report_violations(spark, str(tmp_path / "a.rpt"))
    assert [(r.x, r.y) for r in reports.via_places(found).collect()] == [(10.0, -2.4)]
    nets = " ".join(f"[N{k}]" for k in range(1500))
    (tmp_path / "b.rpt").write_text(f"[many]: Nets\n    {nets}\n")
    assert len(reports.report_violations(spark, str(tmp_path / "b.rpt")).first().nets) == 1500
    report = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "bucket string, entry int")
    assert {(r.bucket, r.found, r.declared, r.agrees) for r in reports.conserved(report, {"a": 2, "c": 0, "b": 4}).collect()} == {("a", 2, 2, True), ("b", 1, 4, False), ("c", 0, 0, True)}
    texts = spark.createDataFrame([("The Warranty ends",), (None,)], "value string")
    assert {tuple(r) for r in reports.clauses(texts, ["warranty", "license"]).collect()} == {("warranty", True), ("license", False)}


def test_captures_in_pieces(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1000 + 10 * i, [(i * 7 + c) % 100 - 50 for c in range(64)]) for i in (0, 1, 2, 5, 6)], "frame_id long, timestamp long, adc array<int>")
    raw = [bytes(r.raw) for r in frames.build(rows).orderBy("frame_id").collect()]
    whole = b"junk\xa5" + b"".join(raw)
    for size in (1, 100, 255, 256, 257, 5000):
        pieces = [("dev", k, bytearray(whole[at : at + size])) for k, at in enumerate(range(0, len(whole), size))]
        df = spark.createDataFrame(pieces, "dev string, seq int, data binary")
        if size > 1:
            assert [bytes(r.raw) for r in frames.from_chunks(df, "dev", "seq", "data").orderBy("n").collect()] == raw
    rest, found = b"", []
    for at in range(len(whole)):  # byte by byte
        more, rest = frames.cut(rest + whole[at : at + 1])
        found += more
    assert found == raw
    (tmp_path / "a.bin").write_bytes(whole)
    decoded = frames.decode(frames.read(spark, str(tmp_path / "a.bin")))
    r = frames.capture_report(decoded).first()
    assert (r.frames, r.bad, r.first_id, r.last_id, r.dropped, r.time_violations) == (5, 0, 0, 6, 2, 0)
    assert r.drop_rate == pytest.approx(2 / 7)
    from oscine.sources import registry

    samples = registry.load(spark, str(tmp_path / "a.bin"))
    assert {x.fs for x in samples.collect()} == {20_000} and samples.count() == 5 * 64
    assert [x.uv for x in samples.where("channel = 3").orderBy("sample_idx").collect()] == pytest.approx([0.195 * ((i * 7 + 3) % 100 - 50) for i in (0, 1, 2, 5, 6)])
    with pytest.raises(ValueError, match="no reader"):
        registry.load(spark, "x.npz")
    (tmp_path / "empty.bin").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="no frame"):
        registry.load(spark, str(tmp_path / "empty.bin"))


def _stream(spark, rows, schema, folder, build):
    """What a stream over files of one batch of rows each writes in append mode."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        mode = "append" if build.__name__ == "frames_of_pieces" else "update"
        out = build(stream)
        writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch_id={i}")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def test_stream_of_pieces(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, [i] * 64) for i in range(6)], "frame_id long, timestamp long, adc array<int>")
    raw = [bytes(r.raw) for r in frames.build(rows).orderBy("frame_id").collect()]
    whole = b"xx" + b"".join(raw)
    pieces = [("dev", k, bytearray(whole[at : at + 200])) for k, at in enumerate(range(0, len(whole), 200))]

    def frames_of_pieces(stream):
        return detector.frames_of_pieces(stream, "dev", "seq", "data")

    found = _stream(spark, [pieces[:3], pieces[3:4], pieces[4:]], "dev string, seq int, data binary", str(tmp_path), frames_of_pieces)
    assert [bytes(r.raw) for r in sorted(found, key=lambda r: r.n)] == raw


def test_stream_counters_with_repeats_and_wrap(spark, tmp_path):
    top = (1 << 32) - 3
    batches = [[(top, True), (top + 1, True), (top + 1, True)], [(1, True), (2, False)], [(0, True), (5, True), (top, True)]]

    def counters(stream):
        return detector.frame_counters(stream, "dev")

    found = _stream(spark, [[("d", i, good) for i, good in b] for b in batches], "dev string, frame_id long, crc_valid boolean", str(tmp_path), counters)
    last = max(found, key=lambda r: r.seen)
    # good numbers: -3, -2, 0, 1, 5 about the wrap; -1, 2, 3 and 4 are missing
    assert (last.seen, last.bad, last.repeated, last.dropped) == (8, 1, 2, 4)


def test_streaming_cusum_equals_a_fold(spark):
    from oscine.plans import generated_queries as G

    folder = "/root/testdata/sf0.001"
    daily = {}
    for r in G.W.tumbling(G.samples(spark, folder), ["channel"], "day", rms=G.W.rms("uv")).collect():
        daily.setdefault(r.channel, []).append((r.day, r.rms))
    want = set()
    for channel, rows in daily.items():
        x = [v for _, v in sorted(rows)]
        mean = sum(x[:8]) / 8
        spread = (sum(v * v for v in x[:8]) / 8 - mean * mean) ** 0.5
        up = down = 0.0
        armed = True
        for i, v in enumerate(x[8:], 8):
            up, down = max(0.0, up + (v - mean) / spread - 0.5), max(0.0, down - (v - mean) / spread - 0.5)
            if armed and max(up, down) > 3.0:
                want.add((channel, i, round(max(up, down), 4)))
                armed = False
            elif max(up, down) <= 1.5:
                armed = True
    assert {(r.channel, r.window_idx, round(r.statistic, 4)) for r in G.streaming_cusum(spark, folder).collect()} == want and want


def test_trial_sheet_and_saved_models(spark, tmp_path):
    from oscine.operators import evaluation, learning

    order = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "a")], "session int, trial int, perturbation string")
    sinks.trial_sheet(order, str(tmp_path / "sheet"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sheet")).orderBy("trial").collect()
    assert [r.begins_session for r in back] == ["true", "false", "true"]
    rows = spark.createDataFrame([(float(i % 2), float(i % 2) + 0.01 * i) for i in range(40)], "label double, x double")
    model = learning.forest(rows, ["x"], "label", trees=5, depth=2)
    learning.save(model, str(tmp_path / "model"))
    learning.save(model, str(tmp_path / "model"))  # again, as after a failure
    again = learning.predicted(learning.load(str(tmp_path / "model")), rows)
    assert [r.label_hat for r in again.collect()] == [r.label_hat for r in learning.predicted(model, rows).collect()]
    shifts = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.7)], "model string, shift int, fpr double")
    held = spark.createDataFrame([("a", 0.1)], "model string, fpr double")
    assert [r.fpr for r in evaluation.with_holdout(shifts, held, ["model"], "fpr").orderBy("model", "shift").collect()] == [0.1, 0.1, 0.7]
    trials = spark.createDataFrame([("dose", "low"), ("dose", "high"), ("baseline", "")], "perturbation string, level string")
    assert (evaluation.of_trials(trials, "dose").count(), evaluation.of_trials(trials, "dose", "low").count()) == (2, 1)


SPLITS = [(700, None), (256, None), (4096, None), (100_000, None), (300, 2)]


@pytest.fixture()
def splits(spark, request):
    """Files are read in splits of so many bytes."""
    size, _ = request.param
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield size
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _captures():
    rng = np.random.default_rng(4)
    record = lambda: b"\xa5\x5a" + rng.integers(0, 256, 254).astype(np.uint8).tobytes()
    plain = b"".join(record() for _ in range(40))
    sync = b"\xa5\x5a"
    return {
        "plain": plain, "junk": b"\x00\xa5junk" + plain[:2560] + b"\n\xa5\xa5" + plain[2560:] + plain[:100], "inside": b"".join(sync + (rng.integers(0, 256, 100).astype(np.uint8).tobytes() + sync) * 2 + bytes(50) for _ in range(30)),
        "dense": sync * 2000, "edge": b"x" + (sync + bytes(252) + sync) * 20 + sync, "none": b"nothing here\r\n" * 50, "empty": b"", "short": sync + bytes(253), "ends": plain[:512] + sync,
        "mixed": b"".join([sync, b"\xa5", b"\x5a", bytes(90), b"abc"][rng.integers(5)] for _ in range(1500)),
    }


@pytest.mark.parametrize("splits", SPLITS, indirect=True)
def test_captures_in_splits(spark, tmp_path, splits):
    """Every file gives the records of the reader that sees it whole, at the same places, however it is split."""
    want = set()
    for name, content in _captures().items():
        (tmp_path / f"{name}.bin").write_bytes(content)
        at = content.find(b"\xa5\x5a")
        while 0 <= at <= len(content) - 256:
            want.add((name, at, content[at : at + 256]))
            at = content.find(b"\xa5\x5a", at + 256)
    df = frames.read(spark, str(tmp_path))
    found = df.collect()
    assert {(r.source.rsplit("/", 1)[1][:-4], r.pos, bytes(r.raw)) for r in found} == want and len(found) == len(want)
    if splits < 1000:
        from oscine.sources import byteranges

        assert byteranges.pieces(spark, str(tmp_path / "plain.bin"), b"\xa5\x5a").rdd.getNumPartitions() > 10


@pytest.mark.parametrize("splits", SPLITS, indirect=True)
def test_rhd_in_splits(spark, tmp_path, splits):
    def text(x):
        return struct.pack("<I", 2 * len(x)) + x.encode("utf-16-le") if x else struct.pack("<I", 0xFFFFFFFF)

    def write(name, channels, blocks, tail):
        head = struct.pack("<I", rhd.MAGIC) + struct.pack(rhd.FIXED, 2, 0, 20000.0, *[0] * 10) + text("") * 3 + struct.pack("<hh", 0, 0) + text("") + struct.pack("<h", 1)
        head += text("Port A") + text("A") + struct.pack(rhd.GROUP, 1, channels, channels)
        for i in range(channels):
            head += text(f"A-{i}") + text("") + struct.pack(rhd.CHANNEL, 0, 0, 0, 1, *[0] * 8)
        rng = np.random.default_rng(channels)
        codes = rng.integers(0, 65536, (blocks, channels, 128)).astype("<u2")
        codes[: blocks // 2] = 0x0A0A  # nothing but separators
        body = b"".join(np.arange(b * 128, (b + 1) * 128, dtype="<i4").tobytes() + codes[b].tobytes() for b in range(blocks))
        (tmp_path / name).write_bytes(head + body + tail)
        return {(name, c, b, b * 128, tuple(0.195 * (codes[b, c].astype(float) - 32768))) for b in range(blocks) for c in range(channels)}

    size = 128 * 4 + 2 * 128 * 2
    want = write("a.rhd", 2, 5, b"") | write("b.rhd", 3, 4, b"\n" * 7) | write("c.rhd", 2, 3, b"\0" * (size - 1)) | write("d.rhd", 1, 0, b"")
    found = rhd.read(spark, str(tmp_path)).collect()
    assert {(r.source.rsplit("/", 1)[1], r.channel, r.block_idx, r.start_idx, tuple(r.uv)) for r in found} == want and len(found) == len(want)


def test_stretches_of_a_stream_come_in_order(spark, tmp_path, monkeypatch):
    import json

    from oscine.plans import generated_queries as G

    monkeypatch.setattr(G.scratch, "folder", lambda spark, name: str(tmp_path / name))
    G.streaming_rms(spark, "/root/testdata/sf0.001")
    last = None
    for log in sorted((tmp_path / "stream/state/sources/0").glob("[0-9]*"), key=lambda f: int(f.name)):
        paths = [json.loads(line)["path"] for line in log.read_text().splitlines()[1:]]
        first, end = spark.read.parquet(*paths).selectExpr("min(ts)", "max(ts)").first()
        assert last is None or first > last
        last = end
    assert log.name == "3"


def test_spans_are_few_bytes():
    import numpy as np

    from oscine.streaming import detector

    rng = np.random.default_rng(3)
    for scale in (50, 5_000, 10**7, 10**11):
        spans, plain = detector._unpacked(b""), []
        for _ in range(4):
            numbers = rng.integers(-scale, scale, 300)
            plain, _ = detector.merged(plain, numbers)
            spans = detector._unpacked(detector._packed(detector._joined(spans, numbers)))
            assert spans.tolist() == plain
    assert len(detector._packed(np.arange(20_000, dtype=np.int64).reshape(-1, 2) * 7)) < 21_000
    assert len(detector._unpacked(detector._packed(np.zeros((0, 2), np.int64)))) == 0
