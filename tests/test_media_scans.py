"""Kernels over pictures and sound, sources of raw media, and scans composed of them."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import media, music, render, tables
from tidemark.plans import projects
from tidemark.sources import config, frames

ICON = np.zeros((9, 9))
ICON[1:8, 1:8] = 200
ICON[3:6, 3:6] = 40
ICON[1:3, 4] = 90


def picture(icons, height=40, width=90, noise=0, rng=None):
    out = np.full((height, width, 3), 30, np.uint8)
    if noise:
        out += rng.integers(0, noise, out.shape).astype(np.uint8)
    for x, y in icons:
        out[y : y + 9, x : x + 9] = ICON[:, :, None]
    return out


def table(spark, shots, key="s"):
    return spark.createDataFrame([(key, t, p.shape[1], p.shape[0], bytearray(p.tobytes())) for t, p in shots], "source_id string, t double, width int, height int, pixels binary")


def test_edges_are_thin_and_found_where_they_are():
    x = np.zeros((20, 20))
    x[5:15, 6:16] = 255
    found = media.edges(x)
    ys, xs = np.nonzero(found)
    assert 30 <= len(ys) <= 48 and set(ys) <= {4, 5, 14, 15} | set(range(4, 16)) and not found[8:12, 9:13].any() and not found[:3].any()
    assert not media.edges(np.full((9, 9), 7.0)).any()
    faint = np.zeros((20, 20))
    faint[5:15, 6:16] = 10  # all gradients are below both bounds
    assert not media.edges(faint).any()


def test_shape_score_does_not_depend_on_brightness():
    assert media.edge_shape_score(ICON, ICON) == 1.0
    assert media.edge_shape_score(ICON * 0.4 + 50, ICON) > 0.95
    assert media.edge_shape_score(np.kron(ICON, np.ones((2, 2))), ICON) > 0.9  # another size
    bars = np.zeros((9, 9))
    bars[:, ::4] = 200
    assert media.edge_shape_score(bars, ICON) < media.edge_shape_score(ICON, ICON) - 0.3
    assert media.edge_shape_score(np.zeros((9, 9)), ICON) == 0.0 and media.edge_shape_score(np.zeros((0, 9)), ICON) == 0.0


def test_areas_are_means():
    x = np.arange(24, dtype=float).reshape(4, 6)
    assert np.allclose(media.area_resized(x, 2, 3), x.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resized(x, 4, 6), x) and np.isclose(media.area_resized(x, 3, 5).mean(), x.mean())


def test_lines_are_runs():
    m = np.array([[1, 1, 1, 0, 1, 1], [1, 0, 1, 1, 1, 1]], bool)
    assert media.opened_lines(m, 3).astype(int).tolist() == [[1, 1, 1, 0, 0, 0], [0, 0, 1, 1, 1, 1]]
    assert not media.opened_lines(m, 7).any()


def test_panel_structure_needs_names_or_outlines():
    plain = np.full((200, 300, 3), 40, np.uint8)
    red, lined = plain.copy(), plain.copy()
    red[100:120, 60:220] = (220, 30, 30)
    lined[95, 20:280] = lined[150, 20:280] = 230
    lined[95:150, 20] = lined[95:150, 279] = 230
    row = (100, 90, 160, 110)
    score = media.panel_structure
    assert score(plain, row) == 0.0 and 0.7 <= score(red, row) <= 0.72 + 1e-9 and 0.05 < score(lined, row) <= 0.28 + 1e-9
    yellow = plain.copy()
    yellow[100:120, 60:220] = (220, 180, 30)
    assert score(yellow, row) == 0.0


def test_states_count_the_fullest_row(spark):
    rng = np.random.default_rng(0)
    shots = [(0.0, picture([], noise=20, rng=rng)), (0.1, picture([(5, 10)])), (0.2, picture([(5, 10), (20, 11), (35, 10), (60, 28)], noise=10, rng=rng))]
    out = media.count_states(table(spark, shots), ["source_id"], [ICON], scales=(1.0,))
    assert [(r["present"], r["count"]) for r in out.orderBy("t").collect()] == [(False, 0), (True, 1), (True, 3)]
    strict = media.count_states(table(spark, shots), ["source_id"], [ICON], structure=0.5, scales=(1.0,))
    assert not any(r["present"] for r in strict.collect())


def test_two_passes_find_what_one_dense_pass_finds(spark):
    """Coarse frames miss single steps; the second pass looks at few frames and finds each of them."""
    at = lambda t: [(5 + 15 * k, 10) for k in range(sum(t >= x for x in (1.0, 3.05, 3.10, 6.0)))]
    shots = [(k / 20, picture(at(k / 20))) for k in range(160)]
    s = config.settings({"v6_coarse_fps": 2.0, "v6_refinement_radius_s": 0.5, "v6_panel_disappear_s": 1.0})
    found, sequences, counters = projects.two_pass_scan(table(spark, shots), [ICON], s, fps=20.0, scales=(1.0,))
    assert [(round(r["t"], 2), r["before"], r["after"], r["kind"]) for r in found.orderBy("t").collect()] == [(1.0, 0, 1, "OWN_KILL"), (3.05, 1, 2, "OWN_KILL"), (3.1, 2, 3, "OWN_KILL"), (6.0, 3, 4, "OWN_KILL")]
    c = counters.first()
    assert c["frames_scanned"] == 16 and 0 < c["dense_frames_scanned"] <= 21 and sequences.count() == 1


def test_template_scan_finds_rises(spark):
    shots = [(k / 10, picture([(5, 5)] if 10 <= k < 15 or k == 17 or k >= 40 else [])) for k in range(50)]
    found = projects.template_scan(table(spark, shots), [ICON], (0.0, 0.0, 0.5, 0.6), threshold=0.8, release=0.5)
    assert [round(r["t"], 1) for r in found.orderBy("t").collect()] == [1.0, 4.0]
    half = [np.kron(ICON, np.ones((2, 2)))]  # a template of a picture twice as high
    again = projects.template_scan(table(spark, shots), half, (0.0, 0.0, 0.5, 0.6), threshold=0.8, release=0.5, reference_height=80, height=40)
    assert again.count() == 2


def test_colour_frames_and_sound_are_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, (11, 4, 6, 3), dtype=np.uint8)
    (tmp_path / "v.rgb").write_bytes(raw.tobytes())
    spark.dataSource.register(frames.RawFrames)
    spark.dataSource.register(frames.RawSound)
    for path in (str(tmp_path / "v.rgb"), f"file://{tmp_path}/v.rgb"):
        read = spark.read.format("raw_frames").option("path", path).option("width", 6).option("height", 4).option("channels", 3).option("fps", 2)
        got = {r["frame_no"]: bytes(r["pixels"]) for r in read.option("framesPerPartition", 3).load().collect()}
        assert got == {k: raw[k].tobytes() for k in range(11)}
    part = read.option("start", 1).option("end", 4).option("every", 2).option("region", "1,0,4,2").option("framesPerPartition", 3).load().collect()
    assert {r["frame_no"]: bytes(r["pixels"]) for r in part} == {k: raw[k][0:2, 1:4].tobytes() for k in (2, 4, 6, 8)}
    sound = rng.integers(-32768, 32768, 1000, dtype=np.int16)
    (tmp_path / "a.s16").write_bytes(sound.tobytes())
    chunks = spark.read.format("raw_sound").option("path", str(tmp_path / "a.s16")).option("rate", 100).option("chunkSeconds", 3).option("overlap", 10).load().orderBy("start_s").collect()
    assert [(c["start_s"], len(c["samples"])) for c in chunks] == [(0.0, 310), (3.0, 310), (6.0, 310), (9.0, 100)]
    assert np.allclose(chunks[1]["samples"], sound[300:610] / 32768)
    (tmp_path / "cut.rgb").write_bytes(raw.tobytes()[:-1])
    with pytest.raises(Exception, match="within a frame"):
        spark.read.format("raw_frames").option("path", str(tmp_path / "cut.rgb")).option("width", 6).option("height", 4).option("channels", 3).option("fps", 2).load().collect()


def clicks(bpm, seconds, rate=22050, rng=None):
    x = rng.normal(0, 0.002, seconds * rate)
    for t in np.arange(0.5, seconds - 0.1, 60 / bpm):
        a = int(t * rate)
        x[a : a + 400] += np.sin(np.arange(400) * 0.3) * np.exp(-np.arange(400) / 80)
    return x


@pytest.mark.parametrize("bpm", [90, 120, 140])
def test_beats_of_a_click_track(spark, bpm):
    rng = np.random.default_rng(bpm)
    rows = [("a", clicks(bpm, 15, rng=rng).tolist(), 22050), ("silent", [0.0] * 22050, 22050), ("none", None, 22050), ("empty", [], 22050)]
    out = {r["k"]: r for r in music.analyse(spark.createDataFrame(rows, "k string, samples array<double>, rate int"), ["k"]).collect()}
    a = out["a"]
    assert abs(a["tempo"] - bpm) < 4 and a["duration"] == 15.0
    true = np.arange(0.5, 14.9, 60 / bpm)
    assert np.mean([min(abs(b - true)) < 0.06 for b in a["beats"]]) > 0.9 and np.mean([min(abs(np.array(a["onsets"]) - t)) < 0.06 for t in true]) > 0.9
    assert out["silent"]["tempo"] == 0.0 and out["none"]["beats"] == [] and out["empty"]["energy"] == []
    points, regions = music.structure(music.analyse(spark.createDataFrame(rows[:1], "k string, samples array<double>, rate int"), ["k"]), ["k"])
    kinds = {r["type"] for r in points.select("type").distinct().collect()}
    assert {"bar", "strong_beat", "beat"} <= kinds and regions.count() >= 1


def test_commands_are_run_and_failures_reported(spark, tmp_path):
    to = str(tmp_path / "made")
    rows = [(1, ["sh", "-c", f"echo ok > {to}"]), (2, ["sh", "-c", "echo bad >&2; exit 3"]), (3, ["/no/such/tool"]), (4, None), (5, ["sleep", "30"])]
    out = {r["id"]: (r["code"], r["message"]) for r in render.execute(spark.createDataFrame(rows, "id int, argv array<string>"), ["id"], timeout=2.0).collect()}
    assert out[1] == (0, "") and out[2] == (3, "bad") and out[3][0] == -1 and out[4] == (None, "") and out[5][0] == -1
    assert open(to).read() == "ok\n"


def test_mixes_are_refused_without_a_duration_or_channels(spark):
    one = spark.createDataFrame([(0.0,), (2.5,)], "d double")
    assert [r[0] is None for r in one.select(render.edit_mix("g", "m", 0.0, -14.0, "d")).collect()] == [True, False]
    assert one.select(render.project_mix("g", "m", 0.0, -14.0)).first()[0].endswith("TP=-1.0[aout]")
    with pytest.raises(ValueError):
        render.project_mix("g", "m", 0.0, -14.0, channels=3)


def test_window_commands(spark):
    w = spark.createDataFrame([("f.mp4", 1.5, 3.0), ("f.mp4", 3.0, 3.0)], "file_path string, start double, `end` double")
    argv = [r["argv"] for r in render.window_commands(w, "ffmpeg", F.lit("out.mp4")).collect()]
    assert argv[0][5:9] == ["-ss", "1.500", "-t", "1.500"] and argv[1] is None


def test_a_cluster_needs_a_shared_folder(spark):
    where = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="share"):
        tables.shared_dir(where)
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_percentiles_of_large_and_small_keys(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(size=1), "b": rng.normal(size=2), "c": rng.normal(size=9000), "d": rng.integers(0, 50, 20_000).astype(float), None: rng.normal(size=7)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None)], "k string, x double")
    wanted = {"m": (0.5, True), "p5": (0.05, True), "p95": (0.95, False), "lo": (0.0, True), "hi": (1.0, False)}
    got = {r["k"]: r for r in tables.percentiles(df, ["k"], F.col("x"), wanted).collect()}
    for k, vs in data.items():
        v = np.sort(vs)
        for name, (p, between) in wanted.items():
            want = np.quantile(v, p) if between else v[max(1, int(np.ceil(p * len(v) - 1e-12))) - 1]
            assert abs(got[k][name] - want) < 1e-9, (k, name)
    assert got["c"]["n"] == 9000 and set(got) == set(data)


def test_numbers_along_an_order(spark):
    df = spark.createDataFrame([(k * 7919 % 5000,) for k in range(5000)], "x int").repartition(7)
    assert [(r["x"], r["n"]) for r in tables.numbered(df, ["x"], "n").orderBy("x").collect()] == [(k, k + 1) for k in range(5000)]
