"""Configuration, files, strings, state, the dry run and the stream."""

import json

import numpy as np
import pytest

from windrow import config
from windrow.functions import audio, subtitles
from windrow.functions.text import ass_color
from windrow.operators import export, punctuation, scoring
from windrow.plans import lifecycle
from windrow.sources import external, views
from windrow.streaming import segments as stream

DATA = "/root/testdata/sf0.001"


def test_packs(tmp_path):
    doc = {"name": "mine", "extends": "prose", "markers": {"+stakes": ["Fire"], "curiosity": ["Why"], "nonsense": ["x"]}, "weights": {"stakes": 2, "other": 1}, "thresholds": {"payload_words": 3, "nope": 1}}
    path = tmp_path / "signals.json"
    path.write_text(json.dumps(doc))
    pack = config.load_pack(str(path), config.INDONESIAN)
    assert "fire" in pack.banks["stakes_markers"] and "are" in pack.banks["stakes_markers"]
    assert pack.bank("curiosity_markers") == ["why"] and pack.payload_words == 3 and pack.weights["stakes"] == 2 and "other" not in pack.weights
    assert config.load_pack(None, config.INDONESIAN) is config.INDONESIAN and set(config.INDONESIAN.banks) == set(config.BANKS)


def test_styles(tmp_path):
    path = tmp_path / "styles.json"
    path.write_text(json.dumps({"_note": 1, "punch": {"font_size": 80}, "own": {"glow": True}}))
    styles = config.load_styles(str(path))
    assert styles["punch"].font_size == 80 and styles["punch"].font == "Anton" and styles["own"].name == "own" and "_note" not in styles
    path.write_text(json.dumps({"own": {"nope": 1}}))
    with pytest.raises(ValueError, match="nope"):
        config.load_styles(str(path))
    path.write_text(json.dumps({"own": 3}))
    with pytest.raises(ValueError, match="object"):
        config.load_styles(str(path))
    assert config.Style().scaled(960).font_size == 32 and config.Style(left_margin_frac=0.0).margins() == (0.0, 0.06)


def test_lexicon_file(tmp_path):
    path = tmp_path / "lexicon.json"
    path.write_text(json.dumps({"exact": {"Teh": "the", "x y": "Xy"}, "vocabulary": ["The", "b"]}))
    lex = config.Lexicon.load(str(path))
    assert lex.exact["teh"] == "the" and lex.terms() == ["The", "b", "Xy"] and lex.prompt().endswith("The, b, Xy.") and config.Lexicon().prompt() == ""


def test_transcripts(spark, tmp_path):
    (tmp_path / "ep1.json").write_text(json.dumps({"segments": [{"start": 0, "end": 1.5, "text": "Hi."}], "words": [{"start": 0, "end": 1, "text": "Hi."}]}, indent=1))
    segments, words = views.read_transcripts(spark, str(tmp_path))
    assert tuple(segments.first()) == ("ep1", 0, 0.0, 1.5, "Hi.", None) and words.first().confidence == 1.0
    (tmp_path / "ep1.json").write_text(json.dumps([{"start": 2, "end": 3, "text": "B"}, {"start": 0, "end": 1, "text": "A", "speaker": "s"}]))
    assert [(r.episode_id, r.seg, r.text, r.speaker) for r in views.read_segments(spark, str(tmp_path)).collect()] == [("ep1", 0, "A", "s"), ("ep1", 1, "B", None)]
    (tmp_path / "ep1.json").write_text(json.dumps({"segments": []}))
    with pytest.raises(Exception, match="segments and words"):
        views.read_transcripts(spark, str(tmp_path))[0].collect()


def test_strings(spark):
    assert ass_color("#39FF6A") == "&H006AFF39" and ass_color("#000000", 160) == "&HA0000000"
    assert subtitles.target_size("9:16") == (1080, 1920) and subtitles.target_size("16:9", "720p") == (1280, 720) and subtitles.scaled_width(1919, 1080, 720) % 2 == 0
    assert subtitles.escaped_path("C:\\a'b") == "C\\:/a\\'b"
    assert "vstack=inputs=2" in subtitles.filter_graph("split", 1080, 1920, crops=[(0, 0, 10, 10)] * 2) and "boxblur" in subtitles.filter_graph("blur", 8, 8) and subtitles.filter_graph("crop", 8, 8, ass="a:b").endswith("[v]")
    assert "sendcmd" in subtitles.filter_graph("face", 8, 8, commands="c", scaled=16)
    style = config.Style(animation="rise", glow=True)
    assert subtitles.entrance(style, (5, 100)) == "{\\move(5,138,5,100,0,150)\\fad(150,0)}" and subtitles.entrance(config.Style(animation="pop")).startswith("{\\fscx60") and subtitles.entrance(config.Style()) == ""
    assert subtitles.glow_tag(style).startswith("{\\bord6.0") and subtitles.glow_tag(config.Style()) == ""
    assert "PlayResX: 1080" in subtitles.header(style, 1080, 1920) and subtitles.chars_per_line(1080, 60, 60, 64) == 30
    on, off = subtitles.word_tags(style)
    rows = spark.sql("SELECT named_struct('bold', false, 'italic', true, 'font', 'F', 'size', 9, 'color', '#112233') AS style UNION ALL SELECT NULL UNION ALL SELECT named_struct('bold', NULL, 'italic', false, 'font', '', 'size', 0, 'color', NULL)")
    got = [tuple(r) for r in rows.selectExpr(f"{on} AS a", f"{off} AS b").collect()]
    assert got == [("{\\b0\\i1\\fnF\\fs9\\c&H00332211}", "{\\b1\\i0\\fnMontserrat ExtraBold\\fs64\\c&H00FFFFFF}"), ("", ""), ("", "")]
    steps = spark.sql(f"SELECT {subtitles.typed('t', 'a', 'b', 150)} AS s FROM (SELECT 'a b' AS t, 1D AS a, 2D AS b)").first().s
    assert [(round(x.from_, 3), round(x.to_, 3), x.shown) for x in steps] == [(1, 1.075, "a"), (1.075, 2, "a b")]


def test_external(tmp_path):
    assert external.is_url(" HTTPS://x") and not external.is_url("ftp://x") and external.download_options("d")["noplaylist"]
    with pytest.raises(external.NotAvailable, match="render"):
        external.call("render")
    with pytest.raises(FileNotFoundError):
        external.resolve(str(tmp_path / "none.mp4"))
    external.plug("fetch", lambda url, options: url[-3:])
    assert external.resolve("http://a/b.c") == "b.c"
    external._plugged.clear()


def test_punctuation(spark):
    rows = [(1, 0, 0.0, 1.0, "so here", None), (1, 1, 1.2, 2.0, "we go", None), (1, 2, 2.35, 3.0, "", None), (1, 3, 4.0, 5.0, "end", None), (2, 0, 0.0, 1.0, "ok.", None), (2, 1, 1.0, 2.0, "left as is", None)]
    df = spark.createDataFrame(rows, "episode_id bigint, seg int, start double, end double, text string, speaker string")
    got = {(r.episode_id, r.seg): r.text for r in punctuation.restored(df).collect()}
    assert got == {(1, 0): "so here", (1, 1): "we go.", (1, 2): "", (1, 3): "end.", (2, 0): "ok.", (2, 1): "left as is"}


def test_audio(spark):
    assert abs(audio.mel_to_hz(audio.hz_to_mel(440.0)) - 440) < 1e-9 and audio.mel_filters(26, 512, 16_000).shape == (26, 257)
    t = np.arange(16_000) / 16_000
    assert audio.mfcc(np.sin(2 * np.pi * 440 * t)).shape == (98, 13)
    rows = spark.createDataFrame([(1, np.sin(2 * np.pi * 440 * t).tolist()), (2, [0.0] * 100), (3, None)], "id int, samples array<double>")
    got = {r.id: r.e for r in rows.select("id", audio.embedding("samples").alias("e")).collect()}
    assert len(got[1]) == 24 and got[2] is None and got[3] is None


def test_edits(spark):
    assert export.fingerprint({}) == "" and len(export.fingerprint({"gain_db": -3.0})) == 12 and export.fingerprint({"gain_db": -3.0, "x": 1}) == export.fingerprint({"gain_db": -3.0})
    clips = spark.createDataFrame([(1, 1, 0.0, 9.0), (1, 2, 10.0, 19.0)], "episode_id bigint, clip int, start double, end double")
    edits = export.edits(spark.createDataFrame([(1, "2", '{"start": 12.5, "odd": 1}')], "episode_id bigint, clip string, edit string"))
    assert {r.clip: r.start for r in export.edited(clips, edits).collect()} == {1: 0.0, 2: 12.5}
    bad = export.edits(spark.createDataFrame([(1, "2", '{"start": 18.5}')], "episode_id bigint, clip string, edit string"))
    with pytest.raises(Exception, match="long"):
        export.edited(clips, bad).collect()
    with pytest.raises(ValueError, match="unknown platforms"):
        export.platforms(spark, ("nope",))


def test_dry_run(spark, tmp_path):
    segments = views.derived_segments(spark, DATA)
    words = views.derived_words(segments)
    heard = []
    settings = lifecycle.Settings.of({"out": str(tmp_path / "out"), "clips": 2, "unknown": 1})
    first = lifecycle.dry_run(spark, segments, words, settings, on_progress=heard.append)
    clips = sorted(map(tuple, first.clips.collect()))
    assert clips and heard[0] == "features" and heard[-1] == "done"
    by = {}
    for e, _, _, _, s, z, score, _ in clips:
        by.setdefault(e, []).append((s, z))
        assert 0 <= score <= 10
    for own in by.values():
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
    assert all(r.duration >= 0.88 * (r.end - r.start) - 1e-6 for r in first.timelines.collect())
    assert first.packs.count() == len(clips) and first.plan.count() >= len(clips)
    again = lifecycle.dry_run(spark, segments, words, settings)
    assert sorted(map(tuple, again.clips.collect())) == clips
    with pytest.raises(lifecycle.Stopped):
        lifecycle.dry_run(spark, segments, words, settings, should_stop=lambda: True)
    # a clip that was turned down does not come back, not in the next run either
    picked = first.pool.join(first.clips.select("episode_id", "i", "j"), ["episode_id", "i", "j"]).orderBy("episode_id", "i").limit(1).select("episode_id", "i", "j", "start", "end").collect()
    gone = spark.createDataFrame(picked)
    key = (picked[0].episode_id, picked[0].i, picked[0].j)
    for rejected in (gone, None):
        later = {(r.episode_id, r.i, r.j) for r in lifecycle.dry_run(spark, segments, words, settings, rejected=rejected).clips.collect()}
        assert key not in later and any(e == key[0] for e, _, _ in later)
    assert export.State(spark, str(tmp_path / "none")).load() is None


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"episode_id": 1, "seg": k, "start": float(k), "end": k + 0.9, "text": "that is a line.", "speaker": None, "said_at": f"2024-01-01T00:{m:02d}:{k:02d}Z"} for k, m in enumerate([0, 0, 0, 5, 5, 30])]
    (src / "a.json").write_text("\n".join(map(json.dumps, lines)))
    live = stream.read(spark, str(src))
    q = stream.keep_features(live, config.PROSE, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    q = stream.speech_sessions(live).writeStream.outputMode("append").format("memory").queryName("runs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.segments, r.words) for r in spark.sql("SELECT * FROM runs ORDER BY start").collect()] == [(3, 12), (2, 8)]
    got = scoring.features(views.derived_segments(spark, DATA), config.PROSE)
    assert got.count() > 0


def test_vision(spark):
    from windrow.functions import vision

    flat = np.zeros((8, 8, 3), np.uint8)
    flat[:, :4] = (120, 150, 210)  # blue, green, red: skin
    flat[:, 4:] = (200, 40, 10)
    assert vision.skin_fraction(flat, 0, 0, 4, 8) == 1 and vision.skin_fraction(flat, 0, 0, 8, 8) == 0.5 and vision.skin_fraction(flat, 9, 9, 2, 2) == 0
    h = vision.hsv_histogram(flat)
    assert abs(np.linalg.norm(h) - 1) < 1e-9 and (h > 0).sum() == 2
    rows = spark.createDataFrame([(bytearray(flat.tobytes()), 8, 8), (None, 8, 8)], "data binary, h int, w int")
    got = [r.v for r in rows.select(vision.histogram("data", "h", "w").alias("v")).collect()]
    assert np.allclose(got[0], h) and got[1] is None
    patches = spark.createDataFrame([(1, k, k * 0.1, 0, p) for k, p in enumerate([[1.0, 1.0], [2.0, 4.0], [1.0]])], "episode_id bigint, k int, t double, seat int, pixels array<double>")
    assert [round(r.energy, 3) for r in sorted(vision.mouth_activity(patches).collect(), key=lambda r: r.k)] == [0, round(2 / 3, 3), 0]


def test_speakers(spark):
    from windrow.operators import speakers

    rng = np.random.default_rng(1)
    rows = [(1, k, float(k), k + 0.9, None if k % 9 == 4 else (rng.normal(0, 0.1, 6) + (5 if k % 2 else 0)).tolist()) for k in range(30)]
    got = sorted(speakers.diarized(spark.createDataFrame(rows, "episode_id bigint, seg int, start double, end double, embedding array<double>")).collect(), key=lambda r: r.turn)
    names = {k: {r.speaker for r in got if r.turn % 2 == k and r.turn % 9 != 4} for k in (0, 1)}
    assert all(len(v) == 1 for v in names.values()) and names[0] != names[1]
    assert all(got[k].speaker == got[k - 1].speaker for k in range(1, 30) if k % 9 == 4)
    same = speakers.agreement(spark.createDataFrame([(1, k % 3, "abc"[k % 3]) for k in range(12)], "episode_id bigint, a int, b string")).first()
    assert (same.share, same.ari) == (1, 1)
