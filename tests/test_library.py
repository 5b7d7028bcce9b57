"""The library's own operators on hand-computed cases."""

from __future__ import annotations

import gzip
import json
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom import cli
from lexloom.functions import metrics
from lexloom.operators import dedup, html, plugins, scoring
from lexloom.plans import cleaning, config
from lexloom.sources import files, storage
from lexloom.streaming import texts as stream_texts


def scored(spark, *texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.asDict() for r in scoring.score(df, **options).orderBy("doc_id").collect()]


def test_metrics(spark):
    a, b, c, d, e, f = scored(spark, "あア漢a !", "x1\nx2\nx1\n\n \nx3\nx1", "abc123!!!", "One sentence only.", None, "buy buy buy cheap")
    assert [a[f"char_{k}"] for k in ("hiragana", "katakana", "kanji", "alnum", "other")] == pytest.approx([1 / 6] * 4 + [2 / 6])
    assert b["duplicate_line_ratio"] == pytest.approx(2 / 5)
    assert c["symbol_digit_ratio"] == pytest.approx(6 / 9)
    assert d["sentence_length_variance"] == 0 and d["avg_sentence_length"] == 18
    assert all(e[k] == 0 for k in scoring.NUMERIC) and e["detected_language"] is None
    assert f["seo_spam_score"] == 0.75
    x, y = scored(spark, "see <b>x</b> http://a.b/c d", "plain a<b", ad_keywords=["SEE"], ad_patterns=["x+"])
    assert x["has_residual_html"] and x["has_residual_url"] and not y["has_residual_html"] and not y["has_residual_url"]
    assert x["ad_keyword_ratio"] > 0 and y["ad_keyword_ratio"] == 0
    p, q = scored(spark, "A quick brown fox jumps over the lazy dog by the river", "aaaa bbbb cccc dddd")
    assert p["naturalness_score"] > 0.7 and q["naturalness_score"] < 0.5


WORD_CASES = {
    "これはテスト、ラーメンと ABC漢字 don't 3.14 foo_bar x": ["こ", "れ", "は", "テスト", "ラーメン", "と", "abc", "漢", "字", "don't", "3.14", "foo_bar", "x"],
    "foo,bar x;y 12:30 3:4 a:b 1,234.5 e.g. U.S.A. can’t 'quoted' a.1 1.a": ["foo", "bar", "x", "y", "12", "30", "3", "4", "a:b", "1,234.5", "e.g", "u.s.a", "can’t", "quoted", "a", "1", "1", "a"],
    "a1b2 _ _x x_ __ - a--b Straße ÉCOLE e\u0301a o\u200dk": ["a1b2", "_x", "x_", "a", "b", "straße", "école", "e\u0301a", "o\u200dk"],
    "": [],
}
SENTENCE_CASES = {
    "Hello there. This is 3.14 ok? yes! Fine": ["Hello there.", "This is 3.14 ok?", "yes!", "Fine"],
    "He met J. Smith, e.g. this one. \"Quoted.\" Next... and then? Yes": ["He met J.", "Smith, e.g. this one.", "\"Quoted.\"", "Next... and then?", "Yes"],
    "U.S.A. is. what (so.) Then!? No": ["U.S.A. is. what (so.)", "Then!?", "No"],
    "一つ。二つ！三つ": ["一つ。", "二つ！", "三つ"],
    "a\nb\r\n\n - \nc.": ["a", "b", "c."],
    "Wait?, no. 5 apples. 日本": ["Wait?, no. 5 apples.", "日本"],
    " . ! ": [],
}


def test_segmentation_by_hand():
    for text, want in WORD_CASES.items():
        assert metrics.words(text) == want, text
    for text, want in SENTENCE_CASES.items():
        assert metrics.sentence_lengths(text) == [len(x) for x in want], text


def test_plain_words_are_those_of_the_whole_rule():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("aBé1_.,:;'’· -ßİ\"") for _ in range(rng.randint(1, 14)))
        assert metrics.words(text, "İ" not in text) == metrics.words(text), text
    table = metrics._table()
    assert [bool(table[ord(c)] & 256) for c in "aé1_.:'- 日α\u0301"] == [False] * 9 + [True] * 3


def test_language(spark):
    ja, en, mixed, none = scored(spark, "これは日本語です", "this is English", "これは日本語の文章です abc", "123")
    assert (ja["detected_language"], en["detected_language"], mixed["detected_language"], none["detected_language"]) == ("ja", "en", "ja", None)
    assert mixed["language_mixed_ratio"] > 0 and ja["language_mixed_ratio"] == 0
    with pytest.raises(ValueError):
        scoring.score(spark.createDataFrame([("x",)], "text string"), allow=["xx"])
    clash = scoring.score(spark.createDataFrame([("x", 1, 2)], "text string, __w int, char_kanji int")).first()
    assert clash["__w"] == 1 and clash["char_kanji"] == 0.0


def test_ladder_and_rules(spark):
    df = spark.createDataFrame([("clean english text with several different words",), ("<p>markup",), ("x\nx\nx\nx",), ("日本語",), ("1 2 3",)], "text string")
    got = [r[0] for r in scoring.score(df).select(scoring.reason({"max_duplicate_line_ratio": 0.5, "reject_on_residual_html": True}, ["en", "JA"])).collect()]
    assert got == [None, "residual_html_detected", "duplicate_line_ratio_exceeded", None, "language_not_allowed"]
    leaf = lambda f, o, v: {"field": f, "op": o, "value": v}
    cases = [
        ({"all": []}, True), ({"any": []}, False), ({"not": leaf("detected_language", "in", ["ja"])}, True), (leaf("detected_language", "ne", "en"), True), (leaf("detected_language", "eq", "en"), False),
        (leaf("seo_spam_score", "gt", "x"), False), ({"not": leaf("seo_spam_score", "in", 3)}, True), (leaf("has_residual_html", "eq", False), True), (leaf("plugin:p", "gt", 0.5), True), (leaf("plugin:q", "lt", 9), False), ({"not": leaf("plugin:q", "lt", 9)}, True),
    ]
    one = scoring.score(spark.createDataFrame([("1 2 3",)], "text string")).withColumn("plugin_scores", F.expr("map('p', 0.9D)"))
    assert list(one.select(*(scoring.rule(r, "plugin_scores").alias(str(i)) for i, (r, _) in enumerate(cases))).first()) == [w for _, w in cases]
    with pytest.raises(ValueError, match="odd"):
        scoring.validate_rule("odd", leaf("nope", "lt", 1))


def test_scores_are_made_once_where_rows_are_filtered_by_them(spark):
    rows = spark.createDataFrame([(1, "plain words of a text"), (2, "a <b>tag</b> in it")], "doc_id long, text string").repartition(2)
    found = scoring.score(rows).withColumn("reason", scoring.reason({"reject_on_residual_html": True})).where("reason is not null")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.doc_id for r in found.collect()] == [2]


def test_statistics(spark):
    df = spark.createDataFrame([(float(i), "accepted") for i in range(1, 5)] + [(99.0, "error")], "avg_sentence_length double, outcome string")
    for m in scoring.NUMERIC:
        df = df if m in df.columns else df.withColumn(m, F.lit(0.0))
    row = scoring.statistics(df).where("metric = 'avg_sentence_length'").first()
    assert tuple(row)[1:] == (2.5, 1.25, 1.0, 4.0)
    assert scoring.statistics(df.limit(0)).where("mean = 0 and maximum = 0").count() == len(scoring.NUMERIC)


def test_minhash_arithmetic():
    assert dedup.fnv1a(b"hello") == 0xA430D84680AABD0B
    text = "héllo wörld 日本 😀 again"
    want = {dedup.fnv1a(text[i : i + 4].encode()) for i in range(len(text) - 3)}
    assert set(dedup._shingle_hashes(text, 4).tolist()) == want
    x = np.array(sorted(want), np.uint64) % np.uint64(dedup.PRIME)
    for a, b in dedup.coefficients(20):
        assert dedup._mulmod(a, x, b).tolist() == [(a * int(v) + b) % dedup.PRIME for v in x]


def test_signatures_take_memory_for_a_part_of_a_text_only():
    text = "".join(random.Random(5).choices("abcdefghij é日", k=1_000_000))
    tracemalloc.start()
    got = dedup.signature(text, 4, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    x = np.array(sorted({dedup.fnv1a(text[i : i + 8].encode()) % dedup.PRIME for i in range(len(text) - 7)}), np.uint64)
    assert got.tolist() == [int(dedup._mulmod(a, x, b).min()) for a, b in dedup.coefficients(4)]


def test_signatures_of_a_batch(monkeypatch):
    monkeypatch.setattr(dedup, "WINDOWS", 3)
    texts = ["", None, "abc", "abcdefgh", "abcdefghi", "héllo wörld 日本 😀 again"]
    family, want = dedup.coefficients(6), []
    for t in texts:
        h = [dedup.fnv1a((t or "")[i : i + 8].encode()) % dedup.PRIME for i in range(max(1, len(t or "") - 7))]
        want.append([min((a * x + b) % dedup.PRIME for x in h) if t else 0 for a, b in family])
    batch = pa.array(["left out", *texts]).slice(1)
    assert dedup.signatures(batch, 6, 8).to_pylist() == want


def test_near_dedup_is_the_sequential_one(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(60)]
    for i in range(60):
        if i % 12 == 0:
            base = [rng.choice(vocabulary) for _ in range(60)]
        base = [rng.choice(vocabulary) if rng.random() < 0.05 else w for w in base]  # chains of near copies
        rows.append((i, " ".join(base)))
    rows += [(60 + i, rows[i][1]) for i in range(0, 60, 3)]  # equal signatures
    got = {r.doc_id for r in dedup.near(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 0.6, 64, 16, 8).collect()}
    kept, dropped = [], set()
    for i, t in rows:
        s = dedup.signature(t, 64, 8)
        if any((s == k).sum() / 64 >= 0.6 and any((s[b : b + 4] == k[b : b + 4]).all() for b in range(0, 64, 4)) for k in kept):
            dropped.add(i)
        else:
            kept.append(s)
    assert got == dropped and 30 < len(got) < 75
    with pytest.raises(ValueError):
        dedup.validate(64, 7, 0.5)


def test_html():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b><p>three<ul><li>a<li>b</ul><div class='ad-banner'>buy</div><a href='u'>link</a></article><footer>f</footer>"
    assert html.render(page) == "Head\n\nOne two\n\nthree\n\na\nb\n\nlink"
    assert html.render(page, markdown=True, keep_links=True) == "# Head\n\nOne two\n\nthree\n\n- a\n- b\n\n[link](u)"
    assert html.render("<article class='share x'>gone</article>") == "" and html.render("<div class='main_nav'>stays</div>") == "stays"
    assert "buy" in html.render(page, strip_boilerplate=False) and html.render(None) == ""


def test_html_at_any_depth_and_size():
    page = "<nav>n</nav><script>s</script><ul><li>a<li><p>b</p></ul><a href=''>c</a>"
    want = html.render(f"<body>{page}", markdown=True, keep_links=True)
    assert want == "- a\n-\n\nb\n\n[c]()"
    for deep in (260, 20_000):
        assert html.render("<div>" * deep + page, markdown=True, keep_links=True) == want
    began = time.process_time()
    assert html.render("<p>a</p>" * 40_000).count("a") == 40_000
    html.render("<b>" * 40_000 + "</i>" * 40_000 + "<a href=x>" * 10_000)
    assert time.process_time() - began < 6


def write(path, data: bytes) -> str:
    path.write_bytes(data)
    return str(path)


def test_sources(spark, tmp_path):
    a = write(tmp_path / "a b.jsonl", b'{"text": "x", "n": 1, "u": null}\n\nnot json\n{"text": 5}\n{"other": 1}\n{"text": "y", "n": {"k": [1]}}\n')
    got = [(r.id, r.text, json.loads(r.meta)) for r in files.read(spark, "jsonl", [a], meta_fields=["n", "z"]).orderBy("ord").collect()]
    assert got == [(f"{a}:1", "x", {"n": 1}), (f"{a}:6", "y", {"n": {"k": [1]}})]
    b = write(tmp_path / "b.txt", "one\r\n\n \n二\n".encode() + b"bad \xff\nlater\n")
    rows = files.read(spark, "text", [b]).orderBy("ord").collect()
    assert [(r.id, r.text) for r in rows] == [(f"{b}:1", "one"), (f"{b}:4", "二"), (f"{b}:5", None)] and rows[-1].error
    c, blank = write(tmp_path / "c.html", b"<p>x\ny"), write(tmp_path / "d.html", b" \n")
    assert [(r.id, r.text) for r in files.read(spark, "html", [c, blank]).collect()] == [(c, "<p>x\ny")]
    assert files.discover([str(tmp_path / "*.html"), c, str(tmp_path / "none*")]) == [c, blank]
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>hi</p>"
    record = lambda kind, data, more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(data) + data + b"\r\n\r\n"
    data = record(b"warcinfo", b"x") + record(b"response", body, b"WARC-Target-URI: http://h/p\r\n") + record(b"response", b" ") + record(b"response", body)
    w, z, short = write(tmp_path / "w.warc", data), write(tmp_path / "z.warc.gz", gzip.compress(data[:60]) + gzip.compress(data[60:])), write(tmp_path / "s.warc", data[:-20])
    rows = files.read(spark, "warc", [w, z, short]).orderBy("ord").collect()
    assert [(r.id, r.text) for r in rows] == [("http://h/p", "<p>hi</p>"), (f"{w}:3", "<p>hi</p>"), ("http://h/p", "<p>hi</p>"), (f"{z}:3", "<p>hi</p>"), ("http://h/p", "<p>hi</p>"), (f"{short}:3", None)]
    assert files.read(spark, "text", []).count() == 0


def score_length(text, meta, config):
    return {"score": len(text), "accept": len(text) < config.get("most", 10), "reason": "long"}


def endless(text, meta, config):
    while True:
        time.sleep(0.01)


def stubborn(text, meta, config):
    while True:
        try:
            time.sleep(0.01)
        except Exception:
            pass


def greedy(text, meta, config):
    return {"score": len(bytearray(64 << 20))}


def test_plugins(spark):
    chain = lambda *p: [tuple(r[0]) for r in spark.createDataFrame([("short",), ("a long long text",), (None,)], "t string").select(plugins.chain(F.col("t"), F.lit("{}"), p)).collect()]
    p = {"name": "p", "path": "tests.test_library:score_length"}
    assert chain(p, p | {"name": "q", "config": {"most": 3}}) == [({"p": 5.0, "q": 5.0}, "plugin:q:long", None), ({"p": 16.0}, "plugin:p:long", None), ({"p": 0.0, "q": 0.0}, None, None)]
    assert all("timeout" in e for _, _, e in chain({"name": "x", "path": "tests.test_library:endless", "timeout_ms": 30}))
    assert all("timeout" in e for _, _, e in chain({"name": "x", "path": "tests.test_library:stubborn", "timeout_ms": 30}))
    assert all("memory" in e for _, _, e in chain({"name": "x", "path": "tests.test_library:greedy", "timeout_ms": 3000}))
    assert all("no attribute" in e for _, _, e in chain({"name": "x", "path": "tests.test_library:missing"}))
    for bad in ({"name": "", "path": "x"}, {"name": "x", "path": "m:f", "memory_limit_bytes": 0}):
        with pytest.raises(ValueError):
            plugins.validate([bad])


TOML = """
[input]
format = "jsonl"
paths = ["{dir}/in/*.jsonl"]
[output]
format = "{format}"
path = "{dir}/out"
write_rejected = true
[scoring.text_quality]
max_duplicate_line_ratio = 0.5
[filters.thresholds]
reject_on_residual_html = true
[dedup]
exact = true
minhash_lsh = true
similarity_threshold = 0.6
num_hashes = 64
num_bands = 16
shingle_size = 8
[runtime]
checkpoint_dir = "{dir}/state"
"""


@pytest.mark.parametrize("kind", ["jsonl", "parquet"])
def test_job(spark, tmp_path, kind):
    (tmp_path / "in").mkdir()
    (tmp_path / "state").mkdir()
    text = "The committee met on a rainy afternoon to discuss the new harbour and its cost to the town."
    lines = [text, text, text.replace("town", "city"), "An entirely different sentence about gardens and bees.", "<p>markup</p>", "x\nx\nx\nx"]
    (tmp_path / "in/a.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in lines))
    toml = TOML.format(dir=tmp_path, format=kind)
    (tmp_path / "c.toml").write_text(toml)
    dry = cli.main(["run", "--config", str(tmp_path / "c.toml"), "--dry-run"])
    assert dry["summary"]["accepted_records"] == 2 and not (tmp_path / "out").exists()
    first = cleaning.run(spark, config.load(toml)).report
    assert {k: v for k, v in first["summary"].items() if k != "elapsed_seconds"} == {"total_input_records": 6, "accepted_records": 2, "rejected_records": 4, "error_records": 0}
    assert first["rejection_reasons"] == {"duplicate_exact": 1, "duplicate_line_ratio_exceeded": 1, "duplicate_near_duplicate": 1, "residual_html_detected": 1}
    (tmp_path / "in/b.jsonl").write_text(json.dumps({"text": text}) + "\n" + json.dumps({"text": "A new line of text on quite another matter."}) + "\n")
    second = cleaning.run(spark, config.load(toml)).report
    assert second["summary"]["total_input_records"] == 8 and second["summary"]["accepted_records"] == 3 and second["rejection_reasons"]["duplicate_exact"] == 2
    out = spark.read.format("json" if kind == "jsonl" else "parquet").load(str(tmp_path / "out"))
    assert out.count() == 3 and json.loads((tmp_path / "out.stats.json").read_text())["summary"]["total_input_records"] == 8
    if kind == "jsonl":
        line = json.loads(out.sparkSession.read.text(str(tmp_path / "out")).first()[0])
        assert isinstance(line["meta"], dict) and set(line["scores"]["char_ratios"]) == {"hiragana", "katakana", "kanji", "alnum", "other"}
    assert set(second) == {"summary", "rejection_reasons", "score_distributions", "char_type_ratios_aggregate", "content_quality"}
    # a run that broke off after the manifest is completed by the next
    state = json.loads((tmp_path / "state/manifest.json").read_text())
    left = tmp_path / "out/_staged-x"
    left.mkdir()
    moved = next((tmp_path / "out").glob("part-*"))
    moved.rename(left / moved.name)
    storage.write_text(spark, str(tmp_path / "state/manifest.json"), json.dumps(state | {"staged": [[str(left), str(tmp_path / "out")]]}))
    assert cleaning.run(spark, config.load(toml)).report["summary"]["total_input_records"] == 8
    assert spark.read.format("json" if kind == "jsonl" else "parquet").load(str(tmp_path / "out")).count() == 3 and not left.exists()


def test_foreign_folders_are_refused(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/theirs.txt").write_text("x")
    with pytest.raises(FileExistsError):
        files.write(spark.range(3), "parquet", str(tmp_path / "out"))
    assert (tmp_path / "out/theirs.txt").read_text() == "x"
    for n in (3, 2):
        files.write(spark.range(n), "parquet", str(tmp_path / "ours"))
    files.write(spark.range(1), "parquet", str(tmp_path / "ours"), append=True)
    assert spark.read.parquet(str(tmp_path / "ours")).count() == 3


def test_lines_of_many_blocks_and_missing_files(spark, tmp_path):
    lines = [f"line {i}" for i in range(2000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_bytes("\n".join(lines[:900]).encode() + b"\n\xff\n" + b"x\n" * 900)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        a, b, gone = (str(tmp_path / x) for x in ("a.txt", "b.txt", "gone.txt"))
        rows = files.read(spark, "text", [a, b, gone]).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.id, r.text) for r in rows[:2000]] == [(f"{a}:{i + 1}", x) for i, x in enumerate(lines)]
    assert [(r.id, r.text) for r in rows[2000:2900]] == [(f"{b}:{i + 1}", x) for i, x in enumerate(lines[:900])]
    assert [(r.id, bool(r.error)) for r in rows[2900:]] == [(f"{b}:901", True), (gone, True)]
    with pytest.warns(UserWarning):
        assert files.discover([str(tmp_path / "*.none"), f"file://{tmp_path}/a*"], spark) == [f"{tmp_path}/a.txt"]


def test_config():
    base = '[input]\nformat = "text"\npaths = ["x"]\n[output]\nformat = "jsonl"\npath = "y"\n'
    assert config.load(base)["dedup"]["num_hashes"] == 128
    for bad in ('[scoring.language]\nallow = ["xx"]', "[scoring.text_quality]\nperplexity_enabled = true", '[scoring.content_quality]\nad_patterns = ["("]', "[dedup]\nminhash_lsh = true\nnum_bands = 7", "[runtime]\nbatch_size = 0", '[runtime]\nlog_level = "loud"', '[[filters.rules]]\nname = "r"\nwhen = {field = "seo_spam_score", op = "lt"}', '[[plugins]]\nname = ""\npath = "m:f"', '[[filters.rules]]\nname = "r"\nwhen = {field = "no", op = "lt", value = 1}'):
        with pytest.raises(ValueError):
            config.load(base + bad)
    with pytest.raises(ValueError):
        config.load(base.replace('"text"', '"yaml"'))
    a, b = config.load(base), config.load(base.replace('["x"]', '["z"]'))
    assert config.fingerprint(a) == config.fingerprint(b) != config.fingerprint(config.load(base + "[dedup]\nexact = true"))


def test_validate_extraction_and_shards(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("<b> " * 7 + f"http://h/{i} end")
    got = cleaning.validate_extraction(spark, [str(tmp_path)])
    assert got["files"] == got["files_with_html"] == got["files_with_urls"] == 3 and len(got["html_samples"]) == 10 and got["url_samples"] == [f"http://h/{i}" for i in range(3)]
    files.write(spark.range(5).coalesce(1), "jsonl", str(tmp_path / "shards"), shard_max_rows=2)
    assert sorted(sum(1 for _ in open(f)) for f in files.discover([str(tmp_path / "shards/part-*")])) == [1, 2, 2]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("".join(json.dumps({"text": t, "ts": "2024-01-01T00:00:00"}) + "\n" for t in ["good words here", "good words here", "<p>bad"]))
    source = spark.readStream.schema("text string, ts timestamp").json(str(tmp_path / "in"))
    query = stream_texts.accepted(source, {"reject_on_residual_html": True}, time_col="ts").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.text for r in spark.table("kept").collect()] == ["good words here"]
