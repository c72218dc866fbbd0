from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import grouping, ranking
from tessera.operators.components import components
from tessera.plans.classify import classify
from tessera.plans.policy import Policy, default_policy
from tessera.plans.run import check_paths, payload, run_pipeline
from tessera.scratch import Scratch
from tests.test_binary import chunk, png


def generation(prompt: str, seed: int, sampler: str, steps: int, cfg: str, software: bool = True, note: str = "") -> bytes:
    text = f"{prompt}\nNegative prompt: blurry\nSteps: {steps}, Sampler: {sampler}, CFG scale: {cfg}, Seed: {seed}, Model: nai-diffusion-4"
    chunks = [chunk(b"tEXt", b"parameters\0" + text.encode("latin-1")), chunk(b"tEXt", b"Comment\0" + json.dumps({"char_prompts": note or prompt}).encode())]
    return png(*chunks, *([chunk(b"tEXt", b"Software\0NovelAI")] if software else []))


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "in"
    style = "soft pastel palette delicate brushwork luminous background"
    for name, data in {
        "a/miku_001.png": generation(f"hatsune miku singing, {style}", 123456789, "k_euler", 28, "6.5"), "a/variants/miku_001.png": generation(f"hatsune miku dancing, {style}", 987654321, "k_euler_a", 24, "5.5", False),
        "c/hero_001.png": generation("silver hair red eyes black armor knight, stern heroic mural bold lines", 222222222, "k_euler", 22, "5.0"), "c/hero_002.PNG": generation("silver hair red eyes black armor knight standing, stern heroic mural bold lines", 333333333, "k_euler", 23, "5.2"),
        "a/notes.txt": b"skip me", "b/broken.webp": b"this is no webp",
    }.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(data)
    return src


def test_end_to_end(spark, tree, tmp_path):
    policy, out = default_policy(), tmp_path / "out"
    run = run_pipeline(spark, tree, out, policy)
    rows = {r["file_path"].split("/in/")[1]: r for r in run.images.collect()}
    assert run.summary["summary"]["scan"] == {"visited_files": 6, "candidate_files": 5, "valid_images": 4, "skipped_files": 1, "invalid_images": 1}
    m = rows["a/miku_001.png"]
    assert (int(m["seed"]), m["sampler"], m["steps"], m["cfg_scale"], m["model"], m["software"]) == (123456789, "k_euler", 28, 6.5, "nai-diffusion-4", "NovelAI")
    assert rows["a/variants/miku_001.png"]["software"] is None
    label = lambda p, k: rows[p]["categories"][k]["category_label"]
    assert label("a/miku_001.png", 1) == label("a/variants/miku_001.png", 1) == "Character_Miku"
    assert label("c/hero_001.png", 1) == label("c/hero_002.PNG", 1) == "은발붉은눈검은갑옷기사"
    assert label("c/hero_001.png", 0) == "StyleFamily_001" and label("a/miku_001.png", 0) == "StyleFamily_002"
    assert label("b/broken.webp", 0) == "Style_Unknown" and rows["b/broken.webp"]["issues"] == ["invalid_image_header"]
    assert label("a/miku_001.png", 2).startswith("near_duplicate_")
    names = {e["relative_output_path"].rpartition("/")[2] for e in json.loads((out / "manifest.json").read_text())["entries"]}
    assert {"miku_001.png", "miku_001_1.png"} <= names
    shown = payload(run, out)
    assert len(shown["report_preview"]) == 5 and len(shown["report_preview"][0]) == 30 and shown["run_log_preview"]
    assert (out / "report.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    # Copies; a second run keeps what is there.
    run_pipeline(spark, tree, out, policy, "copy")
    again = run_pipeline(spark, tree, out, policy, "copy")
    assert again.summary["summary"]["organization"]["preserved_existing_files"] == 5 and again.summary["summary"]["organization"]["copied_files"] == 5
    assert sum(1 for p in (out / "Sorted").rglob("*") if p.is_file()) == 10 and len(list(tree.rglob("*.png"))) == 3


def test_guards(tmp_path, spark):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for source, output, said in ((tmp_path / "none", tmp_path / "x", "does not exist"), (tmp_path / "a", tmp_path / "a", "must be different"), (tmp_path / "a", tmp_path / "a" / "b", "inside Source Root"), (tmp_path / "a" / "b", tmp_path / "a", "inside Output Root")):
        with pytest.raises(ValueError, match=said):
            check_paths(source, output)
    with pytest.raises(ValueError, match="Move mode is disabled"):
        run_pipeline(spark, tmp_path / "a", tmp_path / "x", default_policy(), "move")
    with pytest.raises(ValueError, match="required"):
        run_pipeline(spark, " ", tmp_path / "x", default_policy())


def test_policy(tmp_path):
    p = Policy.load_or_create(tmp_path / "p.json")
    assert p == Policy.load(tmp_path / "p.json") == default_policy()
    axis = {"priority": 1, "criterion": "style"}
    for bad in ({"axes": []}, {"axes": [axis | {"priority": 2}]}, {"axes": [axis, {"priority": 2, "criterion": "style"}]}, {"axes": [axis], "nsfw_threshold": 2}, {"axes": [axis], "similarity_threshold": -1}, {"axes": [axis], "execution_mode": "fly"}):
        with pytest.raises(ValueError):
            Policy.of(bad)
    assert Policy.of({"axes": [axis]}).similarity_threshold == 10.0


def test_families(spark):
    rows = [("1", "b.png", "glowing neon skyline vivid contrast rain", ["blue hair blue eyes white dress girl"]), ("2", "a.png", "glowing neon skyline vivid contrast fog", ["blue hair blue eyes white dress girl smiling"]), ("3", "c.png", "quiet meadow", [])]
    df = spark.createDataFrame(rows, "image_id string, file_name string, prompt string, character_prompts array<string>")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("negative_prompt", "artist", "model", "perceptual_hash")} | {"dominant_tags": F.array().cast("array<string>"), "extra": F.struct(F.lit(None).cast("string").alias("style_signature"))})
    policy = default_policy(extra_rules={"character_keywords": {}})
    got = {r["image_id"]: [c["category_label"] for c in r["categories"]] for r in classify(df, policy, Scratch(spark, "t")).collect()}
    assert got["1"] == got["2"] == ["StyleFamily_001", "푸른머리푸른눈하얀드레스소녀", "unique"] and got["3"] == ["Style_Unknown", "Character_Unknown", "unique"]


def group_rows(spark):
    v = lambda a: [float(x) for x in a]
    rows = [
        ("a", ["p"], "s1", "00000000000000ff", "0f", v((1, 0)), ["cat", "dog"], "m", 0, 4, 4, 10, "z.png"), ("b", ["p"], "s1", None, None, None, [], None, 1, 9, 9, 10, "y.png"), ("c", ["p"], "s3", "0000000000ffff00", "0f", v((1, 0)), [], None, 0, 4, 4, 10, "x.png"),
        ("d", ["p"], "s4", "0000000000fffe00", "0f", v((0, 1)), [], None, 0, 4, 4, 9, "x.png"), ("e", ["p"], "s5", None, None, v((1, 1)), ["one", "two", "three"], None, 0, 1, 1, 1, "e.png"), ("f", ["p"], "s6", None, None, None, ["one", "two", "three"], "m", 0, 1, 1, 1, "f.png"),
        ("g", ["p"], "s7", None, None, None, [], "k", 0, 1, 1, 1, "g.png"), ("h", ["p"], "s8", None, None, None, ["x"], "k", 0, 1, 1, 1, "h.png"), ("i", ["p"], "s9", "ffffffffffffffff", "ff00", v((3, 4)), [], None, 0, 1, 1, 1, "i.png"),
        ("j", ["p"], "s10", "1234567812345678", "aa00ff", v((6, 8)), [], None, 0, 1, 1, 1, "j.png"), ("k", ["p"], None, None, None, None, [], None, 0, None, None, 1, "k.png"), ("l", ["o"], "s1", None, None, None, [], None, 0, 1, 1, 1, "l.png"),
    ]
    schema = "image_id string, path array<string>, checksum string, perceptual_hash string, difference_hash string, embedding array<double>, tokens array<string>, series string, n_issues int, width int, height int, size bigint, file_name string"
    return spark.createDataFrame(rows, schema)


def test_cascade(spark):
    rows, scratch = group_rows(spark), Scratch(spark, "t")
    clustered = grouping.cascade(rows, grouping.Thresholds(), scratch)
    kinds = {r["image_id"]: r["group_type"] for r in clustered.collect()}
    want = dict(zip("abcdefghijkl", ["exact_duplicate"] * 2 + ["near_duplicate"] * 2 + ["same_prompt_family"] * 2 + ["same_model_series"] * 2 + ["visual_similar"] * 2 + ["unique"] * 2))
    assert kinds == want
    groups = grouping.numbered(clustered, Scratch(spark, "t"))
    ids = {r["group_id"]: (r["representative"], r["index"]) for r in groups.collect() if r["path"] == ["p"]}
    assert ids == {"exact_duplicate_002": ("a", 2), "near_duplicate_003": ("c", 3), "same_prompt_family_004": ("e", 4), "same_model_series_005": ("g", 5), "visual_similar_006": ("i", 6), "unique": ("k", 7)}
    score = {r["image_id"]: r["relation_score"] for r in grouping.members(clustered, groups).collect()}
    assert score["d"] == round(1 - 0.5 / 64, 4) and score["b"] == 1.0 and score["f"] == 1.0 and score["h"] == 1.0 and score["j"] == 1.0 and score["k"] is None
    by_bucket = {r["image_id"]: r["group_type"] for r in grouping.cascade_by_bucket(rows, grouping.Thresholds()).collect()}
    assert by_bucket == want


def test_collisions(spark):
    rows = spark.createDataFrame([("1", "d", "a.png"), ("2", "d", "a.png"), ("3", "d", "a_1.png"), ("4", "e", "a.png"), ("5", "d", "b.png"), ("6", "d", ".x"), ("7", "d", ".x")], "id string, d string, n string")
    old = spark.createDataFrame([("d", "b.png"), ("d", "b_1.png")], "d string, n string")
    got = {r["id"]: (r["resolved"], r["met_existing"]) for r in ranking.rename_collisions(rows, "d", "n", ["id"], old).collect()}
    assert got == {"1": ("a.png", False), "2": ("a_1.png", False), "3": ("a_1_1.png", False), "4": ("a.png", False), "5": ("b_2.png", True), "6": (".x", False), "7": (".x_1", False)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (95, 95), (7, 3), (None, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 90, 90: 90, 95: 90}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).count() == 0


def test_incremental(spark, tree, tmp_path):
    from tessera.streaming.incremental import append_new

    args = (spark, str(tree), str(tmp_path / "t"), str(tmp_path / "c"), [".png", ".webp"])
    assert append_new(*args) == 5
    (tree / "more.png").write_bytes(png())
    assert append_new(*args) == 6


def test_demo_run(spark, tmp_path):
    """A run over the demo tree: counters of every stage, and names that the package exports."""
    import tessera

    run = tessera.run_pipeline(spark, None, tmp_path / "out", tessera.default_policy(), use_demo_input=True)
    told = run.summary["summary"]
    assert told["scan"] == {"visited_files": 6, "candidate_files": 5, "valid_images": 4, "skipped_files": 1, "invalid_images": 1}
    assert told["features"] | {"embedding_backend": ""} == {
        "processed_images": 4, "skipped_invalid_images": 1, "extracted_hashes": 4, "extracted_embeddings": 4, "external_embeddings": 0, "local_embeddings": 4, "embedding_backend": "",
        "requested_embedding_provider": "auto", "using_external_backend": False, "failed_images": 0,
    }
    assert told["grouping"]["exact_duplicate_groups"] == 1 and told["grouping"]["group_count"] == sum(told["grouping"]["by_group_type"].values())
    assert told["classification"]["processed_images"] == told["classification"]["classified_images"] == 5 and {"auto_style_families", "auto_character_families"} <= told["classification"].keys()
    assert all(getattr(tessera, name) for name in tessera.__all__)
