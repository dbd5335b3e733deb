import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from files import png, solid, write
from gridprep.functions.text import words
from gridprep.operators.images import composite, encode_images, explode_pixels, to_tensor
from gridprep.operators.metadata import chain_edges, chain_stage
from gridprep.operators.validate import filter_exact
from gridprep.plans.jobs import archives_to_images, images_to_grids
from gridprep.sources.checkpoints import latest_checkpoint
from gridprep.sources.grids import scan_grids
from gridprep.sources.images import extract_archives, scan_images
from gridprep.sources.logs import scan_log, scrape_log
from gridprep.sources.metadata import read_metadata
from gridprep.sources.tables import list_generations, read_one, restrict, upsert
from gridprep.sources.versions import load_version, save_version


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scan_images_reads_keys_and_pixels(spark, tmp_path):
    write(tmp_path, "gen3", "game a", "001.png", png([[(10, 20, 30), (255, 0, 0)]]))
    write(tmp_path, "gen4", "game_b", "002+x.png", png([[(1, 2, 3, 4)]]))
    images = scan_images(spark, tmp_path)
    assert rows(images.select("generation", "game_name", "name", "height", "width", "n_channels")) == [
        ("gen3", "game a", "001.png", 1, 2, 3), ("gen4", "game_b", "002+x.png", 1, 1, 4)]
    pixels = rows(explode_pixels(images, ["name"]))
    assert pixels == [("001.png", 0, 0, 10, 20, 30, 255), ("001.png", 0, 1, 255, 0, 0, 255), ("002+x.png", 0, 0, 1, 2, 3, 4)]


def test_scan_images_of_a_part(spark, tmp_path):
    for generation, game in (("gen3", "a"), ("gen3", "b"), ("gen4", "a")):
        write(tmp_path, generation, game, "001.png", png([[(0, 0, 0)]]))
    assert scan_images(spark, tmp_path, generation="gen3").count() == 2
    assert scan_images(spark, tmp_path, game_name="a").count() == 2
    assert scan_images(spark, tmp_path, "gen4", "a").count() == 1


def test_missing_trees_are_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        scan_images(spark, tmp_path)
    with pytest.raises(ValueError):
        scan_grids(spark, tmp_path)
    write(tmp_path, "gen3", "a", "001.txt", "~")
    with pytest.raises(ValueError):
        scan_grids(spark, tmp_path, generation="gen4")


def test_scan_grids(spark, tmp_path):
    write(tmp_path, "gen3", "a", "001.txt", "~ ;\r\n; ~")
    write(tmp_path, "gen3", "b", "002.txt", "a b\nc d")
    grids = scan_grids(spark, tmp_path)
    assert rows(grids) == [("gen3", "a", "001.txt", "~ ;\n; ~"), ("gen3", "b", "002.txt", "a b\nc d")]
    assert rows(read_one(grids, "gen3", "b", "002.txt")) == [("gen3", "b", "002.txt", "a b\nc d")]
    with pytest.raises(ValueError):
        read_one(grids, "gen3", "b", "002.png")
    with pytest.raises(ValueError):
        read_one(grids, "gen3", "b", "003.txt")


def test_many_small_grids_are_few_tasks(spark, tmp_path):
    for i in range(1400):
        write(tmp_path, "gen3", "a", f"{i:04d}.txt", f"{i} ;\r\n~ ~")
    write(tmp_path, "gen3", "a", "marks.txt", b"\xef\xbb\xbf\xc3\xa9 \xff ~\n")
    grids = scan_grids(spark, tmp_path)
    assert grids.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    # the text source has the same texts
    text = F.regexp_replace("value", "\r\n?", "\n")
    told = spark.read.text(str(tmp_path / "gen3/a"), wholetext=True).select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0), text)
    assert rows(grids.select("name", "data")) == rows(told) and grids.count() == 1401


def test_many_small_images_are_few_tasks(spark, tmp_path):
    for i in range(1400):
        write(tmp_path, "gen3", "a", f"{i:04d}.png", png([[(i % 256, i // 256, 3)]]))
    images = scan_images(spark, tmp_path)
    assert images.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert rows(images.select("name", F.hex("data"))) == [(f"{i:04d}.png", f"03{i // 256:02X}{i % 256:02X}") for i in range(1400)]


GRID_SCHEMA = "generation STRING, game_name STRING, name STRING, data STRING"


def test_upsert_replaces_by_key_and_leaves_other_folders(spark, tmp_path):
    path = str(tmp_path / "grids")
    first = [("gen3", "a", "1", "old"), ("gen3", "a", "2", "stays"), ("gen4", "a", "1", "other")]
    upsert(spark.createDataFrame(first, GRID_SCHEMA), path)
    untouched = sorted(p.name for p in (tmp_path / "grids/generation=gen4").rglob("*.parquet"))
    second = [("gen3", "a", "1", "first", 1), ("gen3", "a", "1", "last", 2), ("gen3", "b", "9", "new", 1)]
    changes = spark.createDataFrame(second, GRID_SCHEMA + ", position INT")
    upsert(changes, path, order=["position"])
    stored = spark.read.parquet(path).select("generation", "game_name", "name", "data")
    assert rows(stored) == [("gen3", "a", "1", "last"), ("gen3", "a", "2", "stays"), ("gen3", "b", "9", "new"), ("gen4", "a", "1", "other")]
    assert untouched == sorted(p.name for p in (tmp_path / "grids/generation=gen4").rglob("*.parquet"))


def test_stored_grids_are_pruned_by_folder(spark, tmp_path):
    path = str(tmp_path / "grids")
    upsert(spark.createDataFrame([("gen3", "a", "1", "x"), ("gen4", "b", "1", "y")], GRID_SCHEMA), path)
    part = scan_grids(spark, path, generation="gen4", stored="parquet")
    assert rows(part.select("data")) == [("y",)]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(generation" in plan
    assert rows(list_generations(spark.read.parquet(path))) == [("gen3",), ("gen4",)]
    assert restrict(spark.read.parquet(path), game_name="b").count() == 1


def archive(members):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return buffer.getvalue()


def test_archives_to_images(spark, tmp_path):
    members = [
        ("art/front/game-a/25.png", b"one"), ("art/front/game-a/25-big-one.png", b"two"),
        ("art/front/game-a/shiny/7.png", b"three"), ("art/front/game-a/back/7.png", b"no"),
        ("art/front/game-a/egg.png", b"no"), ("art/icons/game-a/7.png", b"no"), ("art/front/7.png", b"no"),
        ("art/front/game-a/8.txt", b"no"), ("art/front/game-a/1234.png", b"four"), ("art/front/game-a/025.png", b"later"),
    ] + [(f"art/front/game-b/{i}.png", b"x") for i in range(600)]
    folder = tmp_path / "archives"
    folder.mkdir()
    (folder / "generation-3.tar.gz").write_bytes(archive(members))
    (folder / "other.tar.gz").write_bytes(archive(members))
    out = str(tmp_path / "images")
    archives_to_images(spark, f"{folder}/*.tar.gz", out, "art/front")
    stored = spark.read.parquet(out).select("generation", "game_name", "name", F.decode("content", "UTF-8"))
    assert rows(stored.where("game_name = 'game-a'")) == [
        ("gen3", "game-a", "007_shiny.png", "three"), ("gen3", "game-a", "025.png", "later"),
        ("gen3", "game-a", "025_big_one.png", "two"), ("gen3", "game-a", "1234.png", "four")]
    assert stored.where("game_name = 'game-b'").count() == 600


def test_a_cut_off_archive_is_an_error(spark, tmp_path):
    # a name that has to be escaped in a URI, and members that do not compress
    whole = archive([(f"art/front/game-a/{i}.png", os.urandom(5000)) for i in range(1, 9)])
    path = tmp_path / "generation-3 a%20b.tar.gz"
    path.write_bytes(whole)
    assert extract_archives(spark, f"{tmp_path}/*.gz").count() == 8
    for size in (len(whole) - 4, len(whole) // 2):
        path.write_bytes(whole[:size])
        with pytest.raises(Exception, match="end"):
            extract_archives(spark, f"{tmp_path}/*.gz").collect()


def test_read_metadata_last_duplicate_wins(spark, tmp_path):
    path = tmp_path / "species.json"
    path.write_text(json.dumps([
        {"id": 1, "name": "a", "type_1": "fire", "height": 0.5, "is_baby": True},
        {"id": 2, "name": "b", "type_2": None}, {"id": 1, "name": "again", "type_1": "water"}], indent=1))
    found = read_metadata(spark, str(path)).select("id", "name", "type_1", "height", "is_baby")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "again", "water", None, None), (2, "b", None, None, None)]


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    vocab = spark.createDataFrame([("[PAD]", 0)], "token STRING, id INT")
    for partition, n in (("2024-01", 1), ("2024-02", 2), ("2023-12", 3)):
        assert save_version(spark.range(n), vocab, root, partition) == f"box-{partition}"
    name, train, _ = load_version(spark, root)
    assert (name, train.count()) == ("box-2024-02", 2)
    name, train, found = load_version(spark, root, "2023-12")
    assert (name, train.count(), rows(found)) == ("box-2023-12", 3, [("[PAD]", 0)])


def test_latest_checkpoint_skips_empty_and_missing_state(spark, tmp_path):
    for step, state in (("9", "{}"), ("100", "{}"), ("200", ""), ("300", None)):
        folder = tmp_path / f"checkpoint-{step}"
        folder.mkdir()
        (folder / "weights.bin").write_text("w")
        if state is not None:
            (folder / "trainer_state.json").write_text(state)
    row = latest_checkpoint(spark, tmp_path).first()
    assert row["step"] == 100 and row["checkpoint"].endswith("checkpoint-100")


def test_log_is_read_in_parts(spark, tmp_path):
    end = "=" * 36
    path = tmp_path / "train.log"
    path.write_text(
        f"loss 1\n=== Inference @ step 100 ===\n[ROW_00] a b\nc\n{end}\nloss 2\n"
        f"=== Inference @ step 200 ===\nx\n{end}\n=== Inference @ step 300 ===\nno end\n")
    assert rows(scrape_log(scan_log(spark, str(path)))) == [(100, "[ROW_00] a b\nc"), (200, "x")]
    path.write_text(f"=== Inference @ step 5 ===\ncut short\n=== Inference @ step 6 ===\ny\n{end}")
    assert rows(scrape_log(scan_log(spark, str(path)))) == [(5, "cut short\n=== Inference @ step 6 ===\ny")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        path.write_text("".join(f"loss\n=== Inference @ step {i} ===\ntext {i}\n{end}\n" for i in range(50)) + "rest")
        assert rows(scrape_log(scan_log(spark, str(path)))) == [(i, f"text {i}") for i in range(50)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_images_to_grids_on_files(spark, tmp_path):
    gray = (128, 128, 128)
    write(tmp_path, "gen3", "a", "001.png", png(solid(64, gray, (255, 255, 255))))
    write(tmp_path, "gen3", "a", "002.png", png(solid(64, (255, 255, 255))))      # one token only
    write(tmp_path, "gen3", "a", "003.png", png(solid(64, gray)))                  # coloured border
    write(tmp_path, "gen4", "a", "004.png", png(solid(8, (0, 0, 0, 0), None)))     # see-through is white
    write(tmp_path, "gen2", "a", "005.png", png(solid(64, gray, (255, 255, 255))))
    grids = images_to_grids(scan_images(spark, tmp_path)).collect()
    assert [(g["generation"], g["name"]) for g in grids] == [("gen3", "001.txt")]
    token = chr(59 + 2 * 16 + 2 * 4 + 2)
    middle = " ".join(["~"] + [token] * 62 + ["~"])
    assert grids[0]["data"] == "\n".join([" ".join(["~"] * 64)] + [middle] * 62 + [" ".join(["~"] * 64)])
    with pytest.raises(ValueError):
        images_to_grids(scan_images(spark, tmp_path), ["gen9"])


def test_exact_size_expands_gray_and_drops_unreadable(spark, tmp_path):
    write(tmp_path, "gen3", "a", "001.png", png(solid(4, (200,))))
    write(tmp_path, "gen3", "a", "002.png", png(solid(4, (10, 20, 30, 128))))
    write(tmp_path, "gen3", "a", "003.png", png(solid(5, (1, 2, 3))))
    write(tmp_path, "gen3", "a", "004.png", b"not an image")
    exact = filter_exact(scan_images(spark, tmp_path), 4)
    pixels = composite(explode_pixels(exact, ["name"]), "float").groupBy("name", "r", "g", "b").count()
    share = 128 / 255
    expected = tuple(int(c * share + 255 * (1 - share)) for c in (10, 20, 30))
    assert rows(pixels) == [("001.png", 200, 200, 200, 16), ("002.png", *expected, 16)]


def test_unreadable_image_is_an_error_when_encoded(spark, tmp_path):
    write(tmp_path, "gen3", "a", "004.png", b"not an image")
    with pytest.raises(Exception, match="could not decode"):
        encode_images(scan_images(spark, tmp_path)).collect()


def test_tensor(spark, tmp_path):
    write(tmp_path, "gen3", "a", "001.png", png([[(255, 0, 51), (0, 102, 0)]]))
    tensor = to_tensor(scan_images(spark, tmp_path)).first()["tensor"]
    assert [round(v, 6) for v in tensor] == [1.0, 0.0, 0.0, 0.4, 0.2, 0.0]


def test_chain_documents(spark):
    def node(name, *children):
        return {"species": {"name": name}, "evolves_to": list(children)}

    chains = [
        {"chain": node("a", node("b", node("c")), node("d"))},
        {"chain": node("lone")},
    ]
    documents = spark.createDataFrame([(json.dumps(c),) for c in chains], "json STRING")
    targets = spark.createDataFrame([(t,) for t in ("a", "b", "c", "d", "lone", "unknown")], "target STRING")
    found = chain_stage(chain_edges(documents), targets)
    assert rows(found) == [
        ("a", 1, True), ("b", 2, True), ("c", 3, False), ("d", 2, False), ("lone", 1, False), ("unknown", 1, False)]


def test_chain_with_a_cycle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("gridprep.operators.metadata.MAX_ROUNDS", 4)
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "parent STRING, child STRING")
    with pytest.raises(ValueError):
        chain_stage(edges, spark.createDataFrame([("a",)], "target STRING"))


def test_python_function_takes_computed_tokens(spark):
    grids = spark.createDataFrame([("a b\nc",)], "data STRING")
    assert grids.select(words(F.col("data")).alias("w")).first()["w"] == ["a", "b", "c"]
