"""Logs cut into pieces against the pattern over the whole text."""

import random
import re

import pytest

from gridprep.constants import LOG_END, LOG_PATTERN
from gridprep.sources.logs import scan_log, scrape_log

PARTS = ["=== Inference @ step {} ===", "=== Inference @ step {} ===", LOG_END, LOG_END, LOG_END + "=", "loss 0.5", "", "[ROW_00] a b"]


def whole(text):
    folded = re.sub(r"\r\n?", "\n", text)
    return sorted((int(step), sample) for step, sample in re.findall(LOG_PATTERN, folded))


def found(spark, path):
    return sorted((r.step, r["sample"]) for r in scrape_log(scan_log(spark, str(path))).collect())


@pytest.mark.parametrize("seed, breaks", [(1, ["\n"]), (5, ["\n", "\r"]), (6, ["\n"]), (2, ["\r\n"]), (3, ["\n", "\r\n"]), (4, ["\n", "\r\n", "\r"])])
def test_pieces_give_what_the_whole_text_gives(spark, tmp_path, seed, breaks):
    chance = random.Random(seed)
    expected = []
    for i in range(6):
        text = "".join(chance.choice(PARTS).format(100 * i + k) + chance.choice(breaks) for k in range(120))
        (tmp_path / f"{i}.log").write_bytes(text.encode())
        expected += whole(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert found(spark, tmp_path) == sorted(expected)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_end_line_behind_a_header_leaves_the_file_in_pieces(spark, tmp_path):
    """Such a file was one text before, whatever its size."""
    blocks = [f"=== Inference @ step {i} ===\n{'' if i % 100 == 7 else f'text {i}' + chr(10)}{LOG_END}\n" for i in range(400)]
    path = tmp_path / "train.log"
    path.write_text("".join(blocks) + "rest")
    texts = [r.text for r in scan_log(spark, str(path)).collect()]
    assert len(texts) == 401 and max(map(len, texts)) < 250
    assert found(spark, path) == whole(path.read_text())
