"""Line numbers against enumerate."""

import gzip
import random

import pytest

from sourcerank.sources import line_source, readers, sinks


def expected(data: bytes):
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    return [(k, x.removesuffix(b"\r").decode("utf-8", "replace")) for k, x in enumerate(lines, 1)]


def text(rng, n):
    parts = [b"", b"  ", b"{bad", b'{"k": 1, "text": "\xc3\xa9"}', b"x" * 300, b"\xff\xfe", b"cr\r", "日本".encode()]
    return b"\n".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("split_bytes", [1, 7, 64, 100_000])
def test_numbers_equal_enumerate(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    n = 12 if split_bytes == 1 else 150
    files = {"a.jsonl": text(rng, n), "b.jsonl": text(rng, n) + b"\n", "empty.jsonl": b"", "end.jsonl": b"\n\n", "one.jsonl": b"no end"}
    files["packed.jsonl.gz"] = text(rng, n)
    for name, data in files.items():
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    (tmp_path / "_hidden").write_bytes(b"not read\n")
    if split_bytes == 64:
        assert sum(s.file.endswith("a.jsonl") for s in line_source.plan_splits(str(tmp_path), 64)) >= 4
    rows = line_source.numbered_lines(spark, str(tmp_path), split_bytes).collect()
    got = {name: sorted((r["line_no"], r["line"]) for r in rows if r["file"].endswith(f"/{name}")) for name in files}
    assert got == {name: expected(data) for name, data in files.items()}


def test_long_lines_over_many_splits(spark, tmp_path):
    data = b"first\n" + b"y" * 3_000_000 + b"\nlast"
    (tmp_path / "long.txt").write_bytes(data)
    rows = line_source.numbered_lines(spark, f"file://{tmp_path}/long.txt", 100_000).collect()
    assert sorted((r["line_no"], len(r["line"])) for r in rows) == [(1, 5), (2, 3_000_000), (3, 4)]


def test_records_and_rejects_keep_their_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"uid": "a"}\n\n{oops\n{"uid": "b"}')
    good, bad = readers.numbered_jsonl(spark, str(tmp_path), readers.DOCUMENT, split_bytes=5)
    assert sorted((r["uid"], r["line_no"]) for r in good.collect()) == [("a", 1), ("b", 4)]
    assert [(r["line"], r["line_no"]) for r in bad.collect()] == [("{oops", 3)]


def test_small_ranges_share_tasks_and_are_not_read_far_beyond(spark, tmp_path):
    data = b"".join(b"line %d\n" % k for k in range(30_000))
    (tmp_path / "a.txt").write_bytes(data)
    splits = line_source.plan_splits(str(tmp_path), 64)
    assert len(splits) > 4000
    reader = line_source.LineReader({"path": str(tmp_path), "split_bytes": "64"})
    dealt = reader.partitions()
    assert len(dealt) <= 4 and [s for share in dealt for s in share.splits] == splits
    system, _ = line_source.located(str(tmp_path))
    assert len(next(line_source._pieces(system, splits[7]))) <= 65
    rows = line_source.numbered_lines(spark, str(tmp_path), 64).select("line_no", "line").collect()
    assert sorted(map(tuple, rows)) == [(k + 1, f"line {k}") for k in range(30_000)]


def test_shares_are_bounded_by_bytes_and_number():
    splits = [line_source.Split(f, a, a + 10) for f in "ab" for a in range(0, 1000, 10)]
    dealt = line_source.shares(splits, tasks=8, least=1)
    assert 8 <= len(dealt) <= 10 and [s for d in dealt for s in d.splits] == splits
    assert all(sum(s.stop - s.start for s in d.splits) <= 250 for d in dealt)
    assert [(s.file, s.start, s.stop) for s in line_source.followed(splits)] == [("a", 0, 1000), ("b", 0, 1000)]
    assert line_source.shares([]) == []


def test_no_files(spark, tmp_path):
    assert line_source.numbered_lines(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="absent"):
        line_source.numbered_lines(spark, f"{tmp_path}/absent").count()


def test_zstandard_files(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "repeat('é', cast(id % 5 as int)) as s").repartition(3)
    path = f"{tmp_path}/out"
    assert sinks.zstandard_jsonl(rows, path) == 100
    assert len(list((tmp_path / "out").glob("*.zst"))) > 1 and not list((tmp_path / "out").glob("_*"))
    back = spark.read.schema(rows.schema).json(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(FileExistsError):
        sinks.zstandard_jsonl(rows, path)
