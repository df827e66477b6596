"""Small files are listed, read and written by tasks, with the rows that Spark's reader gives."""

import gzip

import pytest

from saccadia.sources import files, readers

ODD = {
    "a/rec=1.csv": "timestamp_ms,x,y,marker\n0,1,2,\n 10 , 3,4,\"a, b\"\n\n  \n20,5\n30,6,7,m,more\n",
    "a/deep/rec=2.csv": "﻿timestamp_ms,x,y,marker\r\n0,1,2,\"say \"\"so\"\"\"\r\n10,,4,\"\"\r\n",
    "b/rec=3.csv": "time;gaze_x;gaze_y\n0;1;2\n10;3;4",
    "b/rec=4é.csv": "time;gaze_x;gaze_y;\n0;1;2;9\r10;3;4;9\r",
    "b/empty.csv": "",
    "b/_SUCCESS": "0,1\n",
    "b/_old/rec=5.csv": "x,y\n1,2\n",
    "b/.rec=6.csv.crc": "x,y\n",
    "b/k=v/_part=1/rec=7.csv": "timestamp_ms,x,y\n0,1,2\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in ODD.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "a" / "rec=8.csv.gz").write_bytes(gzip.compress(b"timestamp_ms,x,y\n5,6,7\n"))
    (tmp_path / "a" / "rec=9.csv").write_bytes(b"timestamp_ms,x,y,marker\n0,1,2,\xff\n")
    return tmp_path


def _rows(df):
    columns = sorted(c for c in df.columns if c != "sample_seq")
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


def _sequence(df):
    """Times of each recording in source order."""
    found = {}
    for r in sorted(df.collect(), key=lambda r: r["sample_seq"]):
        found.setdefault(r["recording_id"], []).append(r["timestamp_ms"])
    return found


@pytest.mark.parametrize("whole, chunk", [(1 << 26, 1 << 20), (1 << 26, 7), (40, 1 << 20), (0, 1 << 20)])
def test_rows_are_those_of_sparks_reader(spark, folder, monkeypatch, whole, chunk):
    paths = [str(folder / "a"), str(folder / "b")]
    monkeypatch.setattr(files, "listed", lambda *a: None)
    before = readers.read_tabular(spark, paths)
    want = _rows(before), _sequence(before)
    monkeypatch.undo()
    monkeypatch.setattr(files, "WHOLE", whole)  # shorter files for tasks, longer ones for Spark
    monkeypatch.setattr(files, "CHUNK", chunk)
    found = readers.read_tabular(spark, paths)
    assert (_rows(found), _sequence(found)) == want
    assert len(want[0]) == 4 + 2 + 2 + 2 + 1 + 1 + 1


def test_unlike_files_are_not_named_on_the_driver(spark, tmp_path, monkeypatch):
    """Before, files of a folder with two headers were listed there one by one."""
    for k in range(6):
        (tmp_path / f"rec={k}.csv").write_text("timestamp_ms,x,y\n0,1,2\n" if k % 2 else "time;gaze_x;gaze_y\n0;1;2\n")
    monkeypatch.setattr(readers, "header_groups", lambda *a, **b: pytest.fail("files are named on the driver"))
    found = readers.read_tabular(spark, [str(tmp_path)])
    assert found.count() == 6 and found.inputFiles() != []
    assert not any("rec=" in f for f in found.inputFiles())


def test_one_file_a_key_in_a_folder_a_task(spark, tmp_path):
    df = spark.range(300).selectExpr("IF(id = 7, NULL, id % 40) AS rec", "id", "IF(id % 3 = 0, NULL, id / 7) AS x", "IF(id % 5 = 0, 'a;\"b', '') AS m")
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    readers.write_recordings(df, "rec", str(tmp_path / "out"), ";")
    readers.writer_by(df, "rec").csv(str(tmp_path / "want"), header=True, sep=";")
    made, want = (sorted(sorted(f.read_bytes().splitlines()) for f in (tmp_path / d).rglob("[!._]*.csv")) for d in ("out", "want"))
    assert made == want and len(made) == 41
    names = {f.name for f in (tmp_path / "out").rglob("*.csv")}
    assert "rec=17.csv" in names and "rec=__HIVE_DEFAULT_PARTITION__.csv" in names
    assert len(list((tmp_path / "out").iterdir())) <= files.tasks_of(spark)


def test_places_that_only_spark_knows(spark, tmp_path):
    assert files.listed(spark, ["viewfs://store/in"]) is None
    assert files.listed(spark, [str(tmp_path / "gone")]) is None and files.listed(spark, [f"{tmp_path}/*.csv"]) is None
    assert not files.write_csv(spark.range(1), "id", "viewfs://store/out")


def test_a_batch_opens_its_files_once(spark, tmp_path):
    """Before, each step that read the samples opened all files again."""
    from saccadia.operators import insight

    for k in range(4):
        (tmp_path / f"rec={k}.csv").write_text("timestamp_ms,x,y\n0,1,2\n10,3,4\nbroken,5,6\n"[:None if k == 3 else 30])
    found = insight.analyze_files(spark, [], folders=[str(tmp_path)])
    for f in tmp_path.iterdir():
        f.unlink()
    rows = {r["recording_id"].rsplit("/", 1)[1]: (r["sample_count"], r["error"]) for r in found.collect()}
    assert {k: v for k, v in rows.items() if "3" not in k} == {f"rec={k}.csv": (2, None) for k in range(3)}
    assert rows["rec=3.csv"] == (None, "sample without a valid timestamp")
