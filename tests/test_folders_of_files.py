"""Folders of many files: the driver gets a row for each folder, and files are written by all tasks."""

from saccadia.operators import insight
from saccadia.sources import readers


def _write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


COMMA = "timestamp_ms,x,y\n0,1,2\n10,3,4\n"
SEMICOLON = "time;gaze_x;gaze_y\n0;5;6\n"


def test_a_folder_of_like_files_is_one_path(spark, tmp_path):
    for k in range(5):
        _write(tmp_path / "a" / f"rec={k}", "p.csv", COMMA)
        _write(tmp_path / "b" / f"rec={k}", "p.csv", COMMA if k % 2 else SEMICOLON)
    alone = _write(tmp_path, "c.csv", SEMICOLON)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    groups = readers.header_groups(spark, [a, b, alone])
    assert groups[",", "timestamp_ms,x,y"][0] == a and len(groups[",", "timestamp_ms,x,y"]) == 3
    assert len(groups[";", "time;gaze_x;gaze_y"]) == 4
    rows = readers.read_tabular(spark, [a, b, alone]).collect()
    assert len(rows) == 5 * 2 + 2 * 2 + 3 + 1
    # a folder inside another one, or given twice, is read once
    assert readers.read_tabular(spark, [a, a, f"{a}/rec=1"]).count() == 10


def test_folders_give_the_rows_of_their_files(spark, tmp_path):
    files = [_write(tmp_path / f"rec={k}", "p.csv", COMMA.replace("0,1,2", "broken,1,2") if k == 3 else COMMA) for k in range(5)]
    files += [_write(tmp_path / "asc", "q.asc", "0 100 200 3.1\n8.3 110 210 3.2\n"), _write(tmp_path / "odd", "r.xyz", "what")]
    gone = str(tmp_path / "rec=9" / "none.csv")
    columns = ["recording_id", "sample_count", "error"]
    listed = sorted(insight.analyze_files(spark, [*files, gone]).select(columns).collect(), key=str)
    found = sorted(insight.analyze_files(spark, [gone], folders=[str(tmp_path)]).select(columns).collect(), key=str)
    assert found == listed and len(found) == 8


def test_each_key_is_a_folder_written_by_all_tasks(spark, tmp_path):
    spark.range(200).selectExpr("id % 40 AS rec", "id").write.mode("overwrite").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    writer = readers.writer_by(df, "rec")
    writer.csv(str(tmp_path / "out"), header=True)
    files = list((tmp_path / "out").glob("rec=*/*.csv"))
    assert len(files) == 40
    assert len({f.name.split("-")[1] for f in files}) >= 4
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 200
