import duckdb
import numpy as np
import pytest
from makers import frame, sphere

from pointweave.schema import COLOR, NORMAL, XYZ, from_table
from pointweave.sources import clouds, sinks

HEAD = "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nend_header\n"


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        (HEAD + "0 1 2 0 0 1 255 128 0\n3 4 5 0 1 0 1 2 3\n", [(0, 1, 2, 0, 0, 1, 255, 128, 0), (3, 4, 5, 0, 1, 0, 1, 2, 3)]),
        (HEAD + "0 1 2 0 0 1\n-3 .5 1e-3 0 1 0", [(0, 1, 2, 0, 0, 1, 0, 0, 0), (-3, 0.5, 0.001, 0, 1, 0, 0, 0, 0)]),
        ("0 1 2\r\n3 4 5\r\n\r\n", [(0, 1, 2, 0, 0, 0, 0, 0, 0), (3, 4, 5, 0, 0, 0, 0, 0, 0)]),
        ("", []),
        ("\n  1\t2  3 \n", [(1, 2, 3, 0, 0, 0, 0, 0, 0)]),
    ],
)
def test_text(spark, tmp_path, text, rows):
    (tmp_path / "a.ply").write_text(text, newline="")
    got = [tuple(r) for r in clouds.read_ply(spark, str(tmp_path / "a.ply")).orderBy("id").collect()]
    assert [r[0] for r in got] == list(range(len(rows)))
    assert np.allclose(np.array([r[1:] for r in got]).reshape(-1, 9), np.array(rows).reshape(-1, 9))


def test_folder_and_missing_file(spark, tmp_path):
    (tmp_path / "b.xyz").write_text("1 1 1\n2 2 2\n3 3 3\n")
    (tmp_path / "c.xyz").write_text("4 4 4\n")
    (tmp_path / "d.txt").write_text("5 5 5\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/e.xyz").write_text("6 6 6\n")
    assert [r.px for r in clouds.read_xyz_dir(spark, str(tmp_path)).orderBy("id").collect()] == [1, 2, 3, 4]
    with pytest.raises(clouds.FileReadError, match="Cannot read file"):
        clouds.read_ply(spark, str(tmp_path / "none.ply"))


def test_round_trips(spark, tmp_path):
    p, n = sphere(101)
    cloud = from_table(frame(spark, p, n), id="id", **{c: c for c in (*XYZ, *NORMAL)}, red="id % 256", green="255", blue="7").repartition(3)
    want = [tuple(r) for r in cloud.orderBy("id").collect()]
    sinks.write_bin(cloud, str(tmp_path / "a.bin"))
    assert [tuple(r) for r in clouds.read_bin(spark, str(tmp_path / "a.bin")).orderBy("id").collect()] == want
    sinks.write_ply(cloud, str(tmp_path / "a.ply"))
    sinks.write_xyz(cloud, str(tmp_path / "a.xyz"))
    for name in ("a.ply", "a.xyz"):
        got = [tuple(r) for r in clouds.read_ply(spark, str(tmp_path / name)).orderBy("id").collect()]
        assert len(got) == 101 and np.allclose([r[1:] for r in got], [r[1:] for r in want], rtol=1e-5, atol=1e-6)
    sinks.write_components(cloud.withColumn("comp_rank", cloud.id.cast("int") % 2), str(tmp_path / "c"))
    assert {x.name for x in (tmp_path / "c").iterdir() if x.is_dir()} == {"comp_rank=0", "comp_rank=1"}


def test_numbers_as_text(spark):
    values = [0.0, 1.0, -1.5, 0.1, 123456.0, 1234567.0, 999999.5, 1e-4, 1.23456789e-5, 1e20, 3.14159265, 100000.0, 0.00012345678, -2.5e-10, 99999.953125]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, px double").select("id", sinks.number("px").alias("t")).orderBy("id").collect()
    assert [r.t for r in rows] == [f"{v:.6g}" for v in values]


def test_halves_as_text(spark):
    """Halves of the sixth digit that a float holds exactly go to the even digit, as in SQL; decimals that only look like halves go where their exact value lies."""
    values = [0.01171875, 0.1015625, 0.1171875, -4.640625, 2.328125, 0.0048828125, 0.1234565, 1.0000005, 100000.5, 100001.5, 9.999995e-05, 1.234565e-30, -0.0, float("inf")]
    table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, px double")
    got = [r.t for r in table.select("id", sinks.number("px").alias("t")).orderBy("id").collect()]
    want = duckdb.sql(f"SELECT format('{{:.6g}}', v) FROM (SELECT unnest({[str(v) for v in values]}::DOUBLE[]) AS v)").fetchall()
    assert got == [w[0] for w in want] == [f"{v:.6g}" for v in values]


def test_segment_records(spark, tmp_path):
    r = np.zeros(3, dtype=clouds.SEGMENT_RECORD)
    r["p"][:, 0], r["c"], r["segment"] = [1, 2, 3], 200, [7, 8, 9]
    (tmp_path / "s.bin").write_bytes(r.tobytes())
    got = clouds.read_bin(spark, str(tmp_path / "s.bin"), segments=True).orderBy("id").collect()
    assert [(x.px, x.red, x.segment) for x in got] == [(1, 200, 7), (2, 200, 8), (3, 200, 9)] and set(COLOR) <= set(got[0].asDict())
