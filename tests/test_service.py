import pytest

import __spark_entry__ as entry
from arcfold.__main__ import main
from arcfold.service import BadRequest, Service
from tests.graphs import TWO_CHAINS


def test_import_prepare_run_result(spark, tmp_path):
    (tmp_path / "e").write_text("".join(f"{a} {b} {v}\n" for a, b, v in TWO_CHAINS))
    s = Service(spark)
    s.import_graph("g", str(tmp_path / "e"))
    s.prepare("g", 2)
    run = s.create("wcc", "g")
    assert len(run) == 8 and s.status(run)["state"] == "CREATED"
    assert s.run(run)["state"] == "COMPLETED"
    assert {r["key"]: r["value"] for r in s.result(run).collect()} == {str(i): "0" if i < 10 else "10" for i in range(21)}
    assert [tuple(r) for r in s.result(run, "12").collect()] == [("12", "10")]
    assert s.status(run)["superstep"] >= 1
    table = s.runs[run].table
    s.delete(run)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND|FAILED_READ_FILE"):
        table.collect()
    with pytest.raises(KeyError):
        s.status(run)
    assert s.health()["sharedFolder"] == "UP"


def test_bad_requests_and_other_algorithms(spark, tmp_path):
    (tmp_path / "e").write_text("1 2 1\n2 3 1\n")
    s = Service(spark)
    s.import_graph("g", str(tmp_path / "e"), edge_parser="double")
    for name, configs in (("bfs", {}), ("nope", {}), ("pagerank", {"tolerance": "nan", "resetProbability": "0.1"}), ("mssp", {})):
        with pytest.raises(BadRequest):
            s.create(name, "g", configs)
    run = s.create("pagerank", "g", {"tolerance": 1e-4, "resetProbability": 0.15})
    s.run(run, 3)
    assert s.configs(run)["tolerance"] == 1e-4 and s.result(run, "1").count() == 1
    run = s.create("mssp", "g", {"landmarkVertexIds": "1,2"})
    s.run(run)
    assert s.result(run, "3").first()["value"] == "{1 -> 2.0, 2 -> 1.0}"
    (tmp_path / "r").write_text("1 1 1.0\n1 2 2.0\n2 1 3.0\n2 2 4.0\n")
    s.import_graph("r", str(tmp_path / "r"), ratings=True)
    run = s.create("svdpp", "r", {"random.seed": "0", "iterations": "3"})
    s.run(run)
    assert {r["key"] for r in s.result(run).collect()} == {"(1, 0)", "(2, 0)", "(1, 1)", "(2, 1)"}


def test_command_line(spark, tmp_path):
    (tmp_path / "e").write_text("1 2 5\n")
    main(["import", "-ef", str(tmp_path / "e"), "-et", str(tmp_path / "edges"), "-np", "1"])
    assert spark.read.parquet(str(tmp_path / "edges")).collect() == [(1, 2, 5)]
    (tmp_path / "r").write_text("3 4 2.5\n")
    main(["import", "-rf", str(tmp_path / "r"), "-et", str(tmp_path / "ratings"), "-np", "1"])
    assert [tuple(map(tuple, r[:2])) + r[2:] for r in spark.read.parquet(str(tmp_path / "ratings")).collect()] == [((0, 3), (1, 4), 2.5)]
    with pytest.raises(SystemExit):
        main(["import", "-et", str(tmp_path / "none")])
    main(["import", "-ef", str(tmp_path / "e"), "-et", str(tmp_path / "typed"), "-p", "long_double", "-np", "1"])
    assert spark.read.parquet(str(tmp_path / "typed")).dtypes[2] == ("value", "double")


def test_entry_and_oracles(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
