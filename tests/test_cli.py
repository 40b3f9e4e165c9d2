"""The one-shot command."""

import linkloom.__main__ as cli


def test_one_shot(spark, tmp_path, capsys, monkeypatch):
    spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "D")], "id int, title string").write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0)], "src int, dst int").write.parquet(str(tmp_path / "edges"))

    def said(*argv):
        code = cli.main(list(argv))
        return code, capsys.readouterr().out.strip()

    folder = str(tmp_path)
    assert said(folder, "A", "C") == (0, "A -> B -> C")
    assert said(folder, "A", "D") == (0, "No path found")
    assert said(folder, "X", "Y") == (0, "start is not in the graph") and said(folder, "A", "Y") == (0, "target is not in the graph")
    assert cli.main([]) == 2
