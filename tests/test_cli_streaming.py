from graphloom import cli
from graphloom.sources import tsv
from graphloom.streaming.edges import append_known_edges, read_edges, write_batch

NODES = "a\t:X\tv:1\nb\t:Y\nc\t:X\tv:3\n"
EDGES = "a\tT\tb\na\tT\tc\nc\tU\ta\n"


def files(tmp_path):
    (tmp_path / "g-nodes.tsv").write_text(NODES)
    (tmp_path / "g-edges.tsv").write_text(EDGES)
    return str(tmp_path / "g")


def test_batch_and_build(spark, tmp_path):
    prefix = files(tmp_path)
    (tmp_path / "q.txt").write_text("(?x)-[?e:T]->(?y)\n(?x:Nope)-[?e]->(?y)\n(?x)-[?e]->(?y), (?y)-[?f]->(?z)\n")
    cli.main(["build", prefix, str(tmp_path / "s")])
    cli.main(["batch", str(tmp_path / "s"), str(tmp_path / "q.txt"), "--out", str(tmp_path / "sum.tsv"), "--repeat", "2"])
    rows = [line.split("\t") for line in (tmp_path / "sum.tsv").read_text().splitlines()]
    assert [r[:2] for r in rows] == [["1", "2"], ["2", "0"], ["3", "3"]] and rows[1][2] == "0.000000" and float(rows[0][2]) > 0
    limited = list(cli.run_batch(cli.open_graph(spark, prefix), ["(?x)-[?e]->(?y)"], limit=1))
    assert limited[0][:2] == (1, 1)


def test_timeouts_are_reported(spark, tmp_path, monkeypatch):
    from graphloom.errors import QueryTimeout

    def late(*_):
        raise QueryTimeout("stopped")

    monkeypatch.setattr(cli, "within", late)
    said = []
    assert list(cli.run_batch(tsv.load_tsv(spark, files(tmp_path)), ["(?x)-[?e]->(?y)"], complain=said.append)) == [(1, 0, 0.0)] and "stopped" in said[0]


def test_conversation(spark, tmp_path):
    said = []
    cli.converse(tsv.load_tsv(spark, files(tmp_path)), ["(?x:X)-[?e:T]->(?y:Y) RETURN ?x, ?y, ?x.v\n", "", "nonsense", "quit", "(?x)-[?e]->(?y)"], said.append, str(tmp_path / "out"))
    assert said[:2] == ["x\ty\tx.v", "a\tb\t1"] and said[2].startswith("error: ") and len(said) == 3
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/0")).count() == 1


def test_arriving_edges(spark, tmp_path):
    nodes, _ = tsv.read_tsv(spark, files(tmp_path))
    (tmp_path / "in").mkdir()
    for i, lines in enumerate((EDGES, "a\tT\tgone\nb\tU\tc\tk:v\n")):
        (tmp_path / "in" / f"{i}.txt").write_text(lines)
        append_known_edges(spark, str(tmp_path / "in"), nodes, str(tmp_path / "edges"), str(tmp_path / "cp"), str(tmp_path / "late")).awaitTermination()
    target, late = str(tmp_path / "edges"), str(tmp_path / "late")
    rows = read_edges(spark, target)
    assert rows.count() == 4 and rows.filter("label = 'U'").count() == 2
    _, again = tsv.read_tsv(spark, str(tmp_path / "g"))
    write_batch(again, 0, nodes, target, late)  # a batch that is tried again adds nothing
    assert read_edges(spark, target).count() == 4
    more = nodes.select("id").union(spark.createDataFrame([("gone",)], "id string"))
    found = read_edges(spark, target, late, more)
    assert found.count() == 5 and found.filter("dst = 'gone'").head()["src"] == "a" and read_edges(spark, target, late, nodes).count() == 4
