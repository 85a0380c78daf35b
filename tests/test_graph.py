import pytest
from pyspark.sql import functions as F

import loomgraph as lg
from tests.helpers import directed, edges, ids, pairs_of, undirected


def test_degrees_of_a_small_digraph(spark):
    g = directed(spark, [(1, 2), (1, 3), (2, 3), (4, 1)])
    assert pairs_of(g.degrees(), "id", "degree") == {(1, 3), (2, 2), (3, 2), (4, 1)}
    assert pairs_of(g.out_degrees(), "id", "degree") == {(1, 2), (2, 1), (4, 1)}
    assert pairs_of(g.in_degrees(), "id", "degree") == {(1, 1), (2, 1), (3, 2)}
    assert (g.num_vertices(), g.num_edges(), g.is_directed) == (4, 4, True)


def test_self_loop_counts_twice_undirected(spark):
    assert pairs_of(undirected(spark, [(1, 1)]).degrees(), "id", "degree") == {(1, 2)}


def test_columns_are_renamed_in_place(spark):
    df = spark.createDataFrame([(1, 2, 0.5)], "a long, b long, weight double")
    people = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "node long, name string")
    g = lg.DirectedGraph(df, people, src_col="a", dst_col="b", id_col="node")
    assert g.edges.columns == ["src", "dst", "weight"] and g.vertices.columns == ["id", "name"] and g.num_vertices() == 3
    swapped = lg.DirectedGraph(edges(spark, [(1, 2)]), src_col="dst", dst_col="src")
    assert pairs_of(swapped.edges, "src", "dst") == {(2, 1)}


@pytest.mark.parametrize("options", [{"src_col": "x"}, {"src_col": "dst"}, {"id_col": "nope"}])
def test_bad_columns(spark, options):
    with pytest.raises(ValueError):
        lg.DirectedGraph(edges(spark, [(1, 2)]), ids(spark, [1, 2]), **options)
    with pytest.raises(ValueError):
        lg.DirectedGraph(spark.createDataFrame([(1, 2, 3)], "src long, dst long, a long"), src_col="a")
    with pytest.raises(ValueError):
        lg.DirectedGraph(spark.createDataFrame([(1,)], "src long"))


def test_validation(spark):
    with pytest.raises(ValueError, match="duplicate"):
        lg.DirectedGraph(edges(spark, [(1, 2)]), ids(spark, [1, 1, 2]), validate=True)
    with pytest.raises(ValueError, match="not in the vertex set"):
        lg.DirectedGraph(edges(spark, [(1, 2)]), ids(spark, [1]), validate=True)
    lg.DirectedGraph(edges(spark, [(1, 2)]), ids(spark, [1]))


def test_graphs_are_immutable_and_abstract(spark):
    g = directed(spark, [(1, 2)])
    with pytest.raises(AttributeError):
        g.edges = None
    with pytest.raises(AttributeError):
        g.other = 1
    with pytest.raises(TypeError):
        lg.Graph(g.edges)


def typed(spark, cls=lg.DirectedGraph):
    e = edges(spark, [(1, 2, "a"), (2, 3, "b"), (3, 1, "a"), (3, 9, "a")], ["type string"])
    v = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "id long, score long")
    return cls(e, v)


def test_triplets_drop_dangling_edges(spark):
    t = typed(spark).triplets()
    assert t.columns == ["src", "dst", "type", "src_score", "dst_score"]
    assert pairs_of(t, *t.columns) == {(1, 2, "a", 10, 20), (2, 3, "b", 20, 30), (3, 1, "a", 30, 10)}


@pytest.mark.parametrize("cls", [lg.DirectedGraph, lg.UndirectedGraph])
def test_filters_keep_the_flavor(spark, cls):
    g = typed(spark, cls)
    few = g.filter_vertices(F.col("score") >= 20)
    assert type(few) is cls and pairs_of(few.vertices, "id") == {(2,), (3,), (4,)} and pairs_of(few.edges, "src", "dst", "type") == {(2, 3, "b")}
    some = g.filter_edges("type = 'a'")
    assert type(some) is cls and some.num_vertices() == 4 and some.num_edges() == 3
    assert pairs_of(g.drop_isolated_vertices().vertices, "id", "score") == {(1, 10), (2, 20), (3, 30)}


def test_degree_by_type(spark):
    assert pairs_of(typed(spark).degree_by_type("type"), "id", "type", "degree") == {(1, "a", 2), (2, "a", 1), (2, "b", 1), (3, "b", 1), (3, "a", 2), (9, "a", 1)}


def test_conversions(spark):
    g = typed(spark)
    assert pairs_of(g.reverse().edges, "src", "dst", "type") == {(2, 1, "a"), (3, 2, "b"), (1, 3, "a"), (9, 3, "a")}
    u = g.as_undirected()
    assert not u.is_directed and u.num_edges() == 4 and u.traversal_edges().count() == 8
    assert pairs_of(u.as_directed().edges, "src", "dst") == pairs_of(g.edges, "src", "dst")
    assert pairs_of(u.as_directed(src_col="dst", dst_col="src").edges, "src", "dst") == pairs_of(g.reverse().edges, "src", "dst")


def test_edge_functions(spark):
    e = edges(spark, [(2, 1, "x"), (1, 2, "y"), (3, 3, "z"), (5, 4, "w")], ["type string"])
    assert pairs_of(lg.canonicalize(e), "src", "dst") == {(1, 2), (4, 5)}
    assert lg.drop_self_loops(e).count() == 3 and lg.drop_self_loops(e).columns == e.columns
    assert lg.dedupe_edges(e.union(e)).count() == 4 and lg.dedupe_edges(e).columns == ["src", "dst"]
    assert lg.symmetrize(e).count() == 8 and (1, 2, "x") in pairs_of(lg.symmetrize(e), "src", "dst", "type")
    assert lg.validate_edges(e) is e
    assert lg.to_edges(e, "dst", "src").columns == ["src", "dst"] and (1, 2) in pairs_of(lg.to_edges(e, "dst", "src"), "src", "dst")
    with pytest.raises(ValueError):
        lg.validate_edges(e.drop("src"))


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, 2, "v")], "`a.b` long, c long, `x.y` string")
    g = lg.DirectedGraph(df, src_col="a.b", dst_col="c")
    assert g.edges.columns == ["src", "dst", "x.y"] and g.reverse().edges.columns == ["src", "dst", "x.y"]


def test_sources(spark, tmp_path):
    from loomgraph.sources.tables import frame, read_edge_list, read_table, write_table

    (tmp_path / "e.txt").write_text("# comment\n1\t2\n\n 3 4 \n")
    assert pairs_of(read_edge_list(spark, str(tmp_path / "e.txt")), "src", "dst") == {(1, 2), (3, 4)}
    write_table(frame(spark, {"src": [1], "dst": [2]}), str(tmp_path / "t"))
    assert pairs_of(read_table(spark, str(tmp_path / "t")), "src", "dst") == {(1, 2)}
    assert frame(spark, {"src": [], "dst": []}).dtypes == [("src", "bigint"), ("dst", "bigint")]
