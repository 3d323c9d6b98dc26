import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from causeway import fixtures
from causeway.operators import graph as G
from causeway.operators import joins as J
from causeway.operators import ranking as R
from causeway.operators import scoring as C
from causeway.plans import rank as plan


@pytest.fixture(scope="module")
def tables(spark):
    return fixtures.graph_tables(spark)


def test_root_causes(spark):
    rows = {(r.bug_id, r["rank"]): r for r in fixtures.root_cause_ranking(spark, "").collect()}
    assert rows["n", 1].node_id == "n1" and rows["n", 1].label == C.ROOT and rows["n", 1].score > 0.7
    assert rows["n", 3].node_id == "n3" and rows["n", 3].label == C.SYMPTOM
    assert rows["u", 1].node_id == "u1" and rows["u", 1].matched_bug_pattern == "ownership_or_lifetime_operation"
    assert rows["n", 1].cve_pattern_prior_score > 0.8


def test_score_by_hand(spark, tables):
    """n1 of the first graph: every contribution added up by hand."""
    nodes, edges, reports = tables
    r = next(r for r in C.score_candidates(plan.features(nodes, edges, reports)).collect() if r.node_id == "n1")
    assert (r.distance_to_trigger, r.distance_score, r.module_proximity_score) == (2, 1.0, 1.0)
    assert r.matched_bug_pattern == "incorrect_size_computation" and r.bug_pattern_score == 0.98
    want = 0.18 + 0.14 + 0.18 + 0.14 + 0.18 * 0.98 + 0.08 / 3 + 0.07
    assert abs(r.score - want) < 1e-9


def test_calibration_wins(spark, tables):
    nodes, edges, reports = tables
    f = plan.features(nodes, edges, reports)
    low = C.score_candidates(f, given={"distance": 0.5}, calibration=C.Calibration(weights={"distance": 0.0})).where("node_id = 'n1'").first()
    usual = C.score_candidates(f).where("node_id = 'n1'").first()
    assert abs(usual.score - low.score - 0.18) < 1e-9
    zero = C.score_candidates(f, calibration=C.Calibration(root_threshold=0.0)).where("node_id = 'n1'").first()
    assert zero.label == usual.label  # a threshold of zero counts as not given


def test_chains(spark, tables):
    rows = fixtures.causal_chains(spark, "").collect()
    best = {r.bug_id: r for r in rows if r["rank"] == 1}
    assert best["n"].path == "n1>n2>n3" and best["n"].relations == "data_flow>call_argument"
    assert best["u"].path == "u1>u2" and best["u"].relations == "ownership_transfer"
    assert all(0 <= r.score <= 1 for r in rows)


def test_patch_lifts_the_changed_line(spark, tables):
    nodes, edges, reports = tables
    ranked = plan.candidates(nodes, edges, reports)
    diff = spark.createDataFrame([("n", "lib/store.c", 5, "room_for", "int total = count * width * 4;")], "bug_id string, file string, line int, function string, text string")
    intent = spark.createDataFrame([("n", "direct_fix")], "bug_id string, intent string")
    after = {r.node_id: r for r in plan.refine_with_patch(ranked, diff, intent).collect()}
    before = {r.node_id: r for r in ranked.collect()}
    assert after["n1"].patch_alignment_score == 0.96 and after["n1"].score > before["n1"].score and after["n1"]["rank"] == 1
    assert after["m1"].score == before["m1"].score


def test_distances_with_cycles(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "b", "t"), (1, "z", "z"), (2, "a", "t")], "g int, src string, dst string")
    s = spark.createDataFrame([(1, "t"), (2, "t")], "g int, node string")
    got = {(r.g, r.node): r.distance for r in G.distances(e, s).collect()}
    assert got == {(1, "t"): 0, (1, "b"): 1, (1, "a"): 2, (2, "t"): 0, (2, "a"): 1}
    e.createOrReplaceTempView("ed")
    s.createOrReplaceTempView("st")
    assert {(r.g, r.node): r.distance for r in G.reverse_bfs_sql(spark, "ed", "st", 4).collect()} == got


def test_bounded_paths(spark):
    e = spark.createDataFrame([(1, "a", "t"), (1, "a", "b"), (1, "b", "t"), (1, "b", "c"), (1, "c", "t"), (1, "c", "a")], "g int, src string, dst string")
    s, t = (spark.createDataFrame([(1, x)], "g int, node string") for x in "at")
    got = [r.path for r in G.bounded_paths(e, s, t, 10, 3).orderBy("rank").collect()]
    assert got == [["a", "t"], ["a", "b", "t"], ["a", "b", "c", "t"]]
    assert G.bounded_paths(e, s, t, 1, 3).count() == 1


def test_backfill_prefers_but_does_not_filter(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([0.1, 0.5, 0.05, 0.2])], "g string, i int, s double")
    got = R.backfill_topk(df, ["g"], [F.desc("s"), "i"], "s", 0.15, 3).orderBy("rank").collect()
    assert [r.i for r in got] == [1, 3, 0]


def test_suffix_paths(spark):
    files = spark.createDataFrame([("lib/a/store.c",), ("lib/b/store.c",), ("app/main.c",)], "file string")
    paths = spark.createDataFrame([("/work/x/lib/a/store.c",), ("store.c",), ("/q/main.c",)], "path string")
    got = {r.path: r.resolved for r in J.by_suffix(paths, files, "path", "file").collect()}
    assert got == {"/work/x/lib/a/store.c": "lib/a/store.c", "store.c": None, "/q/main.c": "app/main.c"}


def test_null_is_not_false(spark):
    from causeway.rules import is_not

    df = spark.createDataFrame([Row(i=1, f=True), Row(i=2, f=False), Row(i=3, f=None)])
    assert [r.i for r in df.where(is_not(F.col("f"), False)).orderBy("i").collect()] == [1, 3]


def test_bounded_paths_on_a_dense_graph(spark):
    """200 nodes, each linked to the next forty: far more paths than could be listed, and the first ones are wanted."""
    from causeway.operators import graph

    edges = spark.createDataFrame([("x", f"n{i:03d}", f"n{j:03d}") for i in range(200) for j in range(i + 1, min(200, i + 41))], "g string, src string, dst string")
    ends = spark.createDataFrame([("x", "n199")], "g string, node string")
    got = graph.bounded_paths(edges, spark.createDataFrame([("x", "n000"), ("x", "n150")], "g string, node string"), ends, 8, 3).collect()
    paths = {(r.start, r["rank"]): r.path for r in got}
    assert len(paths) == 6
    # nearest first: 0 to 199 takes five links of up to 40; ties by name
    assert paths["n000", 1] == ["n000", "n039", "n079", "n119", "n159", "n199"]
    assert paths["n150", 1] == ["n150", "n159", "n199"] and paths["n150", 2] == ["n150", "n159", "n160", "n199"]


def test_bounded_paths_with_loops_equal_a_search(spark):
    import random

    from causeway.operators import graph

    r = random.Random(7)
    links = sorted({(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(30)})
    links = [(a, b) for a, b in links if a != b]
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    far = {"n0": 0}
    for _ in range(9):
        for a, b in links:
            if b in far:
                far[a] = min(far.get(a, 99), far[b] + 1)

    def search(path, found):
        if path[-1] == "n0" and len(path) > 1:
            found.append(path)
        elif path[-1] != "n0":
            for b in sorted((b for b in out.get(path[-1], []) if b in far and b not in path), key=lambda b: (far[b], b)):
                if len(path) + far[b] <= 6:
                    search([*path, b], found)
        return found

    want = {}
    for s in sorted(far):
        if s != "n0":
            for i, p in enumerate(search([s], [])[:3], 1):
                want[s, i] = p
    edges = spark.createDataFrame([("g", a, b) for a, b in links], "g string, src string, dst string")
    starts = spark.createDataFrame([("g", s) for s in sorted(far) if s != "n0"], "g string, node string")
    got = graph.bounded_paths(edges, starts, spark.createDataFrame([("g", "n0")], "g string, node string"), 6, 3).collect()
    assert {(x.start, x["rank"]): x.path for x in got} == want
