"""Page projections over several runs; memory decisions and budgets case by case."""

import glob

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import decisions
from mnemospark.sources import pages
from mnemospark.sources.versioned import Tables


def test_quotas_shrink_over_types(spark):
    rows = [("B", i, "x", float(i)) for i in range(4)] + [("A", 10 + i, "x" if i else "y", 1.0) for i in range(3)] + [("Z", 99, "x", 9.0), ("A", 50, None, None)]
    nodes = spark.createDataFrame(rows, "node_type string, node_id int, domain string, weight double")
    personas = [pages.Persona("p", 5), pages.Persona("q", 2, types=("B",)), pages.Persona("r", 9, domains=("y",)), pages.Persona("none", 0)]
    got = [(r.persona, r.place, r.node_id) for r in pages.select_pages(nodes, personas, ["A", "B"]).orderBy("persona", "place").collect()]
    assert got == [("p", 1, 10), ("p", 2, 11), ("p", 3, 12), ("p", 4, 50), ("p", 5, 3), ("q", 1, 3), ("q", 2, 2), ("r", 1, 10)]


def test_runs_write_what_changed(spark, tmp_path):
    store, path = Tables(spark, f"file://{tmp_path}/manifest"), f"file://{tmp_path}/wiki"
    frame = lambda rows: spark.createDataFrame(rows, "persona string, page string, text string")
    first = [("p", "a", "# A\n\nx\n"), ("p", "b", "# B\n"), ("q", "a", "# A é\n")]
    assert pages.project(frame(first), store, path) == {"written": 3, "skipped": 0, "removed": 0}
    assert pages.project(frame(first), store, path) == {"written": 0, "skipped": 3, "removed": 0}
    before = {f: open(f).read() for f in glob.glob(f"{tmp_path}/wiki/persona=*/page=*/part-*")}
    assert sorted(before.values()) == sorted(t for *_, t in first)
    assert pages.project(frame([first[0], ("q", "a", "# changed\n")]), store, path) == {"written": 1, "skipped": 1, "removed": 1}
    after = {f: open(f).read() for f in glob.glob(f"{tmp_path}/wiki/persona=*/page=*/part-*")}
    assert len(after.keys() & before.keys()) == 2 and "# changed\n" in after.values()  # other files were left alone
    assert {(r.persona, r.page): r.live for r in store.read("pages").collect()} == {("p", "a"): True, ("p", "b"): False, ("q", "a"): True}
    assert pages.project(frame(first), store, path) == {"written": 2, "skipped": 1, "removed": 0}  # one came back


def test_render(spark):
    df = spark.createDataFrame([("A\n b", "body ", " ", None)], "t string, x string, y string, z string")
    page = pages.render(F.col("t"), {"X": F.col("x"), "Y": F.col("y"), "Z": F.col("z")})
    assert df.select(page.alias("p")).first().p == "# A b\n\n## X\n\nbody\n"


@pytest.mark.parametrize(
    ("prompt", "tool"),
    [
        ("Tell me everything about the grid", "compile_context"), ("did you see how Alice met Bob?", "compile_context"), ("Alice. Bob. Carol", "none"), ("say 'x' and \"y\"", "compile_context"), ("the NASA and IBM case", "none"),
        ("how many tokens left", "context_status"), ("the spatial puzzle", "recall_scene_graph_priors"), ("arc rules for it", "recall_mechanic_priors"), ("a march of grid", "recall_scene_graph_priors"), ("what decision was it", "current_truth"),
        ("What changed?", "diff_since"), ("walk me through it", "reconstruct_timeline"), ("that resembles it", "analogical_search"), ("our strategy", "recall_plans"), ("the usual routine", "recall_procedures"), ("a pitfall", "recall_relevant_lessons"),
        ("standard", "recall_procedures"), ("hello", "none"), ("", "none"), (None, "none"), ("how did we get here", "reconstruct_timeline"),
    ],
)
def test_rules_in_order(spark, prompt, tool):
    row = decisions.decide(spark.createDataFrame([(prompt, "codex")], "prompt string, client string")).first()
    assert row.tool == tool and (row.token_budget is not None) == (tool == "compile_context")


def test_budgets_and_queries(spark):
    clients = ["codex", "Gemini-CLI ", "claude desktop", "claude-desktop", None, ""]
    got = [r.b for r in spark.createDataFrame([(c,) for c in clients], "c string").select(decisions.budget(F.col("c")).alias("b")).collect()]
    assert got == [32000, 128000, 32000, 50000, 32000, 32000]
    long = "word " * 30
    rows = spark.createDataFrame([("  a b? c. d",), (long,), ("x.y",)], "p string").select(decisions.recall_query(F.col("p")).alias("q")).collect()
    assert [r.q for r in rows] == ["a b", long[:47] + "...", "x"]
