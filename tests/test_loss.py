"""Conversion plans, loss by kind and the ledger, on hand-written edges."""

from pyspark.sql import functions as F

from accord.operators import loss
from accord.operators.loss import Edge

ICS, CANON, NEXT, JSON, TEXT = (("todo", e) for e in ("ics", "canon", "canon2", "json", "text"))


def edge(source, target, *lost):
    return Edge(source, target, lambda c: F.concat(c, F.lit(f">{target[1]}")), tuple(lost))


EDGES = [edge(ICS, CANON), edge(CANON, ICS, ("color", "dropped", None)), edge(CANON, NEXT, ("status", "simplified", ('"F"', '"O"'))), edge(NEXT, CANON), edge(NEXT, JSON, ("status", "degraded", ('"F"',)), ("color", "reversible", None)), edge(TEXT, NEXT)]
SPINES = {"todo": [CANON, NEXT], "bare": []}


def path(source, target):
    return loss.conversion_path(EDGES, SPINES, source, target)


def test_paths_over_the_spine():
    assert path(ICS, JSON) == ["ics", "canon", "canon2", "json"]
    assert path(TEXT, ICS) == ["text", "canon2", "canon", "ics"]
    assert path(CANON, NEXT) == ["canon", "canon2"] and path(NEXT, CANON) == ["canon2", "canon"]
    assert path(ICS, ICS) == ["ics"] == path(ICS, ("todo", "any")) == path(ICS, ("note", "any"))
    assert path(("todo", "any"), ICS) is None and path(("todo", "any"), ("todo", "any")) == ["any"]
    assert path(ICS, ("note", "json")) is None and path(JSON, ICS) is None and path(ICS, TEXT) is None and path(("bare", "a"), ("bare", "b")) is None
    assert loss.conversion_path([e for e in EDGES if e.target != NEXT], SPINES, ICS, JSON) is None


def test_a_plan_converts_and_reports_its_loss(spark):
    plan = loss.conversion_plan(EDGES, SPINES, ICS, JSON)
    assert loss.converted(spark.createDataFrame([("x",)], "data string"), plan).first().data == "x>canon>canon2>json"
    got = {(r.property, r.loss_kind, tuple(r.lossless) if r.lossless is not None else None) for r in loss.plan_loss(spark, plan).collect()}
    assert got == {("status", "simplified", ('"F"',)), ("color", "reversible", None)}
    assert loss.plan_loss(spark, []).count() == 0


def test_loss_by_the_records_own_kind(spark):
    record = lambda kind, **more: '{"_canon":{"domain":"c"%s},"a":"x","b":[],"c":"ok","d":1}' % (f',"kind":"{kind}"' if kind else "")
    rows = [("m", k, record(kind)) for k, kind in enumerate([None, "task", "note", "other"])] + [("m", 9, "no json")]
    records = spark.createDataFrame(rows, "mapping_id string, id long, data string")
    edges = spark.createDataFrame([(None, "a", "dropped", None), (None, "b", "dropped", None), ("task", "c", "simplified", ['"no"']), ("task", "d", "degraded", None), ("task", "a", "reversible", None), ("note", None, None, None)], "kind string, property string, loss_kind string, lossless array<string>")
    got = {r.id: r.lost for r in loss.materialized_loss(records, edges).collect()}
    assert got == {0: ["a"], 1: ["c", "d"], 3: ["a"]}
    assert {r.id: r.lost for r in loss.materialized_loss(records, edges.where("kind is null").drop("kind")).collect()} == {k: ["a"] for k in range(4)}


def test_the_ledger_is_the_same_whenever_it_is_made(spark):
    rows = [("cal", "canon", "ical", None, "color", "dropped"), ("cal", "canon", "ical", "task", "due", "simplified"), ("cal", "canon", "ical", "task", "alarm", "dropped"), ("cal", "canon", "ical", "note", None, None), ("cal", "ical", "canon", None, None, None), ("note", "canon", "md", None, None, None)]
    schema = "domain string, source string, target string, kind string, property string, loss_kind string"
    made = lambda x: {r.domain: r.text for r in loss.loss_ledger(spark.createDataFrame(x, schema).repartition(3)).collect()}
    assert made(rows) == made(rows[::-1]) == {
        "cal": "## cal\n\n- canon -> ical (lossy; by kind: default, note, task)\n- ical -> canon\n\n### canon -> ical (default)\n\n| property | loss |\n|---|---|\n| color | dropped |\n\n### canon -> ical (task)\n\n| property | loss |\n|---|---|\n| alarm | dropped |\n| due | simplified |\n",
        "note": "## note\n\n- canon -> md\n\nNo declared losses.\n",
    }
