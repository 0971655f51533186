"""Values that depend on the rows before, in segments, against plain loops; one hot group is spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from quadrivium.operators import content, deadlines, ordered, overrides


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_carried_and_running(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, None, "x", "y"]), rng.randint(-2, 2)) for i in rng.sample(range(100), 60)]
    frame = spark.createDataFrame(rows, "g string, pos int, e string, v int")
    event = F.when(F.col("e").isNotNull(), F.struct(F.nullif("e", F.lit("y")).alias("e")))  # y carries a null
    out = ordered.carried(frame, ["g"], "pos", event, "before", width)
    out = ordered.numbered(ordered.running(out, ["g"], "pos", F.col("v"), "total", width=width), ["g"], "pos", "rank", width=width)
    last, total, seen = {}, {}, {}
    want = set()
    for g, pos, e, v in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + v
        want.add((g, pos, last.get(g), total[g], seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
        if e:
            last[g] = None if e == "y" else e
    assert {(r.g, r.pos, r.before and r.before.e, r.total, r.rank) for r in out.collect()} == want
    assert ordered.numbered(frame.limit(0), ["g"], "pos", "rank").collect() == []


def carried_plainly(rows):
    """The containers of one course, row by row."""
    current, out = None, {}
    for pos, title, box, nested, parent in sorted(rows):
        if not title:
            continue
        if box:
            out[pos] = parent or None
            current = title
        else:
            out[pos] = parent or current
            if not parent and not nested:
                current = None
    return out


@pytest.mark.parametrize("width", [2, 7, 10_000])
def test_containers_of_one_course(spark, width):
    rng = random.Random(width)
    rows = [(i, rng.choice(["t%d" % i, "t%d" % i, "", None]), rng.random() < 0.2, rng.choice([True, False, None]), rng.choice([None, "", "p"])) for i in range(300)]
    frame = spark.createDataFrame([("c", *r) for r in rows], "course_id string, pos int, title string, is_container boolean, is_nested boolean, parent_container string")
    got = content.carried_containers(frame, width=width)
    assert {r.pos: r.container_name for r in got.collect()} == carried_plainly(rows)


def test_a_hot_group_is_spread(spark):
    """One course and one title: more than one task has rows of it."""
    rows = spark.range(20_000).select(F.lit("c").alias("course_id"), F.col("id").alias("pos"), F.lit("Week").alias("title"))
    out = deadlines.with_ids(rows, width=1000)
    assert out.select("id").distinct().count() == 20_000 and out.where("pos = 19999").first().id == "c__week__19999"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "__segment" in plan.split("Window", 1)[1].split("\n")[0], "the window is over segments"
    assert out.groupBy(F.spark_partition_id().alias("p")).count().count() > 1


def fold_plainly(events):
    """The state of one entry, event by event."""
    state = None
    for _, op, field, value, at in events:
        if op == "clear":
            if state is None:
                continue
            if field is None:
                state = None
                continue
            state["edits"].pop(field, None)
            if not state["edits"] and not state["dismissed"]:
                state = None
            continue
        state = state or {"edits": {}, "dismissed": False, "manual": False, "at": None}
        state["at"] = at
        if op == "set":
            state["edits"][field] = value
        elif op == "manual":
            state["manual"] = True
        else:
            state["dismissed"] = op == "dismiss"
    return state and (list(state["edits"].items()), state["dismissed"], state["at"], state["manual"])


LOG = "id string, seq int, op string, field string, value string, at string"


@pytest.mark.parametrize("width", [1, 4, 1 << 16])
def test_fold_against_event_by_event(spark, width):
    rng = random.Random(width)
    logs = {str(k): [(i, op, rng.choice(["title", "notes", "type"] + [None] * (op == "clear")) if op in ("set", "clear") else None, str(rng.randint(0, 9)) if rng.random() < 0.9 else None, str(i)) for i in range(rng.randint(1, 14)) for op in [rng.choice(["set", "set", "clear", "clear", "dismiss", "undismiss", "manual"])]] for k in range(150)}
    frame = spark.createDataFrame([(k, *e) for k, es in logs.items() for e in es], LOG).repartition(5)
    got = {r.id: ([tuple(e) for e in r.edits], r.dismissed, r.edited_at, r.manual_add) for r in overrides.fold(frame, width).collect()}
    assert got == {k: s for k, es in logs.items() if (s := fold_plainly(es))}


def test_fold_of_a_million_events_of_one_entry(spark):
    n = 1_000_000
    i = F.col("id")
    op = F.when(i % 7 == 3, "clear").when(i % 11 == 5, "dismiss").when(i % 11 == 6, "undismiss").when(i % 1000 == 1, "manual").otherwise("set")
    log = spark.range(n).select(F.lit("hot").alias("id"), i.alias("seq"), op.alias("op"), F.when(op.isin("set", "clear"), F.element_at(F.array(F.lit("title"), F.lit("notes")), (i % 2 + 1).cast("int"))).alias("field"), i.cast("string").alias("value"), i.cast("string").alias("at"))
    row = overrides.fold(log, width=1 << 14).first()
    want = fold_plainly([(r.seq, r.op, r.field, r.value, r.at) for r in log.where(f"seq > {n - 3000}").orderBy("seq").collect()])
    assert dict(tuple(e) for e in row.edits) == dict(want[0]) and (row.dismissed, row.edited_at) == want[1:3]


def test_anomalies_of_a_hot_date(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "c", d) for i, d in enumerate(["2026-02-01"] * 6 + ["2026-02-03", "2026-02-03", "2026-04-01", "2026-04-02", None])], "id int, course_id string, due string").withColumn("due", F.to_date("due"))
    window = [F.lit(x).cast("date") for x in ("2026-01-14", "2026-05-02")]
    got = {r.id: (r.gap_days, r.outlier) for r in deadlines.anomalies(rows, *window).collect()}
    assert got == {0: (0, False), 2: (0, False), 4: (0, False), 6: (2, False), 8: (57, True), 1: (0, False), 3: (0, False), 5: (0, False), 7: (2, False), 9: (58, True)}


@pytest.mark.parametrize("seed", range(3))
def test_nearest_containers(spark, seed):
    rng = random.Random(seed)
    n = 120
    rows = [(i, rng.choice([None, -5, rng.randrange(n), max(0, i - 1)]), rng.random() < 0.15, f"t{i}") for i in range(n)] + [(500 + i, 499 + i if i else None, i == 3, f"u{i}") for i in range(90)]
    frame = spark.createDataFrame(rows + rows[:5] + [(None, 1, True, "x")], "content_id int, parent_id int, is_container boolean, title string")
    up = {k: p for k, p, _, _ in rows}
    box = {k for k, _, b, _ in rows if b}

    def walk(k):
        at, steps = up[k], 1
        while at in up and at not in box and steps <= 64:
            at, steps = up[at], steps + 1
        return (at, f"t{at}" if at < 500 else f"u{at - 500}", "found") if at in box and steps <= 64 else (None, None, "cycle" if at in up and at not in box else "top" if steps <= 64 else "cycle")

    got = {r.content_id: (r.container_id, r.container_name, r.state) for r in content.nearest_containers(frame).collect()}
    assert got == {k: walk(k) for k in up}
    assert content.nearest_containers(frame.limit(0)).collect() == []
