"""The delivery cycle: what a pass must not do again."""

from tidewater.plans import catalog
from tidewater.streaming import delivery_cycle as cycle

SF = "/root/testdata/sf0.001"


def test_the_history_is_numbered_once_and_files_meet_answers_once(spark, monkeypatch):
    catalog.load_all()
    plans, states, run_pass = [], [], cycle.run_pass

    def spy(session, path, number, send, *rest):
        def told(due, n):
            out = send(due, n)
            plans.append(out._jdf.queryExecution().optimizedPlan().toString())
            return out

        run_pass(session, path, number, told, *rest)
        states.append([cycle.state_after(session, path, n).schema for n in (number - 1, number)])

    joins, with_attempt = [], cycle.delivery.with_attempt
    monkeypatch.setattr(cycle, "run_pass", spy)
    monkeypatch.setattr(cycle.delivery, "with_attempt", lambda *a: joins.append(1) or with_attempt(*a))
    catalog.QUERIES["stm09_delivery_cycle"](spark, SF).count()
    assert len(plans) > 1 and not any("Window" in p for p in plans)
    assert len(joins) == len(plans)
    assert all(a == b for a, b in states)


def test_progress_tells_every_kind_of_move(spark):
    kind = "okey long, state string, attempts_used int"
    was = [(1, "queue", 0), (2, "retry", 2)]
    seen = cycle._progress(spark.createDataFrame(was, kind))
    assert seen == (2, 1, 2) and cycle._progress(spark.createDataFrame([], kind)) == (0, 0, 0)
    for now in ([(1, "retry", 0), (2, "retry", 2)], [(1, "queue", 0), (2, "dlq", 2)], [(1, "queue", 0), (2, "retry", 3)]):
        assert cycle._progress(spark.createDataFrame(now, kind)) != seen
