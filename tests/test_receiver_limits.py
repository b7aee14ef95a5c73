"""Receiver limits: what is grouped does not grow with the receivers."""

from tidewater.operators import configs as C


def test_receiver_parts_are_cut_to_urls_before_they_are_grouped(spark):
    inst = spark.createDataFrame([("a", "http://host1:80/", 0), ("b", "ost1", 5), ("c", "none", 9)],
                                 "instance string, receiver_url string, max_bytes long")
    recv = spark.createDataFrame([(2, "xhost1:80", 100), (1, "host1", 200), (3, "other:80", 50)],
                                 "pos long, instance_api string, max_payload_size long")
    out = C.receiver_limits(inst, recv)
    got = {r.instance: (r.matched_receiver, r.receiver_limit) for r in out.collect()}
    assert got == {"a": ("host1", 200), "b": ("host1", 200), "c": (None, 50)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    at = [i for i, line in enumerate(plan.splitlines()) if "LeftSemi" in line]
    assert at and any("Aggregate [url" in line for line in plan.splitlines()[:at[0]])
