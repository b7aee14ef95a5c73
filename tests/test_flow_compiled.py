"""Stages over flow datagrams stay within what the JVM compiles."""

from tidewater.operators import flow_wire
from tidewater.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_limit_is_set_unless_the_caller_has_one(spark):
    old = spark.conf.get(flow_wire.HUGE_METHOD, None)
    try:
        spark.conf.unset(flow_wire.HUGE_METHOD)
        flow_wire.packets(fx.datagrams(spark, SF))
        assert spark.conf.get(flow_wire.HUGE_METHOD) == "8000"
        spark.conf.set(flow_wire.HUGE_METHOD, "9000")
        flow_wire.packets(fx.datagrams(spark, SF))
        assert spark.conf.get(flow_wire.HUGE_METHOD) == "9000"
    finally:
        spark.conf.unset(flow_wire.HUGE_METHOD)
        if old is not None:
            spark.conf.set(flow_wire.HUGE_METHOD, old)
