"""NetFlow v9 and IPFIX datagrams to decoded packets and flow messages.

A datagram holds sets; template sets say how later data sets of the same
exporter, version and observation domain are laid out. A collector keeps them
in a cache; here a data set takes the last template that came before it, by an
as-of lookup over ranges of (exporter, domain, template, time), so an exporter
with a third of all datagrams is spread over tasks. Sets and templates are
walked, records are cut and values are read by built-in binary functions.

Input: packet_id, exporter (its address, binary), received (an orderable
time), payload (binary). Order is by received, then packet_id.

Defined results: a datagram that is NULL, of another version, shorter than its
header says or holding a set that reaches past its end has an ``error``, and
none of its templates or flows count. A data set without a template is left
out, the rest of its datagram stays (``resolved_sets`` tells). Templates count
per exporter; one without fields withdraws the earlier one; one that is cut
off by its set's end is left out; trailing bytes of a set that hold no whole
record are padding. Of an element that a template repeats the last value
counts. Numbers above 2^63 - 1 are NULL. Records of option templates describe
the exporter: ``records`` marks them (``scope`` above 0), ``messages`` drops
them and takes the sampling rate that they told. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.prefix import last_non_null

NETFLOW, IPFIX = 9, 10
# Header bytes, ids of template and option template sets, the
# first id of a data set, the length that marks a value of variable length,
# seconds from 1900 to 1970.
HEADER = {NETFLOW: 20, IPFIX: 16}
TEMPLATE_SETS, OPTION_SETS, FIRST_DATA = (0, 2), (1, 3), 256
VARIABLE = 65535
NTP_EPOCH = 2208988800
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"

KEY = ["exporter", "version", "domain", "set_id"]
ORDER = ["received", "packet_id", "set_no", "item_no"]
TEMPLATE = "struct<scope:int,width:int,fields:array<struct<key:bigint,at:int,len:int>>>"


def _uint(data: str, pos: str, size: int) -> str:
    """SQL: the unsigned big-endian number of ``size`` bytes at 0-based
    ``pos``; NULL past the end."""
    part = f"substring({data}, {pos} + 1, {size})"
    return f"if(octet_length({part}) = {size}, cast(conv(hex({part}), 16, 10) as bigint), null)"


def _int(data: str, pos: str) -> str:
    return f"cast({_uint(data, pos, 2)} as int)"


def _once(walk: Column) -> Column:
    """A walk that filters on its result do not repeat: the optimizer moves no
    filter below a projection that numbers rows."""
    return F.when(F.monotonically_increasing_id() >= 0, walk)


def _keep_compiled(spark: SparkSession) -> None:
    """The JVM never compiles methods above 8,000 bytes of bytecode, and a
    stage that renders all fields of a flow is one: such stages go without
    whole-stage code, in small methods, unless the caller has set a limit."""
    if spark.conf.get(HUGE_METHOD, None) is None:
        spark.conf.set(HUGE_METHOD, "8000")


def packets(datagrams: DataFrame) -> DataFrame:
    """Header, ``error`` (NULL if none) and sets (id, at, size) of every
    datagram."""
    _keep_compiled(datagrams.sparkSession)
    d = datagrams.select("packet_id", "exporter", "received", "payload").withColumns({
        "version": F.expr(_int("payload", "0")), "_second": F.expr(_int("payload", "2")),
        "_bytes": F.octet_length("payload")})
    v9, v10 = F.col("version") == NETFLOW, F.col("version") == IPFIX
    first = F.when(v9, HEADER[NETFLOW]).when(v10, HEADER[IPFIX])
    d = d.withColumns({"_first": first, "_stop": F.when(v10, F.col("_second")).when(v9, F.col("_bytes"))})
    short = (F.col("_bytes") < F.col("_first")) | (F.col("_stop") < F.col("_first")) | (F.col("_stop") > F.col("_bytes"))
    d = d.withColumns({
        "error": F.when(F.col("_first").isNull(), "version").when(short, "short"),
        "count": F.when(v9, F.col("_second")),
        "uptime": F.when(v9, F.expr(_uint("payload", "4", 4))),
        "exported": F.expr(f"if(version = {NETFLOW}, {_uint('payload', '8', 4)}, {_uint('payload', '4', 4)})"),
        "sequence": F.expr(f"if(version = {NETFLOW}, {_uint('payload', '12', 4)}, {_uint('payload', '8', 4)})"),
        "domain": F.expr(f"if(version = {NETFLOW}, {_uint('payload', '16', 4)}, {_uint('payload', '12', 4)})")})
    # A set takes four bytes at least; v9 counts records, no set is without.
    room = F.expr("cast((_stop - _first) div 4 as int)")
    d = d.withColumn("_steps", F.when(F.col("error").isNull(), F.when(v9, F.least("count", room)).otherwise(room)).otherwise(0))
    size = _int("payload", "a.pos + 2")
    d = d.withColumn("_walk", _once(F.expr(f"""
        aggregate(if(_steps > 0, sequence(1, _steps), cast(array() as array<int>)),
          named_struct('pos', _first, 'sets', cast(array() as array<struct<id:int,at:int,size:int>>)),
          (a, i) -> if(a.pos + 4 > _stop, a, named_struct(
            'pos', if({size} < 4, 1 << 30, a.pos + {size}),
            'sets', array_append(a.sets, named_struct('id', {_int("payload", "a.pos")}, 'at', a.pos + 4, 'size', {size} - 4)))))""")))
    error = F.coalesce("error", F.when(F.col("_walk.pos") > F.col("_stop"), "set length"))
    return d.select("packet_id", "exporter", "received", "version", "count", "uptime", "exported", "sequence", "domain",
                    error.alias("error"), F.when(error.isNull(), F.col("_walk.sets")).alias("sets"), "payload")


def sets(decoded: DataFrame) -> DataFrame:
    """The sets of sound datagrams (of ``packets``): set_no, set_id, body."""
    d = decoded.where(F.col("error").isNull())
    head = [c for c in d.columns if c not in ("error", "sets", "payload")]
    bodies = F.transform("sets", lambda s: F.struct(
        s["id"].alias("id"), F.substring("payload", s["at"] + 1, s["size"]).alias("body")))
    return d.select(*head, F.posexplode(bodies).alias("set_no", "_s")).select(
        *head, "set_no", F.col("_s.id").alias("set_id"), F.col("_s.body").alias("body"))


def templates(all_sets: DataFrame) -> DataFrame:
    """The templates that ``sets`` announce: the key columns (``set_id`` is
    the id of the data sets that follow it), the order columns, and
    ``template``: scope fields, bytes a record (NULL if they vary), fields."""
    named = [*TEMPLATE_SETS, *OPTION_SETS]
    d = all_sets.where(F.col("set_id").isin(named)).withColumns({
        "_opt": F.col("set_id").isin(*OPTION_SETS), "_v9": F.col("version") == NETFLOW, "_size": F.octet_length("body")})
    two, four = _int("body", "a.pos + 2"), _int("body", "a.pos + 4")
    number = f"if(_opt and _v9, ({two} + {four}) div 4, {two})"
    scope = f"if(_opt, if(_v9, {four.replace('a.pos + 4', 'a.pos + 2')} div 4, {four}), 0)"
    field, width = _int("body", "a.pos"), two
    private = f"(not _v9 and {field} >= 32768)"
    # Scope types of v9 are numbers of their own: kept apart as negatives.
    key = (f"if({private}, {_uint('body', 'a.pos + 4', 4)} * 65536 + {field} - 32768, "
           f"if(_v9 and a.scope > size(a.fields), -1 - cast({field} as bigint), cast({field} as bigint)))")
    grown = f"array_append(a.fields, named_struct('key', {key}, 'at', a.at, 'len', {width}))"
    none = "cast(array() as array<struct<key:bigint,at:int,len:int>>)"
    found = f"array<struct<id:int,template:{TEMPLATE}>>"

    def state(pos, id_, left, scope_, at, varies, fields, out):
        return (f"named_struct('pos', cast({pos} as int), 'id', cast({id_} as int), 'left', cast({left} as int), "
                f"'scope', cast({scope_} as int), 'at', cast({at} as int), 'varies', {varies}, 'fields', {fields}, 'out', {out})")

    withdrawn = f"named_struct('id', {field}, 'template', cast(null as {TEMPLATE}))"
    whole = (f"named_struct('id', a.id, 'template', named_struct('scope', a.scope, 'width', "
             f"if(a.varies or {width} = {VARIABLE}, cast(null as int), a.at + {width}), 'fields', {grown}))")
    head = state("a.pos + if(_opt, 6, 4)", field, number, scope, 0, "false", none,
                 f"if({number} = 0, array_append(a.out, {withdrawn}), a.out)")
    step = f"a.pos + if({private}, 8, 4)"
    more = state(step, "a.id", "a.left - 1", "a.scope", f"a.at + {width}", f"a.varies or {width} = {VARIABLE}", grown, "a.out")
    last = state(step, 0, 0, 0, 0, "false", none, f"array_append(a.out, {whole})")
    stop = state("1 << 30", 0, 0, 0, 0, "false", none, "a.out")
    d = d.withColumn("_found", _once(F.expr(f"""
        aggregate(if(_size >= 4, sequence(1, _size div 4), cast(array() as array<int>)),
          {state(0, 0, 0, 0, 0, "false", none, f"cast(array() as {found})")},
          (a, i) -> case
            when a.pos + if(a.left = 0 and _opt, 6, 4) > _size or (a.left > 0 and {private} and a.pos + 8 > _size) then a
            when a.left = 0 and {field} < {FIRST_DATA} then {stop}
            when a.left = 0 then {head}
            when a.left > 1 then {more}
            else {last} end).out""")))
    d = d.select("packet_id", "exporter", "received", "version", "domain", "set_no", F.posexplode("_found").alias("item_no", "_t"))
    empty = F.from_json(F.lit('{"fields": []}'), TEMPLATE)
    return d.select("packet_id", "exporter", "received", "version", "domain", "set_no", "item_no",
                    F.col("_t.id").alias("set_id"), F.coalesce("_t.template", empty).alias("template"))


def resolved_sets(all_sets: DataFrame) -> DataFrame:
    """The data sets, each with the ``template`` in force (NULL: none)."""
    known = templates(all_sets).withColumn("is_data", F.lit(False))
    data = all_sets.where(F.col("set_id") >= FIRST_DATA).withColumns({"item_no": F.lit(0), "is_data": F.lit(True)})
    both = data.unionByName(known, allowMissingColumns=True)
    found = last_non_null(both, F.col("template"), KEY, ORDER, "_known").where("is_data")
    usable = F.size("_known.fields") > 0
    return found.withColumn("template", F.when(usable, F.col("_known"))).drop("_known", "is_data", "item_no")


def _cells() -> Column:
    """The values of each record of ``body`` under ``template``, as arrays."""
    size, width = "octet_length(body)", "template.width"
    fixed = (f"transform(sequence(0, {size} div {width} - 1), r -> transform(template.fields, "
             f"f -> substring(body, r * {width} + f.at + 1, f.len)))")
    # One field a step; a value of variable length names it in one byte, or
    # in two after 255. A record takes ``least`` bytes at least.
    count = "size(template.fields)"
    least = f"aggregate(template.fields, 0, (n, f) -> n + if(f.len = {VARIABLE}, 1, f.len))"
    field = "template.fields[size(a.values)]"
    one = "cast(conv(hex(substring(body, a.pos + 1, 1)), 16, 10) as int)"
    long = f"case when {field}.len < {VARIABLE} then {field}.len when {one} < 255 then {one} else {_int('body', 'a.pos + 1')} end"
    skip = f"if({field}.len < {VARIABLE}, 0, if({one} < 255, 1, 3))"
    grown = "array_append(a.values, substring(body, a.pos + x.skip + 1, x.long))"
    end = f"named_struct('pos', {size}, 'values', a.values, 'out', a.out)"
    full = f"size(v) = {count}"
    state = (f"named_struct('pos', a.pos + x.skip + x.long, 'values', if({full}, cast(array() as array<binary>), v), "
             f"'out', if({full}, array_append(a.out, v), a.out))")
    # ``get(transform(array(y), x -> ..), 0)`` computes y once.
    step = (f"get(transform(array(named_struct('skip', {skip}, 'long', {long})), x -> if(x.long is null or a.pos + x.skip + x.long > {size}, "
            f"{end}, get(transform(array({grown}), v -> {state}), 0))), 0)")
    walked = f"""
        aggregate(sequence(1, greatest(1, {size} div {least} * {count})),
          named_struct('pos', 0, 'values', cast(array() as array<binary>), 'out', cast(array() as array<array<binary>>)),
          (a, i) -> if(a.pos >= {size}, a, {step})).out"""
    none = "cast(array() as array<array<binary>>)"
    return F.expr(f"case when template is null or {size} = 0 or {width} = 0 or {width} > {size} then {none} "
                  f"when {width} is not null then {fixed} else {walked} end")


def with_sampling(resolved: DataFrame) -> DataFrame:
    """Add ``sampling``: the rate that the exporter's options last told for the
    domain, those of the same datagram included (NULL: none yet)."""
    keys = F.col("template.fields.key")
    place = F.coalesce(*[F.nullif(F.array_position(keys, F.lit(e).cast("long")), F.lit(0)) for e in SAMPLING])
    options = F.when((F.col("template.scope") > 0) & place.isNotNull(), _cells())
    d = resolved.withColumns({"_place": place.cast("int"), "_options": _once(options)})
    told = _number(F.get(F.get("_options", F.size("_options") - 1), F.col("_place") - 1))
    d = d.select(*resolved.columns, told.alias("_told"), F.coalesce(F.col("template.scope") == 0, F.lit(True)).alias("_late"))
    found = last_non_null(d, F.col("_told"), KEY[:3], ["received", "packet_id", "_late", "set_no"], "sampling")
    return found.drop("_told", "_late")


def records(datagrams: DataFrame) -> DataFrame:
    """One row per record of every data set whose template is known: the
    packet's columns, sampling, set_no, set_id, scope, record_no and
    ``values``, a map from element (enterprise * 65536 + number) to bytes."""
    d = with_sampling(resolved_sets(sets(packets(datagrams))))
    keep = [c for c in d.columns if c not in ("body", "template")]
    d = d.withColumn("_cells", _once(_cells())).select(
        *keep, F.col("template.scope").alias("scope"), F.col("template.fields.key").alias("_keys"),
        F.posexplode("_cells").alias("record_no", "_cells"))
    return d.select(*keep, "scope", "record_no", F.map_from_arrays("_keys", "_cells").alias("values"))


# Information elements (numbers of the public registry) by the
# flow message field that they fill; the first that a record has counts.
NUMBERS = (
    ("Bytes", 1, 85), ("Packets", 2, 86), ("Etype", 256), ("Proto", 4), ("SrcPort", 7),
    ("DstPort", 11), ("InIf", 10), ("OutIf", 14), ("SrcMac", 56), ("DstMac", 80, 57), ("SrcVlan", 58), ("DstVlan", 59),
    ("VlanId", 58), ("IpTos", 5), ("IpTtl", 52, 192), ("TcpFlags", 6), ("Ipv6FlowLabel", 31), ("FragmentId", 54),
    ("FragmentOffset", 88), ("SrcAs", 16), ("DstAs", 17), ("SrcNet", 9, 29), ("DstNet", 13, 30),
    ("ObservationPointId", 138), ("ForwardingStatus", 89),
)
SAMPLING = (305, 50, 34)
ADDRESSES = (("SrcAddr", 8, 27), ("DstAddr", 12, 28), ("NextHop", 15, 62), ("BgpNextHop", 18, 63))
ICMP_TYPE, ICMP_CODE, ICMP_BOTH = (176, 178), (177, 179), (32, 139)
# Start and end of a flow: in milliseconds of uptime, seconds, milliseconds,
# and as NTP times.
TIMES = (("TimeFlowStartNs", 22, 150, 152, (154, 156)), ("TimeFlowEndNs", 21, 151, 153, (155, 157)))


def _value(*elements: int) -> Column:
    return F.coalesce(*[F.try_element_at("values", F.lit(e).cast("long")) for e in elements])


def _number(value: Column) -> Column:
    """The unsigned number of up to eight bytes, else NULL."""
    return F.when(F.octet_length(value) <= 8, F.conv(F.hex(value), 16, 10).try_cast("long"))


def messages(found: DataFrame) -> DataFrame:
    """The flow messages of ``records``, one a row, as ``flows`` (an array of
    one): the input of ``flows.ipfix_rows`` and ``flows.ipfix_ndjson``.
    packet_id becomes (packet_id, set_no, record_no)."""
    d = found.where("scope = 0")
    raw = {f"_{n}": _value(*e) for n, *e in NUMBERS + ADDRESSES}
    raw |= {"_told": _value(*SAMPLING), "_type": _value(*ICMP_TYPE), "_code": _value(*ICMP_CODE), "_both": _value(*ICMP_BOTH)}
    for name, up, sec, ms, ntp in TIMES:
        raw |= {f"_{name}_up": _value(up), f"_{name}_s": _value(sec), f"_{name}_ms": _value(ms), f"_{name}_ntp": _value(*ntp)}
    d = d.select("packet_id", "set_no", "record_no", "exporter", "version", "uptime", "exported", "sequence", "domain", "sampling",
                 *[v.alias(n) for n, v in raw.items()])

    def time(name: str) -> Column:
        boot = F.col("exported") * 1000 - F.col("uptime")
        ntp = F.col(f"_{name}_ntp")
        since = (_number(F.substring(ntp, 1, 4)) - NTP_EPOCH) * 1_000_000_000
        # The low 32 bits count 2^-32 seconds.
        part = F.shiftrightunsigned(_number(F.substring(ntp, 5, 4)) * 1_000_000_000, 32)
        up, sec, ms = (_number(F.col(f"_{name}_{unit}")) for unit in ("up", "s", "ms"))
        return F.coalesce(F.try_multiply(F.try_add(boot, up), F.lit(1_000_000)), F.try_multiply(sec, F.lit(1_000_000_000)),
                          F.try_multiply(ms, F.lit(1_000_000)), since + part)

    both = _number(F.col("_both"))
    fields = [F.when(F.col("version") == NETFLOW, "NETFLOW_V9").otherwise("IPFIX").alias("Type"),
              *[time(name).alias(name) for name, *_ in TIMES],
              F.col("sequence").alias("SequenceNum"), F.col("exporter").alias("SamplerAddress"),
              F.coalesce("sampling", _number(F.col("_told"))).alias("SamplingRate"),
              F.col("domain").alias("ObservationDomainId"),
              *[_number(F.col(f"_{n}")).alias(n) for n, *_ in NUMBERS], *[F.col(f"_{n}").alias(n) for n, *_ in ADDRESSES],
              F.coalesce(_number(F.col("_type")), F.shiftright(both, 8)).alias("IcmpType"),
              F.coalesce(_number(F.col("_code")), both.bitwiseAND(255)).alias("IcmpCode")]
    return d.select(F.struct("packet_id", "set_no", "record_no").alias("packet_id"), F.array(F.struct(*fields)).alias("flows"))


def netflow_packets(datagrams: DataFrame) -> DataFrame:
    """Decoded NetFlow v9 packets, the input of ``flows.netflow_ndjson``:
    header and data flow sets with the elements and values (base64) of their
    records. A packet's sets are at most a datagram."""
    heads = packets(datagrams).where((F.col("version") == NETFLOW) & F.col("error").isNull())
    found = resolved_sets(sets(heads)).where("template is not null")
    # Each value meets the key of its field by position.
    rows = F.transform(F.col("_cells"), lambda cells: F.struct(F.transform(cells, lambda v, i: F.struct(
        F.get(F.col("template.fields.key"), i).alias("Type"), F.base64(v).alias("Value"))).alias("Values")))
    parts = found.withColumn("_cells", _cells()).select("packet_id", "set_no", F.struct(
        F.col("set_id").alias("Id"), (F.octet_length("body") + 4).alias("Length"), rows.alias("Records")).alias("set"))
    grouped = parts.groupBy("packet_id").agg(F.sort_array(F.collect_list(F.struct("set_no", "set"))).alias("_sets"))
    kind = "array<struct<Id:int,Length:int,Records:array<struct<Values:array<struct<Type:bigint,Value:string>>>>>>"
    return heads.join(grouped, "packet_id", "left").select(
        "packet_id", F.col("version").alias("Version"), F.col("count").alias("Count"), F.col("uptime").alias("SystemUptime"),
        F.col("exported").alias("UnixSeconds"), F.col("sequence").alias("SequenceNumber"), F.col("domain").alias("SourceId"),
        F.coalesce(F.col("_sets.set"), F.array()).cast(kind).alias("FlowSets"))
