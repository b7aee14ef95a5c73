"""Conversation structure repair by bidirectional Dijkstra over an edit lattice.

A conversation should be an optional system turn and then pairs of a user and
an assistant turn. The lattice's nodes are (turns read, what came last); its
edges keep, rerole or delete a turn, or insert an empty one. Two heaps search
from both ends until their least costs together pass the best meeting, so
every crossing of equal cost is found; of the crossings, the least string of
edits wins.

Conversations are cut into segments of at most ``SEGMENT`` turns wherever they
lie after a range sort, so a conversation with a third of all turns is spread
over tasks; a segment that may not be a whole conversation is searched for
every pair of states at its ends. A last pass streams each conversation's
segments and turns once: its best edits over all segments, then the repaired
turns. That pass takes a conversation in one task, since its result is one
string of edits (and one digest); it holds that string, never the turns.

Defined results: turns go by number, NULL first, ties by role, then SHA-256 of
role and text; NULL roles and texts are one space; repeated rows are turns
that repeat; rows with a NULL conv_id are one conversation; a role is told by
its first character, an empty one by none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SEGMENT = 256
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LEGAL = ("su", "ua", "au")
# States: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# What a reroled or inserted turn leads to, and what ends a conversation.
NEXT = (USER, USER, ASSISTANT, USER)
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# Classes of turns.
SOUND, CUT_OFF, VOID = 0, 1, 2
WHOLE = -1

ORDER = ("turn", "role", "digest", "no")
RECORD = ("conv_id long, kind int, part long, nth long, turn long, role string, digest binary, no long, text string, "
          "gaps long, blank long, duplicate long, truncated long, first string, last string, illegal long, "
          "paths array<struct<source: int, target: int, cost: long, audit: string>>")
REPAIRED = ("conv_id long, position long, edit string, role string, text string, gaps long, blank long, duplicate long, "
            "truncated long, illegal long, cost long, audit string")


class Lattice:
    """The edits of a run of turns, given as (class, initial)."""

    def __init__(self, turns: list[tuple[int, str]]):
        self.turns, self.n = turns, len(turns)

    def _steps(self, i: int, q: int):
        """Edges over turn ``i`` from state ``q``: (cost, edit, state)."""
        kind, initial = self.turns[i]
        yield DELETE, "D", q
        if kind != VOID:
            extra = TRUNCATED if kind == CUT_OFF else 0
            if (q, initial) in KEPT:
                yield extra, "K", KEPT[q, initial]
            yield REROLE + extra, "R", NEXT[q]

    def ahead(self, node: int):
        """Edges (cost, edit, node) out of a node; nothing is inserted after
        the last turn, that is the next segment's part."""
        i, q = divmod(node, 4)
        if i < self.n:
            yield INSERT, "I", i * 4 + NEXT[q]
            for cost, edit, to in self._steps(i, q):
                yield cost, edit, (i + 1) * 4 + to

    def behind(self, node: int):
        """Edges (cost, edit, node) into a node."""
        i, q = divmod(node, 4)
        for p in STATES:
            if i < self.n and NEXT[p] == q:
                yield INSERT, "I", i * 4 + p
            if i:
                for cost, edit, to in self._steps(i - 1, p):
                    if to == q:
                        yield cost, edit, (i - 1) * 4 + p

    def best(self, source: int, ends: dict[int, str]) -> tuple[int, str] | None:
        """Least (cost, edits) from state ``source`` to one of the end states,
        each with the insertions that follow it."""
        import heapq

        finish = {self.n * 4 + q: tail for q, tail in ends.items()}
        dist = [{source: 0}, {v: INSERT * len(tail) for v, tail in finish.items()}]
        done: list[dict[int, int]] = [{}, {}]
        heaps = [[(c, v) for v, c in d.items()] for d in dist]
        for h in heaps:
            heapq.heapify(h)
        edges = (self.ahead, self.behind)
        meeting = min((c + dist[1][v] for v, c in dist[0].items() if v in dist[1]), default=None)
        while heaps[0] or heaps[1]:
            tops = [h[0][0] if h else 0 for h in heaps]
            if meeting is not None and sum(tops) > meeting:
                break
            side = 0 if heaps[0] and (not heaps[1] or tops[0] <= tops[1]) else 1
            cost, node = heapq.heappop(heaps[side])
            if node in done[side]:
                continue
            done[side][node] = cost
            for w, _, to in edges[side](node):
                if cost + w < dist[side].get(to, 1 << 60):
                    dist[side][to] = cost + w
                    heapq.heappush(heaps[side], (cost + w, to))
                    if to in dist[1 - side]:
                        total = cost + w + dist[1 - side][to]
                        meeting = total if meeting is None else min(meeting, total)
        if meeting is None:
            return None
        # Nothing leads into the source at less, or out of an end.
        done[0].setdefault(source, 0)
        done[1] = {v: dist[1][v] for v in finish} | done[1]
        heads = self._heads(source, done[0])
        tails = self._tails(finish, done[1])
        crossings = [heads[v] + tails[v] for v in heads if v in tails and done[0][v] + done[1][v] == meeting]
        crossings += [text + edit + tails[to] for v, text in heads.items() for w, edit, to in self.ahead(v)
                      if to in tails and done[0][v] + w + done[1][to] == meeting]
        return meeting, min(crossings)

    def _heads(self, source: int, settled: dict[int, int]) -> dict[int, str]:
        """Least edits from the source to every settled node."""
        text = {}
        for v in sorted(settled, key=lambda v: (v // 4, settled[v])):
            found = [text[u] + edit for w, edit, u in self.behind(v) if u in text and settled[u] + w == settled[v]]
            text[v] = "" if v == source else min(found)
        return text

    def _tails(self, finish: dict[int, str], settled: dict[int, int]) -> dict[int, str]:
        """Least edits from every settled node to an end."""
        text = {}
        for v in sorted(settled, key=lambda v: (-(v // 4), settled[v])):
            found = [edit + text[u] for w, edit, u in self.ahead(v) if u in text and settled[u] + w == settled[v]]
            if v in finish and settled[v] == INSERT * len(finish[v]):
                found.append(finish[v])
            text[v] = min(found)
        return text

    def paths(self, whole: bool) -> list[dict]:
        """The searches of a segment: one for a whole conversation, else one
        for every pair of states at its ends."""
        wanted = [(START, WHOLE, CLOSING)] if whole else [(p, q, {q: ""}) for p in STATES for q in STATES]
        found = ((p, q, self.best(p, ends)) for p, q, ends in wanted)
        return [{"source": p, "target": q, "cost": b[0], "audit": b[1]} for p, q, b in found if b]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _arrow(schema: str, session) -> object:
    """The Arrow schema of a schema in Spark's notation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(session.createDataFrame([], schema).schema)


def base_table(conversations: DataFrame) -> DataFrame:
    """The turns, written once, each with a number, a digest and what its text
    alone tells."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), text.alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    return cut(rows.select(
        "*", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
        .alias("digest"), (bare == "").alias("is_blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_cut"),
        F.monotonically_increasing_id().alias("no")))


def marked_turns(base: DataFrame) -> DataFrame:
    """The turns without their texts, with ``kind`` (of the lattice) and the
    first fault of each: blank, duplicate, truncated."""
    firsts = base.where(~F.col("is_blank")).groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "no")).alias("first")) \
        .select(F.col("first.no").alias("no"), F.lit(True).alias("is_first"))
    rows = base.drop("text").join(firsts, "no", "left")
    again = ~F.col("is_blank") & F.col("is_first").isNull()
    kind = F.when(F.col("is_blank") | again, VOID).when(F.col("is_cut"), CUT_OFF).otherwise(SOUND)
    return cut(rows.select("conv_id", *ORDER, F.left("role", F.lit(1)).alias("initial"), kind.alias("kind"),
                           F.col("is_blank").cast("long").alias("blank"), again.cast("long").alias("duplicate"),
                           (kind == CUT_OFF).cast("long").alias("truncated")))


def segments(marked: DataFrame) -> DataFrame:
    """The searched segments of all conversations (records of kind 1)."""
    schema = ("conv_id long, part long, nth long, first string, last string, illegal long, "
              "paths array<struct<source: int, target: int, cost: long, audit: string>>")
    arrow = _arrow(schema, marked.sparkSession)

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple[int, str]] = []
        state = {"conv": None, "nth": 0, "edge": True, "cut": False}
        out: list[dict] = []

        def close(whole: bool) -> None:
            initials = [t[1] for t in held]
            out.append({"conv_id": state["conv"], "part": part, "nth": state["nth"], "first": initials[0],
                        "last": initials[-1], "illegal": _illegal(initials), "paths": Lattice(held).paths(whole)})
            state["nth"] += 1
            held.clear()

        for batch in parts:
            for conv, kind, initial in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "initial"))):
                if held and conv != state["conv"]:
                    close(not state["edge"] and not state["cut"])
                    state.update(edge=False, cut=False)
                elif len(held) == SEGMENT:
                    close(False)
                    state["cut"] = True
                state["conv"] = conv
                held.append((kind, initial))
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out.clear()
        if held:
            # The conversation may go on in the next range.
            close(False)
            yield pa.RecordBatch.from_pylist(out, arrow)

    dealt = marked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    return dealt.select("conv_id", "kind", "initial").mapInArrow(run, schema)


class Best:
    """The best edits of a conversation so far for each state, folded over
    its segments; the strings are shared lists of pieces."""

    def __init__(self):
        self.at: dict[int, tuple[int, tuple | None]] = {START: (0, None)}
        self.illegal, self.last = 0, None
        self.known: tuple[int, str] | None = None

    @staticmethod
    def _text(link: tuple | None, stop: tuple | None = None) -> str:
        pieces = []
        while link is not stop:
            pieces.append(link[1])
            link = link[0]
        return "".join(reversed(pieces))

    def _less(self, a: tuple, b: tuple) -> bool:
        """Whether string ``a`` comes before ``b``, both of as many pieces."""
        x, y = a, b
        while x is not y:
            x, y = x[0], y[0]
        return self._text(a, x) < self._text(b, x)

    def add(self, segment: dict) -> None:
        if self.last is not None:
            self.illegal += self.last + segment["first"] not in LEGAL
        self.illegal += segment["illegal"]
        self.last = segment["last"]
        new: dict[int, tuple[int, tuple]] = {}
        for p in segment["paths"]:
            if p["target"] == WHOLE:
                self.known = p["cost"], p["audit"]
                return
            if p["source"] not in self.at:
                continue
            cost, link = self.at[p["source"]]
            cost, link = cost + p["cost"], (link, p["audit"])
            held = new.get(p["target"])
            if held is None or cost < held[0] or cost == held[0] and self._less(link, held[1]):
                new[p["target"]] = cost, link
        self.at = new

    def result(self) -> tuple[int, str]:
        return self.known or min((cost + INSERT * len(CLOSING[q]), self._text(link) + CLOSING[q])
                                 for q, (cost, link) in self.at.items())


def _report(marked: DataFrame, ids: DataFrame) -> DataFrame:
    """Counts of every conversation of ``ids`` (records of kind 0)."""
    counts = marked.groupBy("conv_id").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    counts = counts.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)
    return counts.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c)
                                           for c in ("gaps", "blank", "duplicate", "truncated")])


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The repaired turns of every conversation: conv_id, position from 1,
    edit, role, text. The row of position 0 holds the conversation's report:
    gaps, blank, duplicate, truncated, illegal, cost, audit. ``ids`` may name
    conversations (conv_id) without turns. A conversation's rows lie together
    in one partition, in order."""
    session = conversations.sparkSession
    base = base_table(conversations)
    marked = marked_turns(base)
    heads = _report(marked, marked if ids is None else ids).withColumn("kind", F.lit(0))
    parts = cut(segments(marked)).withColumn("kind", F.lit(1))
    text = F.when(~F.col("is_blank"), F.col("text")).alias("text")
    turns = base.select("conv_id", *ORDER, text).withColumn("kind", F.lit(2))
    empty = session.createDataFrame([], RECORD)
    records = empty.unionByName(heads, allowMissingColumns=True).unionByName(parts, allowMissingColumns=True) \
        .unionByName(turns, allowMissingColumns=True)
    arrow = _arrow(REPAIRED, session)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ("conv_id", "kind", "role", "text", "gaps", "blank", "duplicate", "truncated", "first", "last", "illegal",
                 "paths")
        out: list[dict] = []
        head: dict = {}
        best = walk = None

        class Walk:
            """The edits of one conversation, applied turn by turn."""

            def __init__(self, conv: int | None, audit: str):
                self.conv, self.audit, self.at, self.state, self.position = conv, audit, 0, START, 0

            def _emit(self, edit: str, state: int, role: str | None, text: str) -> None:
                self.position += 1
                self.state = state
                out.append({"conv_id": self.conv, "position": self.position, "edit": edit,
                            "role": ROLES[state] if role is None else role, "text": text})

            def insert(self) -> None:
                while self.audit[self.at:self.at + 1] == "I":
                    self.at += 1
                    self._emit("I", NEXT[self.state], None, "")

            def turn(self, role: str, text: str | None) -> None:
                self.insert()
                edit = self.audit[self.at]
                self.at += 1
                if edit == "K":
                    self._emit(edit, KEPT[self.state, role[:1]], role, text)
                elif edit == "R":
                    self._emit(edit, NEXT[self.state], None, text)

        def start() -> Walk:
            cost, audit = best.result()
            out.append({**head, "position": 0, "illegal": best.illegal, "cost": cost, "audit": audit})
            return Walk(head["conv_id"], audit)

        def end() -> None:
            nonlocal walk
            if best is not None:
                walk = walk or start()
                walk.insert()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                r = dict(zip(names, row))
                if r["kind"] == 0:
                    end()
                    head = {c: r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated")}
                    best, walk = Best(), None
                elif r["kind"] == 1:
                    best.add(r)
                else:
                    walk = walk or start()
                    walk.turn(r["role"], r["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out.clear()
        end()
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    order = ["conv_id", "kind", "part", "nth", *ORDER]
    return records.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, REPAIRED)


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation: its report and repaired_sha256, the digest of
    its repaired ``role:text`` turns joined by line breaks."""
    schema = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")
    arrow = _arrow(schema, repaired.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        head, hashed = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["position"] == 0:
                    if head:
                        out.append({**head, "repaired_sha256": hashed.hexdigest()})
                    head, hashed = {k: r[k] for k in arrow.names[:-1]}, hashlib.sha256()
                else:
                    line = f"{r['role']}:{r['text']}"
                    hashed.update(line.encode() if r["position"] == 1 else b"\n" + line.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if head:
            yield pa.RecordBatch.from_pylist([{**head, "repaired_sha256": hashed.hexdigest()}], arrow)

    return repaired.mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by the CRC-32 of ``conv_id:turn``
    modulo 20: 0 drops a row, 1 empties its text, 2 removes its end marks,
    3 repeats it, 4 makes it the user's. NULLs are one space."""
    names = {c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")}
    code = F.pmod(F.crc32(F.concat(names["conv_id"], F.lit(":"), names["turn"]).cast("binary")), F.lit(20))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", code.alias("_code"), role.alias("role"), text.alias("text")).where("_code > 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
        .alias("text"), F.explode(F.expr("sequence(1, if(_code = 3, 2, 1))")).alias("_copy")).drop("_copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The digests of the repaired conversations after ``damage``."""
    return digest(repair(damage(conversations), conversations))
