"""Stateful streaming operators: safe release, causal order, newest only, failure detection, triangle estimates."""

from __future__ import annotations

import heapq
import json
import random
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stateful(stream: DataFrame, keys: list[str], schema: str, step: Callable[[dict, pd.DataFrame], list[dict]], order: list[str]) -> DataFrame:
    """Apply step(state, rows in order) to each batch of each key; the state is a JSON object."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = step(state, rows)
        held.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def safe_release(stream: DataFrame, nodes: list[str]) -> DataFrame:
    """(log, node, time, action, released_at) of (log, arrival, node, time, action): records in the order of time, once safe.

    A record is held until every declared node has been heard from with a time of at least its own;
    a silent node holds all back, as it must. Nothing is ever dropped.
    """

    def step(state: dict, rows: pd.DataFrame) -> list[dict]:
        clock, queue, out = state.setdefault("clock", {}), state.setdefault("queue", []), []
        for r in rows.itertuples():
            clock[r.node] = max(clock.get(r.node, 0), int(r.time))
            heapq.heappush(queue, [int(r.time), r.node, r.action])
            safe = min(clock.get(n, 0) for n in nodes)
            while queue and queue[0][0] <= safe:
                t, n, a = heapq.heappop(queue)
                out.append({"log": r.log, "node": n, "time": t, "action": a, "released_at": int(r.arrival)})
        return out

    return _stateful(stream, ["log"], "log string, node string, time long, action string, released_at long", step, ["arrival"])


def causal_delivery(stream: DataFrame) -> DataFrame:
    """(receiver, src, msg, released_at) of (receiver, arrival, src, clock MAP, msg): a message waits until all that it depends on was delivered.

    clock holds how many messages of each node had been delivered when the message was sent.
    """

    def step(state: dict, rows: pd.DataFrame) -> list[dict]:
        seen, queue, out = state.setdefault("seen", {}), state.setdefault("queue", []), []
        for r in rows.itertuples():
            queue.append([r.src, dict(r.clock), r.msg])
            moved = True
            while moved:
                moved = False
                for q in list(queue):
                    if all(int(v) <= seen.get(n, 0) for n, v in q[1].items()):
                        queue.remove(q)
                        seen[q[0]] = seen.get(q[0], 0) + 1
                        out.append({"receiver": r.receiver, "src": q[0], "msg": q[2], "released_at": int(r.arrival)})
                        moved = True
        return out

    return _stateful(stream, ["receiver"], "receiver string, src string, msg string, released_at long", step, ["arrival"])


def newest_only(stream: DataFrame) -> DataFrame:
    """(node, seq, value) of (node, arrival, seq, value) whose number exceeds all before it of its node."""

    def step(state: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for r in rows.itertuples():
            if r.seq > state.get("seq", -1):
                state["seq"] = int(r.seq)
                out.append({"node": r.node, "seq": int(r.seq), "value": r.value})
        return out

    return _stateful(stream, ["node"], "node string, seq long, value string", step, ["arrival"])


def adaptive_suspicions(stream: DataFrame, period: float, delta: float) -> DataFrame:
    """(node, last, next, period): silences of (node, ts in seconds) beyond the node's period, which grows by delta with each."""

    def step(state: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for r in rows.itertuples():
            allowed = state.setdefault("period", period)
            if "last" in state and r.ts - state["last"] > allowed:
                out.append({"node": r.node, "last": state["last"], "next": float(r.ts), "period": allowed})
                state["period"] = allowed + delta
            state["last"] = max(float(r.ts), state.get("last", float(r.ts)))
        return out

    return _stateful(stream, ["node"], "node string, last double, next double, period double", step, ["ts"])


def lamport_stamps(stream: DataFrame) -> DataFrame:
    """(node, seq, time) of (node, seq, incoming): each node's clock after every step, ahead of what a message carries."""

    def step(state: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for r in rows.itertuples():
            seen = 0 if pd.isna(r.incoming) else int(r.incoming)
            state["time"] = max(state.get("time", 0), seen) + 1
            out.append({"node": r.node, "seq": int(r.seq), "time": state["time"]})
        return out

    return _stateful(stream, ["node"], "node string, seq long, time long", step, ["seq"])


def vector_release(stream: DataFrame) -> DataFrame:
    """(log, node, msg, released_at, queue) of (log, arrival, node, clock MAP, msg): records once their vector is at most what was seen.

    Of each node the seen vector has its own entry of its last record; queue is how many are still held then.
    """

    def step(state: dict, rows: pd.DataFrame) -> list[dict]:
        seen, queue, out = state.setdefault("seen", {}), state.setdefault("queue", []), []
        for r in rows.itertuples():
            clock = {k: int(v) for k, v in dict(r.clock).items()}
            seen[r.node] = max(seen.get(r.node, 0), clock.get(r.node, 0))
            queue.append([r.node, clock, r.msg])
            free = [q for q in queue if all(v <= seen.get(k, 0) for k, v in q[1].items())]
            if free:
                queue[:] = [q for q in queue if q not in free]
                out += [{"log": r.log, "node": n, "msg": m, "released_at": int(r.arrival), "queue": len(queue)} for n, _, m in free]
        return out

    return _stateful(stream, ["log"], "log string, node string, msg string, released_at long, queue long", step, ["arrival"])


def acceptor(stream: DataFrame) -> DataFrame:
    """(node, seq, ballot, reply, accepted_ballot, accepted_value) to each message (node, seq, kind, ballot, value) of a vote on one value.

    State is the ballot promised and what was accepted last: a "prepare" above it is promised, an "accept"
    of at least it is accepted, all else is refused.
    """

    def step(state: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for r in rows.itertuples():
            top, before = state.get("top", 0), state.get("accepted", [None, None])
            good = r.ballot > top if r.kind == "prepare" else r.ballot >= top
            reply = ("promise" if r.kind == "prepare" else "accepted") if good else "nack"
            if good:
                state["top"] = int(r.ballot)
                if r.kind == "accept":
                    state["accepted"] = [int(r.ballot), r.value]
            out.append({"node": r.node, "seq": int(r.seq), "ballot": int(r.ballot), "reply": reply, "accepted_ballot": before[0], "accepted_value": before[1]})
        return out

    return _stateful(stream, ["node"], "node string, seq long, ballot long, reply string, accepted_ballot long, accepted_value string", step, ["seq"])


def timed_suspicions(stream: DataFrame, period: float, delta: float, delay: str = "0 seconds") -> DataFrame:
    """(node, event, at): "suspect" when event time passes a node's last heartbeat by its period, "restore" when it is heard of again.

    stream is (node, ts TIMESTAMP). A timer for each node fires once the watermark, ``delay`` behind the
    latest heartbeat of all, is past it, so a node that falls silent for good is found too. A restored
    node's period grows by ``delta`` seconds.
    """
    schema = "node string, event string, at double"

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, own, suspected = held.get if held.exists else (0.0, period, False)
        out = []
        if held.hasTimedOut:
            out.append((key[0], "suspect", last + own))
            suspected = True
            held.update((last, own, suspected))
        else:
            for t in sorted(x.timestamp() for b in batches for x in b["ts"]):
                if suspected:
                    out.append((key[0], "restore", t))
                    suspected, own = False, own + delta
                elif last and t - last > own:
                    out += [(key[0], "suspect", last + own), (key[0], "restore", t)]
                    own += delta
                last = max(last, t)
            held.update((last, own, suspected))
            held.setTimeoutTimestamp(max(int((last + own) * 1000), held.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["node", "event", "at"])

    marked = stream.select("node", "ts").withWatermark("ts", delay)
    return marked.groupBy("node").applyInPandasWithState(run, schema, "last double, period double, suspected boolean", "append", GroupStateTimeout.EventTimeTimeout)


def colour_fold(stream: DataFrame) -> DataFrame:
    """(node, seq, r, g, b) after each delivery (node, seq, n), in order of seq within what has arrived."""

    def step(state: dict, rows: pd.DataFrame) -> list[dict]:
        out = []
        for r in rows.itertuples():
            red, green, blue = state.get("rgb", [0, 0, 0])
            state["rgb"] = [green, blue, (red + int(r.n)) % 256]
            out.append(dict(zip(("node", "seq", "r", "g", "b"), (r.node, int(r.seq), *state["rgb"]), strict=True)))
        return out

    return _stateful(stream, ["node"], "node string, seq long, r long, g long, b long", step, ["seq"])


def first_delivery(stream: DataFrame, event_time: str, delay: str, *keys: str) -> DataFrame:
    """The first copy of each key, remembered for ``delay`` of event time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


class TriangleEstimator:
    """Edge and wedge reservoirs over a stream of undirected edges; slots are replaced independently."""

    def __init__(self, edge_slots: int, wedge_slots: int, seed: int = 1):
        self.rng = random.Random(seed)
        self.t = self.total = 0
        self.edges: list = [None] * edge_slots
        self.wedges: list = [None] * wedge_slots
        self.closed = [False] * wedge_slots

    def add(self, a: int, b: int) -> None:
        self.t += 1
        edge = (min(a, b), max(a, b))
        for i, w in enumerate(self.wedges):
            if w is not None and w[0] == edge:
                self.closed[i] = True
        hit = [i for i in range(len(self.edges)) if self.rng.random() <= 1 / self.t]
        if not hit:
            return
        for i in hit:
            self.edges[i] = edge
        degree = Counter(x for e in self.edges if e for x in e)
        self.total = sum(d * (d - 1) // 2 for d in degree.values())
        new = []
        for e in {x for x in self.edges if x and x != edge}:
            common = set(e) & set(edge)
            if len(common) == 1:
                ends = (set(e) | set(edge)) - common
                new.append(((min(ends), max(ends)), common.pop()))
        if new and self.total:
            for i in range(len(self.wedges)):
                if self.rng.random() <= min(1.0, len(new) / self.total):
                    self.wedges[i], self.closed[i] = self.rng.choice(new), False

    def estimate(self) -> tuple[float, float]:
        """(transitivity, triangles)."""
        p = sum(self.closed) / len(self.wedges)
        s = len(self.edges)
        return 3 * p, p * self.t * self.t / (s * (s - 1)) * self.total


def triangle_estimates(stream: DataFrame, edge_slots: int = 500, wedge_slots: int = 500, every: int = 1000, seed: int = 1) -> DataFrame:
    """(graph, t, transitivity, triangles) after every ``every`` edges of (graph, t, src, dst)."""

    def step(state: dict, rows: pd.DataFrame) -> list[dict]:
        e = TriangleEstimator(edge_slots, wedge_slots, seed)
        if "t" in state:
            e.t, e.total, e.closed = state["t"], state["total"], state["closed"]
            e.edges = [None if x is None else tuple(x) for x in state["edges"]]
            e.wedges = [None if x is None else (tuple(x[0]), x[1]) for x in state["wedges"]]
            s = state["rng"]
            e.rng.setstate((s[0], tuple(s[1]), s[2]))
        out = []
        for r in rows.itertuples():
            if r.src != r.dst:
                e.add(int(r.src), int(r.dst))
                if e.t % every == 0:
                    k, n = e.estimate()
                    out.append({"graph": r.graph, "t": e.t, "transitivity": k, "triangles": n})
        state.update(t=e.t, total=e.total, closed=e.closed, edges=e.edges, wedges=e.wedges, rng=e.rng.getstate())
        return out

    return _stateful(stream, ["graph"], "graph string, t long, transitivity double, triangles double", step, ["t"])


def estimate_triangles(edges: list[tuple[int, int]], edge_slots: int, wedge_slots: int, seed: int = 1) -> tuple[float, float]:
    """The estimates after a list of edges."""
    e = TriangleEstimator(edge_slots, wedge_slots, seed)
    for a, b in edges:
        if a != b:
            e.add(a, b)
    return e.estimate()


def stamp_events(stream: DataFrame) -> DataFrame:
    """Event times as the seconds that the detectors read."""
    return stream.withColumn("ts", F.unix_micros("ts") / 1e6)
