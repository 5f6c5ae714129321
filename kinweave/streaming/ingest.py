"""Incremental ingest: facts folded into edges by keyed state, and the latest state of a change stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinweave.operators.fold import FOLDED, NAMES, clean, fold
from kinweave.operators.graph import ready

_STATE = "edges array<struct<id: string, source_entity_id: string, target_entity_id: string, predicate: string, valid_at: timestamp, invalid_at: timestamp, support: array<string>, ordinal: bigint>>"


def apply_facts_stream(facts: DataFrame, policies: DataFrame) -> DataFrame:
    """Edges of every (source, predicate) that new facts touch and change, after those facts.

    The state holds live edges; what a batch closes is emitted once more and leaves it. Nothing else expires: a
    late fact is placed by its valid time, as the planner does, and never dropped; one of unknown time counts from
    the batch's. ``facts``: source_entity_id, target_entity_id, predicate, valid_at, support, ordinal.
    """
    keyed = ready(facts, F.broadcast(policies), None)  # a policy for each predicate

    def run(key, pdfs, state: GroupState):
        rows = [dict(zip(NAMES, e, strict=True)) for e in state.get[0]] if state.exists else []
        for e in rows:
            e["support"] = list(e["support"])
        before = {e["id"]: (e["invalid_at"], list(e["support"])) for e in rows}
        new = pd.concat(pdfs).sort_values("ordinal").to_dict("records")
        for f in new:
            f["support"], f["valid_at"] = list(f["support"]), clean(f["valid_at"])
        out = fold(rows, new, new[0]["cardinality"])
        plain = lambda e: tuple(clean(e[n]) if n in ("valid_at", "invalid_at") else e[n] for n in NAMES)
        moment = lambda v: v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
        state.update(([tuple(map(moment, plain(e))) for e in out if e["invalid_at"] is None],))
        changed = [plain(e) for e in out if before.get(e["id"]) != (e["invalid_at"], e["support"])]
        yield pd.DataFrame(changed, columns=NAMES).astype({"valid_at": "datetime64[ns]", "invalid_at": "datetime64[ns]"})

    return keyed.groupBy("source_entity_id", "predicate").applyInPandasWithState(run, FOLDED, _STATE, "update", GroupStateTimeout.NoTimeout)


_KEY, _VALUE = "target string", "id string, valid_at timestamp, support array<string>, ordinal bigint"


class EdgeState(StatefulProcessor):
    """Live edges of a (source, predicate), each under its own target: a refresh touches one entry, and a closed edge's entry is removed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", _KEY, _VALUE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        facts = pd.concat(rows).sort_values(["ordinal", "id"]).to_dict("records")
        exclusive = facts[0]["cardinality"] == "exclusive_per_source"
        name = lambda target: ("null" if target is None else f"={target}",)
        here: dict = {}  # entries as they are now, None for those that are gone or never were
        before, whole, closed = set(), False, []

        def entry(k, value):
            before.add(k)
            return {"id": value[0], "valid_at": clean(value[1]), "support": dict.fromkeys(value[2]), "ordinal": value[3], "invalid_at": None, "touched": False}

        for f in facts:
            k = name(f["target_entity_id"])
            if k not in here:
                here[k] = entry(k, self.live.getValue(k)) if not whole and self.live.containsKey(k) else None
            if here[k] is not None:
                here[k]["support"].update(dict.fromkeys(f["support"]))
                here[k]["touched"] = True
                continue
            valid = clean(f["valid_at"])
            begins = valid if valid is not None else f["now"]
            if exclusive:
                if not whole:
                    for other, value in self.live.iterator():
                        if tuple(other) not in here:
                            here[tuple(other)] = entry(tuple(other), value)
                    whole = True
                for other, e in here.items():
                    if e is not None and (e["valid_at"] is None or e["valid_at"] <= begins):
                        closed.append((other, e | {"invalid_at": begins}))
                        here[other] = None
            here[k] = {"id": f["id"], "valid_at": valid, "support": dict.fromkeys(f["support"]), "ordinal": f["ordinal"], "invalid_at": None, "touched": True}
        for k, e in here.items():
            if e is None and k in before:
                self.live.removeKey(k)
            elif e is not None and e["touched"]:
                moment = e["valid_at"].to_pydatetime() if isinstance(e["valid_at"], pd.Timestamp) else e["valid_at"]
                self.live.updateValue(k, (e["id"], moment, list(e["support"]), int(e["ordinal"])))
        out = closed + [(k, e) for k, e in here.items() if e is not None and e["touched"]]
        shape = lambda k, e: (e["id"], key[0], None if k[0] == "null" else k[0][1:], key[1], e["valid_at"], e["invalid_at"], list(e["support"]), e["ordinal"])
        yield pd.DataFrame([shape(k, e) for k, e in out], columns=NAMES).astype({"valid_at": "datetime64[ns]", "invalid_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def apply_facts_by_edge(facts: DataFrame, policies: DataFrame) -> DataFrame:
    """As ``apply_facts_stream``, with an entry of state for each live edge in place of a row for each (source, predicate).

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which keeps entries on disk.
    """
    keyed = ready(facts, policies, None)
    return keyed.groupBy("source_entity_id", "predicate").transformWithStateInPandas(EdgeState(), FOLDED, "update", "none")


def latest_state(changes: DataFrame, key: str = "user_id", order: str = "ts", value: str = "event_type") -> DataFrame:
    """The newest value of every key, for tables and streams: a running aggregation without expiry."""
    return changes.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value), F.max(order).alias(order))


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by time window and type; on a stream, windows close ``lateness`` behind the newest time."""
    marked = events.withWatermark("ts", lateness) if events.isStreaming else events
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    return marked.groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour", key: str = "user_id", time: str = "ts") -> DataFrame:
    """(key, starts, ends, n) of every session: events of a key that lie less than ``gap`` apart. On a stream a session is emitted once the
    newest time is ``lateness`` past its end; events later than that are dropped and counted (``late_rows``). Events without a time belong to none."""
    marked = events.where(F.col(time).isNotNull())
    marked = marked.withWatermark(time, lateness) if events.isStreaming else marked
    found = marked.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), "n")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators have dropped for coming too late, as far as its progress is kept."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
