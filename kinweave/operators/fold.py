"""The ordered fold of facts into edges, of a (source, predicate) as a whole or piece by piece.

A fact either refreshes the live edge with its target, or closes the live edges that don't begin after it and becomes one.
What a fact does so depends on all facts before; but all that later ones need to know of them are the live edges. A key
with many facts is therefore dealt into pieces along its order. To find the live edges at every piece's start, facts that
repeat the target just before them are left out (they refresh, whatever came before), what remains is dealt into wide
pieces, and all wide pieces are folded at once from an assumed start, at first without live edges. A piece whose
predecessor ends otherwise than assumed is folded again from there, until all agree; as a rule a piece soon closes what
it was given, so that this takes two or three rounds. The result is the one of the fold in order, whatever the facts are.
"""

from __future__ import annotations

import hashlib
from collections import deque
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.sources.shared import cut

FOLDED = "id string, source_entity_id string, target_entity_id string, predicate string, valid_at timestamp, invalid_at timestamp, support array<string>, ordinal long"
NAMES = [c.split()[0] for c in FOLDED.split(", ")]
#: Facts that one task folds at once; keys with more are dealt into pieces of about so many.
PIECE = 50_000
_STATE = "wide int, after int, pos int, id string, target_entity_id string, valid_at timestamp"


def clean(value):
    """None for what pandas takes for missing."""
    return None if value is pd.NaT or value is None or (isinstance(value, float) and value != value) else value


class Live:
    """Live edges of one (source, predicate): found by target, closed by start, both without looking at the others."""

    def __init__(self, edges=()):
        self._targets: dict = {}
        self._starts: list = []
        self._count = 0
        for e in edges:
            self.add(e)

    def add(self, edge: dict) -> None:
        self._targets.setdefault(edge["target_entity_id"], deque()).append(edge)
        heappush(self._starts, (edge["valid_at"] is not None, edge["valid_at"], self._count, edge))
        self._count += 1

    def with_target(self, target) -> dict | None:
        """The first that came."""
        waiting = self._targets.get(target, ())
        while waiting and waiting[0]["invalid_at"] is not None:
            waiting.popleft()
        return waiting[0] if waiting else None

    def close(self, begins) -> None:
        """All that begin by then or at an unknown time."""
        while self._starts and (not self._starts[0][0] or self._starts[0][1] <= begins):
            heappop(self._starts)[3]["invalid_at"] = begins

    def edges(self) -> list[dict]:
        return [e for *_, e in sorted(self._starts, key=lambda x: x[2]) if e["invalid_at"] is None]


def meet(live: Live, fact: dict, exclusive: bool) -> bool:
    """One fact after those before it: whether it is a new edge. One of unknown time closes what is live at its ``now``."""
    same = live.with_target(fact["target_entity_id"])
    if same is not None:
        same["support"] = dict.fromkeys(same["support"])
        same["support"].update(dict.fromkeys(fact["support"]))
        same["refreshed"] = True
        return False
    if exclusive:
        live.close(fact["valid_at"] if fact["valid_at"] is not None else fact["now"])
    fact |= {"invalid_at": None, "support": dict.fromkeys(fact["support"])}
    live.add(fact)
    return True


def fold(rows: list[dict], facts: list[dict], cardinality: str) -> list[dict]:
    """Edges of one (source, predicate) after its facts, each of which sees what came before."""
    live = Live(e for e in rows if e["invalid_at"] is None)
    rows += [f for f in facts if meet(live, f, cardinality == "exclusive_per_source")]
    for e in rows:
        e["support"] = list(e["support"])
    return rows


def _records(pdf: pd.DataFrame, order: str | None = None) -> list[dict]:
    times = ("valid_at", "invalid_at", "now")
    rows = pdf if order is None else pdf.sort_values(order, kind="stable")
    return [{k: clean(v) if k in times else v for k, v in r.items()} | {"support": list(r["support"])} for r in rows.to_dict("records")]


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([{n: e[n] for n in names} for e in rows], columns=names).astype({c: "datetime64[ns]" for c in ("valid_at", "invalid_at") if c in names})


def _key(row: dict) -> tuple:
    return clean(row["source_entity_id"]), clean(row["predicate"])


def _start(state: pd.DataFrame) -> list[dict]:
    """The live edges that a piece starts with."""
    return [{**e, "valid_at": clean(e["valid_at"]), "invalid_at": None, "support": {}, "refreshed": False} for e in state.sort_values("pos").to_dict("records")]


def _walk(rows: list[dict], start: list[dict], at_end=None):
    """Fold rows in order; rows that are edges already come before the facts of their key. Gives the edges of all keys."""
    out, live, key = [], None, None
    for k, row in enumerate(rows):
        if live is None or _key(row) != key:
            live, key = Live(start if k == 0 else ()), _key(row)
        if row["old"]:
            out.append(row)
            if row["invalid_at"] is None:
                live.add(row)
        elif meet(live, row, True):
            out.append(row)
        if at_end is not None and (k + 1 == len(rows) or rows[k + 1]["piece"] != row["piece"]):
            at_end(row["piece"], live)
    return out


def _states(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """The live edges at the end of every piece of a wide one, after a row with their digest in place of an id."""
    out = []

    def at_end(piece, live):
        edges = live.edges()
        told = repr([(e["id"], e["target_entity_id"], str(e["valid_at"])) for e in edges])
        out.append({"after": piece, "pos": -1, "id": hashlib.sha256(told.encode()).hexdigest() if edges else "", "target_entity_id": None, "valid_at": None})
        out.extend({"after": piece, "pos": k, "id": e["id"], "target_entity_id": e["target_entity_id"], "valid_at": e["valid_at"]} for k, e in enumerate(edges))

    rows = _records(pdf, "seq")
    _walk(rows, _start(state), at_end)
    for r in out:
        r["wide"] = rows[0]["wide"]
    return _frame(out, ["wide", "after", "pos", "id", "target_entity_id", "valid_at"])


def _folded(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """The edges of a piece, and what it changes of those that it starts with."""
    start = _start(state)
    edges = _walk(_records(pdf, "seq"), start) if len(pdf) else []
    changed = [e for e in start if e["refreshed"] or e["invalid_at"] is not None]
    piece = pdf["piece"].iloc[0] if len(pdf) else -1
    out = [{**e, "support": list(e["support"]), "piece": piece, "patch": False, "refreshed": False} for e in edges]
    out += [{**dict.fromkeys(NAMES), **e, "support": list(e["support"]), "piece": piece, "patch": True} for e in changed]
    return _frame(out, [*NAMES, "piece", "patch", "refreshed"]).astype({"ordinal": "Int64"})


def fold_whole(rows: DataFrame) -> DataFrame:
    """Edges of (source, predicate)s that one task each can fold; ``rows``: facts and, with ``old``, edges that were there."""

    def run(batches):
        live, key, edges, done = None, None, [], []
        for pdf in batches:
            for row in _records(pdf):
                if live is None or _key(row) != key:
                    done += edges
                    live, key, edges = Live(), _key(row), []
                if row["old"]:
                    edges.append(row)
                    if row["invalid_at"] is None:
                        live.add(row)
                elif meet(live, row, True):
                    edges.append(row)
            if done:
                yield _frame([{**e, "support": list(e["support"])} for e in done], NAMES)
                done = []
        if edges:
            yield _frame([{**e, "support": list(e["support"])} for e in edges], NAMES)

    dealt = rows.repartition("source_entity_id", "predicate").sortWithinPartitions("source_entity_id", "predicate", F.col("old").desc(), "ordinal", "id")
    return dealt.mapInPandas(run, FOLDED)


def fold_pieces(rows: DataFrame, total: int, piece: int = PIECE) -> DataFrame:
    """The same for keys of any size, their ``total`` of rows dealt into pieces of up to ``piece``. Tasks that only read rows take several
    pieces, so that small pieces don't make as many tasks."""
    by = [F.col("source_entity_id"), F.col("predicate"), F.col("old").desc(), F.col("ordinal"), F.col("id")]
    dealt = rows.repartitionByRange(-(-total // max(piece, PIECE)), *by).sortWithinPartitions(*by)
    dealt = cut(dealt.withColumn("seq", F.monotonically_increasing_id()))  # the task, then 33 bits of the row's place in it
    place = F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("piece", (F.shiftright("seq", 33) * F.lit(1 << 16) + F.floor(place / F.lit(piece))).cast("int"))
    before = Window.partitionBy("piece", "source_entity_id", "predicate").orderBy("seq")  # a piece is bounded
    again = (F.lag("target_entity_id").over(before) == F.col("target_entity_id")) & ~F.lag("old").over(before)
    brief = cut(dealt.withColumn("again", F.coalesce(again, F.lit(False))).where("not again").drop("again").withColumn("support", F.array().cast("array<string>")))
    ends = brief.groupBy("piece").agg(F.count("*").alias("n"), F.min(F.struct("source_entity_id", "predicate")).alias("first"), F.max(F.struct("source_entity_id", "predicate")).alias("last")).orderBy("piece").collect()  # a row for each piece
    wide_of, joined, size = {}, [], 0
    for k, r in enumerate(ends):
        fits = k > 0 and size + r["n"] <= piece
        wide_of[r["piece"]] = wide_of[ends[k - 1]["piece"]] + (0 if fits else 1) if k else 0
        size = size + r["n"] if fits else r["n"]
        if k and tuple(ends[k - 1]["last"]) == tuple(r["first"]):
            joined.append((ends[k - 1]["piece"], r["piece"]))
    spark = rows.sparkSession
    brief = brief.join(spark.createDataFrame(list(wide_of.items()), "piece int, wide int"), "piece")
    states = _agreed(brief, wide_of, joined)
    starts = states.where("pos >= 0").join(spark.createDataFrame(joined, "after int, piece int"), "after").select("piece", "pos", "id", "target_entity_id", "valid_at")
    out = cut(dealt.groupBy("piece").cogroup(starts.groupBy("piece")).applyInPandas(lambda p, s: _folded(p, s), f"{FOLDED}, piece int, patch boolean, refreshed boolean"))
    lent = F.transform(F.array_sort(F.collect_list(F.when(F.col("refreshed"), F.struct("piece", "support")))), lambda x: x["support"])
    patches = out.where("patch").groupBy("id").agg(F.min("invalid_at").alias("ends"), lent.alias("lent"))
    edges = out.where("not patch").join(patches, "id", "left")
    support = F.when(F.size("lent") > 0, F.array_distinct(F.concat("support", F.flatten("lent")))).otherwise(F.col("support"))
    return edges.withColumns({"invalid_at": F.coalesce("invalid_at", "ends"), "support": support}).select(*NAMES)


def _agreed(brief: DataFrame, wide_of: dict[int, int], joined: list[tuple[int, int]]) -> DataFrame:
    """The states at the ends of all pieces, once every wide piece was folded from where the one before it ends."""
    spark = brief.sparkSession
    crossing = {wide_of[b]: a for a, b in joined if wide_of[a] != wide_of[b]}  # wide piece -> the piece that it goes on from
    states = spark.createDataFrame([], _STATE)
    ended: dict[int, str] = {}  # by the last piece of each wide one
    assumed: dict[int, str | None] = dict.fromkeys(wide_of.values())
    while True:
        known = {w: ended.get(crossing[w], "") if w in crossing else "" for w in assumed}
        todo = [w for w in assumed if assumed[w] != known[w]]
        if not todo:
            return states
        given = spark.createDataFrame([(crossing[w], w) for w in todo if w in crossing], "after int, start int")
        start = states.where("pos >= 0").join(given, "after").select(F.col("start").alias("wide"), "pos", "id", "target_entity_id", "valid_at")
        new = brief.where(F.col("wide").isin(todo)).groupBy("wide").cogroup(start.groupBy("wide")).applyInPandas(lambda p, s: _states(p, s), _STATE)
        states = cut(states.where(~F.col("wide").isin(todo)).unionByName(new))
        ended |= {r["after"]: r["id"] for r in states.where((F.col("pos") == -1) & F.col("after").isin(list(crossing.values()))).select("after", "id").collect()} if crossing else {}
        assumed |= {w: known[w] for w in todo}


def fold_facts(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Edges after the facts of exclusive predicates: keys of up to ``piece`` rows by a task each, others piece by piece."""
    key = ("source_entity_id", "predicate")
    rows = cut(rows)
    large = cut(rows.groupBy(*key).count().where(F.col("count") > piece))
    total = large.agg(F.sum("count")).first()[0]
    if not total:
        return fold_whole(rows)
    mark = large.select(*(F.col(c).alias(f"__{c}") for c in key), F.lit(True).alias("__large"))
    marked = rows.join(mark, F.col(key[0]).eqNullSafe(F.col(f"__{key[0]}")) & F.col(key[1]).eqNullSafe(F.col(f"__{key[1]}")), "left")
    drop = [f"__{c}" for c in key] + ["__large"]
    return fold_whole(marked.where("__large is null").drop(*drop)).unionByName(fold_pieces(marked.where("__large").drop(*drop), total, piece))
