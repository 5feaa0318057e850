"""Progress events folded into one state row per run, in batch and as a stream.

Events are rows (run, seq, kind, files, n, m, elapsed, note): ``files``, ``n`` and ``m``
are the kind's counts, ``elapsed`` its seconds, ``note`` a text. Within a run events
count in order of seq.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "run string, seq long, kind string, files long, n long, m long, elapsed double, note string"
#: The state of a run: counts (null until they are known), elapsed seconds, flags.
COUNTS = ("files_found", "entries_walked", "files_analyzed", "commits_processed", "file_changes", "records_stored")
PLANNED = ("files_total", "commits_total", "chunks_total", "records_planned")
TIMES = ("walk_time", "analysis_time", "history_time", "store_time", "total_time")
FLAGS = ("history_done", "history_skipped", "store_done", "done")
STATE = ", ".join(["run string", *[f"{c} long" for c in (*COUNTS, *PLANNED)], *[f"{c} double" for c in TIMES], *[f"{c} boolean" for c in FLAGS], "index_action string", "last_seq long", "restarts long"])
_FIELDS = tuple(c.split()[0] for c in STATE.split(", "))[1:]

# Where the time of an event goes besides the total.
_TIME_OF = {
    "walk_progress": "walk_time", "walk_done": "walk_time", "file_analyzed": "analysis_time", "chunk_done": "history_time", "chunk_failed": "history_time",
    "history_done": "history_time", "batch_stored": "store_time", "store_done": "store_time", "files_counted": None, "scan_done": None,
}


def empty() -> dict:
    return dict.fromkeys(COUNTS, 0) | dict.fromkeys(PLANNED) | dict.fromkeys(TIMES, 0.0) | dict.fromkeys(FLAGS, False) | {"index_action": None, "last_seq": 0, "restarts": 0}


def _found(s: dict, e: dict) -> None:
    s["files_found"], s["entries_walked"] = e["files"], e["n"]


def _total(s: dict, e: dict) -> None:
    s["files_total"] = e["files"]
    _plan(s, {"n": 2 * e["files"]})  # a record of the file and one of its analysis


def _plan(s: dict, e: dict) -> None:
    s["records_planned"] = max(s["records_planned"] or 0, e["n"])


def _history_planned(s: dict, e: dict) -> None:
    s["commits_total"], s["chunks_total"] = e["n"], e["m"]
    s["history_done"] = s["history_done"] or e["n"] == 0


def _skipped(s: dict, e: dict) -> None:
    if s["index_action"] != "reused":
        s["commits_total"] = s["chunks_total"] = 0
        s["history_skipped"] = True
    s["commits_processed"], s["history_done"] = 0, True


def _chunk(s: dict, e: dict) -> None:
    s["commits_processed"] += e["n"]
    s["file_changes"] += e["m"]


def _history_end(s: dict, e: dict) -> None:
    """What was processed settles what there was, unless a stored index stands for the rest."""
    s["commits_processed"] = max(s["commits_processed"], e["n"])
    if s["index_action"] != "reused" and s["commits_total"] is not None:
        s["commits_total"] = s["commits_processed"]
    s["history_done"] = True


def _stored(s: dict, e: dict) -> None:
    s["records_stored"] = max(s["records_stored"], e["n"])


def _scan_end(s: dict, e: dict) -> None:
    s["files_total"] = s["files_found"] = e["files"]
    s["files_analyzed"] = e["m"]
    _history_end(s, e)
    s["store_done"] = s["done"] = True


#: What each of the 17 kinds does to the state; "scan_started" empties it before.
KINDS: dict[str, Callable[[dict, dict], None]] = {
    "scan_started": lambda s, e: None,
    "walk_progress": _found,
    "file_found": lambda s, e: s.update(files_found=s["files_found"] + 1),
    "files_counted": _total,
    "walk_done": lambda s, e: (_found(s, e), _total(s, e))[0],
    "file_analyzed": lambda s, e: s.update(files_analyzed=max(s["files_analyzed"], e["files"])),
    "history_planning": lambda s, e: s.update(history_done=False, history_skipped=False),
    "history_planned": _history_planned,
    "history_status": lambda s, e: s.update(index_action=e["note"]),
    "history_skipped": _skipped,
    "chunk_done": _chunk,
    "chunk_failed": lambda s, e: None,
    "history_done": _history_end,
    "records_planned": _plan,
    "batch_stored": _stored,
    "store_done": lambda s, e: (_stored(s, e), s.update(store_done=True))[0],
    "scan_done": _scan_end,
}


def fold(state: dict, event: dict) -> dict:
    """The state after one event; kinds that are not known only move ``last_seq``."""
    kind = event["kind"]
    if kind == "scan_started":
        state = empty() | {"restarts": state["restarts"] + 1, "last_seq": state["last_seq"]}
    if kind in KINDS:
        KINDS[kind](state, event)
    if kind in _TIME_OF:
        own, spent = _TIME_OF[kind], event["elapsed"]
        if own == "walk_time":
            state[own] = spent  # a walk tells its whole time
        elif own:
            state[own] = max(state[own], spent)
        state["total_time"] = max(state["total_time"], spent)
    state["last_seq"] = max(state["last_seq"], event["seq"])
    return state


def _plain(e) -> dict:
    """An event with plain numbers; missing counts and times are 0."""
    number = lambda x, kind: kind(0) if x is None or x != x else kind(x)
    return {"kind": e.kind, "seq": int(e.seq), "note": e.note if isinstance(e.note, str) else None, "elapsed": number(e.elapsed, float)} | {c: number(getattr(e, c), int) for c in ("files", "n", "m")}


def _row(run: str, state: dict) -> dict:
    return {"run": run} | {f: state[f] for f in _FIELDS}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["run", *_FIELDS]).astype(dict.fromkeys(PLANNED, "Int64"))


def fold_batch(events: DataFrame) -> DataFrame:
    """(run, seq, kind, ...) -> final states.

    A run's events come to one task in order and are folded as they stream by, so memory
    holds one state and one Arrow batch however many events a run has.
    """
    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state = None, empty()
        for batch in batches:
            done = []
            for e in batch.itertuples():
                if e.run != run:
                    done += [_row(run, state)] if run is not None else []
                    run, state = e.run, empty()
                state = fold(state, _plain(e))
            yield _frame(done)
        if run is not None:
            yield _frame([_row(run, state)])

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.where("run IS NOT NULL").repartition(parts, "run").sortWithinPartitions("run", "seq").mapInPandas(folded, STATE)


def _step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = dict(zip(_FIELDS, state.get)) if state.exists else empty()
    for batch in batches:
        for e in batch.sort_values("seq").itertuples():
            now = fold(now, _plain(e))
    state.update(tuple(now[f] for f in _FIELDS))
    yield _frame([_row(key[0], now)])


def fold_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream, its state kept per run; in update mode."""
    return events.groupBy("run").applyInPandasWithState(_step, STATE, STATE.removeprefix("run string, "), "update", "NoTimeout")


def observed(report: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that tells a reporter each run's newest state, one row per run and batch."""
    def tell(batch: DataFrame, epoch: int) -> None:
        for row in batch.toLocalIterator():
            report(row.asDict())

    return tell
