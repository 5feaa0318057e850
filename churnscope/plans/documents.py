"""Documents and texts from stored tables, after bounded reads."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import functions as F

from churnscope.operators import risk as R
from churnscope.plans import reports
from churnscope.sources.store import Store

# Public drivers of dominant dimensions, and their labels.
DRIVERS = {"churn": ("churn", "Churn"), "recent_churn": ("churn", "Recent churn"), "complexity_pressure": ("complexity", "Complexity"), "cochange_pressure": ("cochange", "Co-change")}
NO_FILES = "No production Go files were scored because project risk scoring is Go-only"


def reason(reliable: bool, confidence: str, history: str) -> str:
    name = confidence.capitalize()
    if reliable:
        return f"{name} scoring coverage and repository context are available"
    if confidence == "none":
        return NO_FILES
    if confidence == "low":
        return "Scoring coverage is low"
    if history == "absent":
        return f"{name} scoring coverage, but repository context is unavailable"
    return "Assessment reliability is limited by incomplete scoring context"


def sentence(message: str) -> str:
    """First letter in upper case, no closing punctuation."""
    return re.sub(r"[A-Za-z]", lambda m: m[0].upper(), message.strip(), count=1).rstrip(".!?")


def scan_document(store: Store, duration_ms: int) -> dict:
    meta = {r.key: r.value for r in store.read("metadata").collect()}
    project = store.read("project").first()
    status, action, confidence = meta.get("git_index_status", "unavailable"), meta.get("git_index_action", ""), project["confidence"]
    history = "absent" if status != "available" else "incremental" if action in ("reused", "incrementally_updated") else meta.get("git_confidence", "first_parent_only")
    reliable = confidence in ("high", "medium") and history != "absent"
    scores = store.read("scores")
    bands = {r.band: r.files for r in R.band_histogram(scores).collect()}
    driver = DRIVERS.get(project["dominant_dimension"])
    top = reports.hotspots(scores).collect()
    limits = reports.summary_limitations(store.read("project"), store.read("metadata")).orderBy("position").collect()
    total = meta.get("git_commits_total")
    return {
        "schema_version": 1, "scanned_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "assessment": {"is_reliable": reliable, "scoring_confidence": confidence, "reason": reason(reliable, confidence, history)},
        "risk": {
            "score": project["risk_10"] if project["scored_files"] else None, "band": project["band"],
            "primary_driver": {"id": driver[0], "label": driver[1]} if driver and project["scored_files"] else None,
            "files_by_band": {b: bands.get(b, 0) for b in ("extreme", "high", "medium", "low")}},
        "scan": {
            "type": "incremental" if action in ("reused", "incrementally_updated") else "full", "duration_ms": duration_ms,
            "files_detected": int(meta["files_detected"]), "files_analyzed": int(meta["files_analyzed"]), "git_history": history,
            "commits_processed": int(meta.get("git_commits_processed", 0)), "commits_total": int(total) if total is not None else None},
        "top_hotspots": [{"rank": r.position, "path": r.path, "score": r.risk_10, "band": r.band, "reason": r.facts[0] if r.facts else None} for r in top],
        "limitations": [{"code": r.code, "message": sentence(r.message)} for r in limits],
    }


def to_json(document: dict, pretty: bool = False) -> str:
    return json.dumps(document, indent=4, ensure_ascii=False) if pretty else json.dumps(document, separators=(",", ":"), ensure_ascii=False)


def scan_text(d: dict) -> str:
    risk, scan, bands = d["risk"], d["scan"], d["risk"]["files_by_band"]
    lines = [
        "Assessment", f"  Reliable: {str(d['assessment']['is_reliable']).lower()}", f"  Scoring confidence: {d['assessment']['scoring_confidence']}",
        f"  Reason: {d['assessment']['reason']}.", "", "Risk", f"  Score: {'unavailable' if risk['score'] is None else format(risk['score'], '.1f')}",
        f"  Band: {risk['band']}", f"  Primary driver: {risk['primary_driver']['label'] if risk['primary_driver'] else 'none'}",
        "  Files by band: " + "  ".join(f"{b} {bands[b]}" for b in bands), "", "Scan", f"  Type: {scan['type']}",
        f"  Files: {scan['files_analyzed']}/{scan['files_detected']} analyzed", f"  Git history: {scan['git_history']}",
        f"  Commits: {scan['commits_processed']}/{'unknown' if scan['commits_total'] is None else scan['commits_total']}", f"  Duration: {scan['duration_ms']} ms", "", "Top Hotspots"]
    for h in d["top_hotspots"]:
        lines += ["", f"{h['rank']:>2}  {h['path']}", *([f"    {sentence(h['reason'])}"] if h["reason"] else [])]
    lines += ["  none"] * (not d["top_hotspots"]) + ["", "Limitations"] + [f"  - {x['message']}" for x in d["limitations"]]
    return "\n".join(lines + ["  none"] * (not d["limitations"]))


def hotspots_document(store: Store, include_tests: bool = False, top: int | None = 5) -> dict:
    store.require_complete()
    scores = store.read("scores")
    rows = reports.hotspots(scores, include_tests, top).collect()
    confidence = store.read("project").first()["confidence"]
    available = (scores if include_tests else R.production(scores)).count()
    return {"schema_version": 1, "command": "hotspots", "include_tests": include_tests, "available": available, "hotspots": [
        {"rank": r.position, "score": r.score, "path": r.path, "is_test": r.is_test, "tags": r.tags, "drivers": r.facts, "confidence": confidence, "phrase": r.phrase} for r in rows]}


def hotspots_json(d: dict) -> str:
    rows = [{k: v for k, v in h.items() if k != "phrase"} for h in d["hotspots"]]
    return to_json({"schema_version": d["schema_version"], "command": d["command"], "include_tests": d["include_tests"], "hotspots": rows})


def hotspots_text(d: dict, verbose: bool = False) -> str:
    rows = d["hotspots"]
    if not rows:
        return "No scored Go file hotspots found." if d["include_tests"] else "No scored production Go file hotspots found."
    title = "Go hotspots (production + tests)" if d["include_tests"] else "Production Go hotspots"
    lines = [title if verbose else f"{title}  [scoring confidence: {rows[0]['confidence']}]"]
    for h in rows:
        if verbose:
            lines += ["", f"{h['rank']:>2}  {h['score']:.3f}  {h['path']}  [{h['confidence']}]"]
            lines += [f"    {' · '.join(h['tags'])}"] * bool(h["tags"]) + [f"    {x}" for x in h["drivers"]]
        else:
            lines += ["", f"{h['rank']:>2}  {h['path']}"] + [f"    {h['phrase']}"] * bool(h["phrase"])
    left = d["available"] - len(rows)
    return "\n".join(lines + ["", f"+ {left} more  (--top N or --all to see them)"] * (left > 0 and not verbose))


def explain_document(store: Store, path: str) -> dict:
    """Everything stored about one file; LookupError if it isn't indexed."""
    store.require_complete()
    spark = store.spark
    pairs = store.read("pairs") if store.exists("pairs") else spark.createDataFrame([], "left_path string, right_path string, pair_count long")
    row = reports.explain(
        store.read("facts"), store.read("scores"), store.read("owners"), pairs, store.read("references"), store.read("edges"),
        spark.createDataFrame([(path,)], "path string")).first()
    if row is None:
        raise LookupError(f"{path} is not indexed")
    meta = store.read("metadata").where(F.col("key").isin(*reports.GIT_LIMITATIONS)).collect()
    return row.asDict(True) | {"git_limitations": [{"code": reports.GIT_LIMITATIONS[r.key], "message": r.value} for r in meta]}


def explain_text(d: dict) -> str:
    show = lambda v: "none" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    score = d["score"] or {}
    lines = [f"File {d['path']}", f"  Package: {show(d['package'])}", f"  Language: {show(d['language'])}", f"  Lines: {show(d['line_count'])}", "", "Score"]
    if score:
        lines += [f"  Risk: {score['risk_10']:.1f} ({score['band']}), rank {score['rank']}", f"  Tags: {', '.join(score['tags']) or 'none'}"]
    else:
        lines += [f"  unavailable: {', '.join(d['unavailable'] or [])}"]
    lines += ["", "Terms"] + [f"  {t['term']}: raw {show(t['raw_value'])}, normalized {show(t['normalized_value'])}, contribution {show(t['contribution'])}" for t in d["terms"] or []]
    lines += ["", "Facts"] + [f"  {f['message']}" for f in d["score_facts"] or []]
    lines += ["", "History", f"  Commits: {d['commits']}, churn {d['total_churn']}, recent {d['recent_churn']}", "", "Owners"]
    lines += [f"  {o['owner_rank']}. {o['owner']} {o['share']:.1%}" for o in d["owners"] or []]
    lines += ["", "Changed together"] + [f"  {p['partner']} ({p['pair_count']})" for p in d["cochange_partners"] or []]
    lines += ["", "Imports"] + [f"  {r['raw_target']} -> {show(r['resolved_package'])}" for r in d["references"] or []]
    lines += ["", "Imported by"] + [f"  {s['source_path']}" for s in d["inbound"] or []]
    notes = [x["message"] for x in (d["score_limitations"] or []) + d["git_limitations"]]
    return "\n".join(lines + ["", "Limitations"] + [f"  - {sentence(n)}" for n in notes] + ["  none"] * (not notes))
