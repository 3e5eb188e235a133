"""A plain sequential model of the alert rules, used as an oracle in tests.

It keeps whole families in dictionaries and recounts active children at every
step, so it shares nothing with the relational form it checks.
"""

from __future__ import annotations

from datetime import timedelta


def replay(events, managers, rules):
    """(alerts by dedup key, outcome by seq, notifications) for events in log order."""
    alerts, windows, outcome, notes = {}, {}, {}, []

    def active_children(parent):
        return sum(a["parent"] == parent and a["status"] == "active" for a in alerts.values())

    def close(alert, at):
        alert.update(status="resolved", resolved_at=at, updated_at=at, pending=False)

    def note(alert, at):
        notes.append((alert["key"], alert["status"], alert["child_count"], at))

    for e in sorted(events, key=lambda e: (e["received_at"], e["seq"])):
        at, key = e["received_at"], e["dedup_key"]
        rule = rules[managers[e["event_manager_id"]]]
        alert = alerts.get(key)
        if alert is None and e["action"] == "resolve":
            outcome[e["seq"]] = "resolve_unknown"
            continue
        if alert is None:
            field, minutes = rule
            value = e[field] if field in ("class", "severity", "event_manager_id") else ""
            group = (e["event_manager_id"], field, value)
            parent, until = windows.get(group, (None, None))
            if parent is not None and at > until:
                parent = None
            alerts[key] = alert = dict(
                key=key, parent=parent, status="active", child_count=0, pending=False,
                created_at=at, updated_at=at, resolved_at=None, summary=e["summary"],
                requested_at=None, remaining=None,
            )
            if parent is None:
                windows[group] = (key, at + timedelta(minutes=minutes))
                note(alert, at)
            else:
                alerts[parent]["child_count"] += 1
                alerts[parent]["updated_at"] = at
            outcome[e["seq"]] = "new_child" if parent else "new_parent"
            continue
        resolved = alert["status"] == "resolved"
        if e["action"] == "trigger":
            outcome[e["seq"]] = "reactivated" if resolved else "duplicate"
            if resolved:
                alert.update(status="active", pending=False, resolved_at=None, updated_at=at)
            continue
        if resolved:
            outcome[e["seq"]] = "resolve_noop"
            continue
        if alert["parent"] is not None:
            outcome[e["seq"]] = "child_resolved"
            close(alert, at)
            parent = alerts[alert["parent"]]
            if parent["pending"]:
                parent["remaining"] = active_children(parent["key"])
                if parent["remaining"] == 0:
                    close(parent, at)
                    note(parent, at)
                    outcome[e["seq"]] = "child_resolved+cascade"
            continue
        left = active_children(key)
        if left:
            outcome[e["seq"]] = "resolve_deferred"
            alert.update(pending=True, updated_at=at, requested_at=at, remaining=left)
        else:
            outcome[e["seq"]] = "parent_resolved"
            close(alert, at)
            note(alert, at)
    return alerts, outcome, notes
