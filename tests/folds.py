"""Literal record-by-record folds that the tests compare the library with."""

import json


def fold_scans(scans):
    """``scans`` is a list of (time, {topic: [partition]}, {topic: {partition: (latest, earliest)}}).

    Returns {topic: (last_update, {partition: (offset, timestamp, is_empty, scanned_at, count)})}.
    """
    state = {}
    for time, listed, answers in scans:
        for topic in list(state):
            if topic not in listed:
                del state[topic]
        for topic, offsets in answers.items():
            _, partitions = state.setdefault(topic, (0, {}))
            for partition, (latest, earliest) in offsets.items():
                if latest is None:
                    continue
                earliest = earliest or 0
                before = partitions.get(partition)
                moved = before is None or before[1] == 0 or latest > before[0]
                partitions[partition] = (latest, time if moved else before[1], latest == earliest, time,
                                         max(latest - earliest, 0))
            state[topic] = (time, partitions)
    return state


def is_valid(value):
    try:
        body = json.loads(value)
    except ValueError:
        return False
    return isinstance(body, dict)


def _partitions(value):
    return {
        int(k): (p.get("offset", 0), p.get("timestamp", 0), p.get("is_empty", False), p.get("scanned_at", 0),
                 p.get("message_count", 0))
        for k, p in (json.loads(value).get("partitions") or {}).items()
    }


def replay(records):
    """Records are (key, value) in arrival order; the last valid one of a key replaces."""
    topics = {}
    for key, value in records:
        if value is None:
            topics.pop(key, None)
        elif is_valid(value):
            topics[key] = _partitions(value)
    return topics


def merge(records):
    """Per partition the higher scanned_at wins and a tie goes to the later record."""
    topics = {}
    for key, value in records:
        if value is None:
            topics.pop(key, None)
        elif is_valid(value):
            held = topics.get(key, (0, {}))[1]
            for partition, fields in _partitions(value).items():
                if partition not in held or fields[3] >= held[partition][3]:
                    held[partition] = fields
            topics[key] = (json.loads(value).get("timestamp", 0), held)
    return topics


def of_state(frame, with_update=False):
    """A state frame as the nested dictionaries of the folds above."""
    topics, updates = {}, {}
    for row in frame.collect():
        held = topics.setdefault(row["topic"], {})
        updates[row["topic"]] = max(updates.get(row["topic"], 0), row["last_update"] or 0)
        if row["partition"] is not None:
            assert row["partition"] not in held, "duplicate row"
            held[row["partition"]] = (row["offset"], row["timestamp"], row["is_empty"], row["scanned_at"],
                                      row["message_count"])
    return {t: (updates[t], p) for t, p in topics.items()} if with_update else topics
