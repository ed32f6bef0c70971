"""Builders of events around a fixed clock."""

NOW = 1_779_562_429_123
EVENTS = "ord long, received_ms long, device_id string, room_id string, type string, t_ms long, seq long, in_room boolean, magnitude double, state string, confidence double, rssi double, tier int"


def event(ord_, kind, t_ms, device="dev_1", room="room_1", seq=None, in_room=None, confidence=None):
    return (ord_, NOW, device, room, kind, t_ms, seq, in_room, None, None, confidence, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def presence(spark, points):
    """points: (offset from NOW in ms, in_room) in order of arrival."""
    return frame(spark, [event(i, "presence", NOW + t, in_room=v) for i, (t, v) in enumerate(points)])


def falls(spark, points):
    """points: (offset, seq) or (offset, seq, device) in order of arrival."""
    return frame(spark, [event(i, "fall_warn", NOW + p[0], device=p[2] if len(p) > 2 else "dev_1", seq=p[1], confidence=0.5 + i / 100) for i, p in enumerate(points)])


def fold(points, window, slack):
    """Plain version of the fold: a list of alarms as dicts, in order of creation."""
    alarms = []
    for i, p in enumerate(points):
        t, q, device = p[0], p[1], p[2] if len(p) > 2 else "dev_1"
        for a in alarms:
            if a["device"] != device or abs(t - a["ts"]) > window:
                continue
            if slack is not None and q is not None and a["q0"] is not None and not a["q0"] - slack <= q <= a["q1"] + slack:
                continue
            a["ts"], a["dups"] = min(a["ts"], t), a["dups"] + 1
            if q is not None:
                a["q0"], a["q1"] = (q, q) if a["q0"] is None else (min(a["q0"], q), max(a["q1"], q))
            break
        else:
            alarms.append({"device": device, "ts": t, "t0": t, "dups": 0, "q0": q, "q1": q, "ord": i})
    return alarms
