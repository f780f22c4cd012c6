"""Rules with state, one key at a time: step(state, event) gives (state, output rows). State is a plain dict, empty at first.

The same steps run over a sorted log (replay.py) and in a stream (live.py). Times are milliseconds.
"""

from __future__ import annotations

from lumaframe import schemas as S

# Windows and limits of the rules.
LOGIN_WINDOW, LOGIN_FAILURES = 15 * 60_000, 5
LOCK_WINDOW, LOCK_FAILURES = 30_000, 5
NAME_THROTTLE = 300_000
HOUR, DAY = 3_600_000, 86_400_000
USES_DEFAULT, USES_MOST, HOURS_MOST, DAYS_MOST = 10, 1000, 720, 30


def login(state: dict, e) -> tuple[dict, list]:
    """e: ts_ms, ok. Five failures within 15 minutes of the first block until those minutes are over; blocked tries do not count."""
    n, first = state.get("n", 0), state.get("first", 0)
    if n and e.ts_ms - first > LOGIN_WINDOW:
        n = 0
    if n >= LOGIN_FAILURES:
        return {"n": n, "first": first}, [("blocked",)]
    if e.ok:
        return {}, [("ok",)]
    return {"n": n + 1, "first": first if n else e.ts_ms}, [("failed",)]


def download(state: dict, e) -> tuple[dict, list]:
    """e: ts_ms, ok. The fifth failure in a row locks for 30 seconds, in which even a right password is refused."""
    if e.ts_ms < state.get("until", 0):
        return state, [("locked",)]
    if e.ok:
        return {}, [("ok",)]
    n = state.get("n", 0) + 1
    return ({"until": e.ts_ms + LOCK_WINDOW}, [("lock",)]) if n >= LOCK_FAILURES else ({"n": n}, [("failed",)])


def throttle(state: dict, e) -> tuple[dict, list]:
    """e: ts_ms. At most one record in 300 seconds, counted from the last one taken."""
    last = state.get("last")
    taken = last is None or e.ts_ms - last >= NAME_THROTTLE
    return {"last": e.ts_ms} if taken else state, [("taken" if taken else "dropped",)]


def quota(mode: str, value: int) -> tuple[int, int]:
    """(uses, life in ms) of a token; 0 uses is no limit. Other modes get the default uses."""
    if mode == "hour":
        return 0, HOUR * min(max(value, 1), HOURS_MOST)
    if mode == "day":
        return 0, DAY * min(max(value, 1), DAYS_MOST)
    return (min(max(value, 1), USES_MOST) if mode == "use" else USES_DEFAULT), DAYS_MOST * DAY


def redeem(state: dict, e) -> tuple[dict, list]:
    """e: ts_ms, op ('issue' or 'redeem'), mode, value. Redemptions count until the uses or the life run out; unknown tokens are refused."""
    if e.op == "issue":
        uses, life = quota(e.mode, int(e.value))
        return {"uses": uses, "until": e.ts_ms + life, "used": 0}, [("issued",)]
    if not state or e.ts_ms > state["until"] or (state["uses"] and state["used"] >= state["uses"]):
        return {}, [("refused",)]
    return state | {"used": state["used"] + 1}, [("counted",)]


def claim(state: dict, e) -> tuple[dict, list]:
    """e: ts_ms, user_name, op (claim, release, force, activity); key is the folder. Returns (outcome, holder).

    The first holds; the same user renews by claiming or by activity; release needs the holder or no name; force needs
    more than 30 idle minutes. Nothing expires by itself.
    """
    holder, at = state.get("holder"), state.get("at", 0)
    if e.op == "claim":
        if holder is None or holder == e.user_name:
            return {"holder": e.user_name, "at": e.ts_ms}, [("claimed" if holder is None else "renewed", e.user_name)]
        return state, [("refused", holder)]
    if e.op == "activity":
        return ({"holder": holder, "at": e.ts_ms}, [("renewed", holder)]) if holder == e.user_name and holder else (state, [])
    if e.op == "release":
        return ({}, [("released", holder)]) if holder is not None and e.user_name in (holder, "") else (state, [("kept", holder)])
    if e.op == "force":
        return ({}, [("released", holder)]) if holder is not None and at < e.ts_ms - S.STALE_MS else (state, [("kept", holder)])
    return state, []


def lock(state: dict, e) -> tuple[dict, list]:
    """e: ts_ms, user_name, op (claim, release or mark), file_id, decision; key is the folder. Returns each mark and whether it is allowed.

    Claims and marks of a folder share a key, so the lock is checked in the order of events; the state is who holds it.
    """
    holder = state.get("holder")
    if e.op == "claim":
        return {"holder": holder or e.user_name}, []
    if e.op == "release":
        return {"holder": None if holder == e.user_name else holder}, []
    return state, [(e.file_id, e.decision, e.user_name, holder is None or holder == e.user_name)]


def changed_section(state: dict, e) -> tuple[dict, list]:
    """e: json; key is the section. Passes on what differs from the last that was passed on."""
    return ({"json": e.json}, [(e.json,)]) if state.get("json") != e.json else (state, [])


#: rule -> (step, output columns)
RULES = {
    "login": (login, "outcome string"),
    "download": (download, "outcome string"),
    "throttle": (throttle, "outcome string"),
    "redeem": (redeem, "outcome string"),
    "claim": (claim, "outcome string, holder string"),
    "lock": (lock, "file_id long, decision int, user_name string, allowed boolean"),
    "section": (changed_section, "json string"),
}

#: rule -> the fields of its state
STATES = {
    "login": "n int, first long",
    "download": "n int, until long",
    "throttle": "last long",
    "redeem": "uses int, until long, used int",
    "claim": "holder string, at long",
    "lock": "holder string",
    "section": "json string",
}

#: rule -> from when on its state tells no more than an empty one; rules that never forget are missing, and None is never
ENDS = {
    "login": lambda s: s["first"] + LOGIN_WINDOW + 1,
    "download": lambda s: s.get("until"),
    "throttle": lambda s: s["last"] + NAME_THROTTLE,
    "redeem": lambda s: s["until"] + 1,
}
