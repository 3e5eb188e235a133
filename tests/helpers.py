import random
from datetime import datetime, timedelta

from pyspark.sql import types as T

from tocsin.operators.hot import Limits
from tocsin.operators.routing import route_events
from tocsin.schemas import MANAGER, RULE

T0 = datetime(2024, 1, 1)
TINY = Limits(hot_rows=6, slot_rows=2)

EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("received_at", T.TimestampNTZType()),
        *[
            T.StructField(n, T.StringType())
            for n in ("event_manager_id", "summary", "severity", "action", "class", "dedup_key")
        ],
    ]
)

# rule id -> (grouping key, minutes); manager id -> rule id
RULES = {"rule-1": ("class", 5), "rule-2": ("region", 1), "rule-3": ("severity", 3)}
MANAGERS = {"em-1": "rule-1", "em-2": "rule-2", "em-3": "rule-3"}


def event(seq, minutes, key, action="trigger", cls="database", manager="em-1", severity="high", micros=0):
    return {
        "seq": seq,
        "received_at": T0 + timedelta(minutes=minutes, microseconds=micros),
        "event_manager_id": manager,
        "summary": f"s{seq}",
        "severity": severity,
        "action": action,
        "class": cls,
        "dedup_key": key,
    }


def frame(spark, events, schema=EVENT):
    rows = [tuple(e[f.name] for f in schema.fields) for e in events]
    return spark.createDataFrame(rows, schema)


def config(spark, managers=MANAGERS, rules=RULES):
    m = [(k, k, "", r, (f"https://hooks.example/{k}",), T0, T0) for k, r in managers.items()]
    r = [(k, k, key, minutes, T0, T0) for k, (key, minutes) in rules.items()]
    return spark.createDataFrame(m, MANAGER), spark.createDataFrame(r, RULE)


def routed(spark, events):
    return route_events(frame(spark, events), *config(spark))[0]


def random_log(seed, size, keys=12, hot=0.4, step=0.5):
    """A log with tied times, exact window ends, keys shared by managers and hot keys."""
    rng = random.Random(seed)
    at, log = 0.0, []
    for seq in range(size):
        at += rng.choice([0, 0, step, 1, 2.5])
        key = "hot" if rng.random() < hot / 2 else f"k{rng.randrange(keys)}"
        log.append(
            event(
                seq,
                at,
                key,
                action=rng.choice(["trigger", "resolve"]),
                cls=rng.choice(["a", "a", "a", "b"]),
                manager=rng.choice(["em-1", "em-1", "em-1", "em-2", "em-3"]),
                severity=rng.choice(["high", "low"]),
            )
        )
    rng.shuffle(log)
    return log
