"""Sessions as a stream: per user a context ring and a bounded personal store, with a suggestion after every commit.

Commits (user_id, tick, kind, token) come in any number of micro-batches; within one they are taken in order of tick.
kind: 'token', 'unknown' (a word that is no token: what follows has no context), 'boundary' (a sentence ends), 'clear' (the
context is forgotten), 'decay' (counts are halved), 'forget' (the store is emptied), 'replace' (token is a snapshot, the
JSON of entries that `snapshot` gives, and takes the store's place). The state is one value per user and bounded: three tokens of
context, HISTORY tokens of history and MAX_ENTRIES entries.

A token that would complete a run of three or four tokens that the history holds already is not suggested.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_ENTRIES, MAX_CONTEXT, MIN_COUNT, HISTORY, RUNS = 4096, 3, 2, 256, (3, 4)
OUT = "user_id long, tick long, context string, suggestions array<string>, contextual array<string>, general array<string>, repeated array<string>"


class Store:
    """A user's personal entries: (context, token) to [count, last seen]."""

    def __init__(self, state: dict | None = None, limit: int = MAX_ENTRIES):
        state = state or {}
        self.context, self.start, self.limit = state.get("context", []), state.get("start", True), limit
        self.history = state.get("history", [])
        self.entries = {(c, t): [n, seen] for c, t, n, seen in state.get("entries", [])}

    def dump(self) -> dict:
        return {"context": self.context, "start": self.start, "history": self.history, "entries": [[c, t, *v] for (c, t), v in sorted(self.entries.items())]}

    def snapshot(self) -> str:
        """The entries alone, as a 'replace' commit takes them."""
        return json.dumps(self.dump()["entries"])

    def repeated(self) -> list[str]:
        """Tokens that would complete a run of three or four which the history holds."""
        out = set()
        for k in RUNS:
            head = self.history[1 - k :]
            if len(head) == k - 1:
                out |= {self.history[i + k - 1] for i in range(len(self.history) - k + 1) if self.history[i : i + k - 1] == head}
        return sorted(out)

    def keys(self) -> list[str]:
        own = [" ".join(self.context[-k:]) for k in range(min(MAX_CONTEXT, len(self.context)), 0, -1)]
        return (["\n"] if self.start else []) + own + [""]

    @staticmethod
    def strength(key, value):
        return value[0], value[1], len(key[0].split()), [-ord(c) for c in key[1]]

    def observe(self, token: str, tick: int) -> None:
        for key in ((c, token) for c in self.keys()):
            if key in self.entries:
                self.entries[key] = [self.entries[key][0] + 1, tick]
            elif len(self.entries) < self.limit:
                self.entries[key] = [1, tick]
            else:
                weakest = min(self.entries, key=lambda k: self.strength(k, self.entries[k]))
                if self.strength(key, [1, tick]) > self.strength(weakest, self.entries[weakest]):
                    del self.entries[weakest]
                    self.entries[key] = [1, tick]

    def commit(self, kind: str, token: str | None, tick: int) -> None:
        if kind == "token" and token:
            self.observe(token, tick)
            self.context, self.start = [*self.context, token][-MAX_CONTEXT:], False
            self.history = [*self.history, token][-HISTORY:]
        elif kind == "unknown":
            self.context, self.start = [], False
        elif kind == "replace":
            rows = sorted(json.loads(token or "[]"), key=lambda x: self.strength((x[0], x[1]), [x[2], x[3]]), reverse=True)
            self.entries = {(c, t): [n, seen] for c, t, n, seen in rows[: self.limit]}
        elif kind in ("boundary", "clear"):
            self.context, self.start = [], True
        elif kind == "decay":
            self.entries = {k: [n // 2, seen] for k, (n, seen) in self.entries.items() if n > 1}
        elif kind == "forget":
            self.entries = {}

    def ranked(self, keys: list[str]) -> list[str]:
        """The tokens of these contexts in turn, by count, last seen, smaller token; a token once, repeats left out."""
        out: dict[str, None] = {}
        for c in keys:
            rows = sorted((-n, -seen, t) for (k, t), (n, seen) in self.entries.items() if k == c and n >= MIN_COUNT)
            out |= dict.fromkeys(t for _, _, t in rows)
        stop = set(self.repeated())
        return [t for t in out if t not in stop]

    def suggest(self, limit: int = 3) -> list[str]:
        """Longer contexts first."""
        return self.ranked(self.keys())[:limit]


def run(commits: DataFrame, limit: int = MAX_ENTRIES, shown: int = 3) -> DataFrame:
    """A streaming DataFrame of commits to one of suggestions, a row per commit."""

    def step(key, batches, state: GroupState):
        store = Store(json.loads(state.get[0]) if state.exists else None, limit)
        rows = pd.concat(list(batches)).sort_values("tick", kind="stable")
        out = []
        for r in rows.itertuples():
            store.commit(r.kind, r.token, int(r.tick))
            keys = store.keys()
            out.append((key[0], int(r.tick), "\n" if store.start else " ".join(store.context), store.suggest(shown), store.ranked(keys[:-1])[:shown], store.ranked(keys[-1:])[:shown], store.repeated()))
        state.update((json.dumps(store.dump()),))
        yield pd.DataFrame(out, columns=["user_id", "tick", "context", "suggestions", "contextual", "general", "repeated"])

    return commits.groupBy("user_id").applyInPandasWithState(step, OUT, "store string", "append", GroupStateTimeout.NoTimeout)


def with_model(shown: DataFrame, model: DataFrame, limit: int = 5) -> DataFrame:
    """run()'s rows with session: personal tokens of the context, then the model's, then personal ones of no context; repeats left out.

    model (context, words): the words after each context of three tokens or fewer joined by spaces, "\n" at a sentence's start, ""
    without one; the longest context it has is taken. A static table: the stream is joined to it, it isn't held in the state.
    """
    rows, found = shown.withColumn("_c", F.split("context", " ")), []
    for k in range(MAX_CONTEXT, -1, -1):
        key = F.when(F.size("_c") >= k, F.array_join(F.slice("_c", F.greatest(F.lit(1), F.size("_c") - k + 1), F.lit(k)), " ")) if k else F.lit("")
        side = model.select(F.col("context").alias(f"_k{k}"), F.col("words").alias(f"_w{k}"))
        rows = rows.withColumn(f"_q{k}", key).join(side, F.col(f"_q{k}") == F.col(f"_k{k}"), "left").drop(f"_q{k}", f"_k{k}")
        found.append(f"_w{k}")
    model_words = F.coalesce(*found, F.array().cast("array<string>"))
    every = F.array_except(F.array_distinct(F.concat("contextual", model_words, "general")), F.col("repeated"))
    return rows.withColumn("session", F.slice(every, 1, limit)).drop("_c", *found)
