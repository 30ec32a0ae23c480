"""Order-dependent commands, folded over the log of each key.

A command is an array of strings, as a client sends it: its name, its keys and its arguments. Commands of one key are folded in its log's order; those of several keys are taken apart, a part for each key, and their replies put together again. Keys that a RENAME ties together are folded together.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.shared import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, MOST = -(1 << 63), (1 << 63) - 1
NO_NUMBER, OVERFLOW, NEGATION, NO_FLOAT, INFINITE, SYNTAX, NO_KEY = (
    "ERR value is not an integer or out of range",
    "ERR increment or decrement would overflow",
    "ERR decrement would overflow",
    "ERR value is not a valid float",
    "ERR increment would produce NaN or Infinity",
    "ERR syntax error",
    "ERR no such key",
)
MANY_KEYS = "ERR MSETNX with more than one key is not supported: the keys can't be set as one"
#: Milliseconds of a unit, and whether the amount is an instant, of each option and command that names a deadline.
FORMS = {"EX": (1000, False), "PX": (1, False), "EXAT": (1000, True), "PXAT": (1, True)}
EXPIRY = {"EXPIRE": "EX", "PEXPIRE": "PX", "EXPIREAT": "EXAT", "PEXPIREAT": "PXAT"}
#: Commands of any number of keys, by how their parts' replies are put together.
SUMMED, LISTED, SET = ("DEL", "UNLINK", "EXISTS", "TOUCH"), ("MGET",), ("MSET",)
FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", re.ASCII)

State = tuple[str, int | None] | None


class Refused(Exception):
    """A command that answers with an error and changes nothing."""


def _integer(text: str, error: str = NO_NUMBER) -> int:
    text = text.strip()
    digits = text[1:] if text[:1] in ("+", "-") else text
    # 19 digits and a sign hold every long; leading zeros are allowed.
    if not (digits.isascii() and digits.isdigit() and len(digits.lstrip("0")) <= 19 and LEAST <= int(text) <= MOST):
        raise Refused(error)
    return int(text)


def _float(text: str) -> float:
    if not FLOAT.fullmatch(text.strip()) or abs(number := float(text)) == float("inf"):
        raise Refused(NO_FLOAT)
    return number


def _float_text(x: float) -> str:
    """The shortest digits that read back the same, without an exponent and always with a point."""
    text = format(Decimal(repr(x)), "f")
    return text if "." in text else f"{text}.0"


def _slice(value: bytes, start: int, end: int) -> bytes:
    first = max(len(value) + start if start < 0 else start, 0)
    last = min(max(len(value) + end, 0) if end < 0 else end, len(value) - 1)
    return value[first : last + 1] if first <= last else b""


def _deadline(form: str, amount: int, now: int, command: str, positive: bool = True) -> int:
    unit, instant = FORMS[form]
    at = amount * unit + (0 if instant else now)
    if at > MOST or (positive and amount <= 0):
        raise Refused(f"ERR invalid expire time in '{command.lower()}' command")
    return at


class Options:
    """The words after a command's fixed arguments, each taken once."""

    def __init__(self, words: list[str]):
        self.words = list(words)

    def take(self) -> str | None:
        return self.words.pop(0).upper() if self.words else None

    def number(self) -> int:
        if not self.words:
            raise Refused(SYNTAX)
        return _integer(self.words.pop(0))


def _set(state: State, now: int, command: str, args: list[str]) -> tuple[State, str | None]:
    value, options = args[0], Options(args[1:])
    condition, get, ttl = None, False, None
    while word := options.take():
        if word in ("NX", "XX") and condition is None:
            condition = word
        elif word == "GET":
            get = True
        elif word == "KEEPTTL" and ttl is None:
            ttl = ("KEEP", None)
        elif word in FORMS:
            at = _deadline(word, options.number(), now, command)
            if ttl is not None:
                raise Refused(SYNTAX)
            ttl = ("AT", at)
        else:
            raise Refused(SYNTAX)
    old = state[0] if state else None
    if (condition == "NX" and state) or (condition == "XX" and not state):
        return state, old if get else None
    deadline = None if ttl is None else ttl[1] if ttl[0] == "AT" else state and state[1]
    return (value, deadline), old if get else "OK"


def _getex(state: State, now: int, command: str, args: list[str]) -> tuple[State, str | None]:
    options, change = Options(args), None
    while word := options.take():
        if change is not None or word not in (*FORMS, "PERSIST"):
            raise Refused(SYNTAX)
        change = (None if word == "PERSIST" else _deadline(word, options.number(), now, command),)
    if not state:
        return state, None
    return (state if change is None else (state[0], change[0])), state[0]


def _setrange(state: State, now: int, command: str, args: list[str]) -> tuple[State, str | None]:
    at, patch = _integer(args[0]), args[1].encode()
    if at < 0:
        raise Refused("ERR offset is out of range")
    own = state[0].encode() if state else b""
    if patch:
        own = own.ljust(at, b"\0")
        own = own[:at] + patch + own[at + len(patch) :]
        state = (own.decode("utf-8", "replace"), state[1] if state else None)
    return state, str(len(own))


def _incr(state: State, now: int, command: str, args: list[str]) -> tuple[State, str | None]:
    by = 1 if command in ("INCR", "DECR") else _integer(args[0], f"{NO_NUMBER} ({command.lower()})")
    if command.startswith("DECR"):
        if by == LEAST:
            raise Refused(NEGATION)
        by = -by
    total = (_integer(state[0]) if state else 0) + by
    if not LEAST <= total <= MOST:
        raise Refused(OVERFLOW)
    return (str(total), state[1] if state else None), str(total)


def _incrbyfloat(state: State, now: int, command: str, args: list[str]) -> tuple[State, str | None]:
    by = _float(args[0])
    total = (_float(state[0]) if state and state[0] else 0.0) + by
    if abs(total) == float("inf"):
        raise Refused(INFINITE)
    return (_float_text(total), state[1] if state else None), _float_text(total)


def _expire(state: State, now: int, command: str, args: list[str]) -> tuple[State, str | None]:
    amount, options = _integer(args[0], f"{NO_NUMBER} ({command.lower()})"), Options(args[1:])
    guard = options.take()
    if guard not in (None, "NX", "XX", "GT", "LT") or options.words:
        raise Refused(SYNTAX)
    at = _deadline(EXPIRY[command], amount, now, command, positive=False)
    if not state:
        return None, "0"
    had = state[1]
    allowed = {None: True, "NX": had is None, "XX": had is not None, "GT": had is not None and at > had, "LT": had is None or at < had}[guard]
    if not allowed:
        return state, "0"
    return (None if at <= now else (state[0], at)), "1"


def _plain(state: State, now: int, command: str, args: list[str]) -> tuple[State, str | None]:
    value, deadline = state or (None, None)
    match command:
        case "GET" | "MGET":
            return state, value
        case "MSET":
            return (args[0], None), "OK"
        case "SETNX" | "MSETNX":
            return (state, "0") if state else ((args[0], None), "1")
        case "SETEX" | "PSETEX":
            return (args[1], _deadline("EX" if command == "SETEX" else "PX", _integer(args[0]), now, command)), "OK"
        case "GETSET":
            return (args[0], None), value
        case "GETDEL":
            return None, value
        case "APPEND":
            joined = (value or "") + args[0]
            return (joined, deadline), str(len(joined.encode()))
        case "STRLEN":
            return state, str(len((value or "").encode()))
        case "GETRANGE":
            return state, _slice((value or "").encode(), _integer(args[0]), _integer(args[1])).decode("utf-8", "replace")
        case "DEL" | "UNLINK":
            return None, "1" if state else "0"
        case "EXISTS" | "TOUCH":
            return state, "1" if state else "0"
        case "TYPE":
            return state, "string" if state else "none"
        case "PERSIST":
            return ((value, None) if state else None), "1" if deadline is not None else "0"
    left = -2 if not state else -1 if deadline is None else deadline - now
    return state, str(left if left < 0 or command == "PTTL" else -(-left // 1000))


#: What each command of one key does, and how many arguments it has after its key, at least and at most (None: any number).
TABLE: dict[str, tuple[Callable, int, int | None]] = {
    **{name: (_plain, n, n) for n, names in ((0, "GET MGET GETDEL STRLEN DEL UNLINK EXISTS TOUCH TYPE PERSIST TTL PTTL"), (1, "MSET SETNX GETSET APPEND"), (2, "SETEX PSETEX GETRANGE")) for name in names.split()},
    "MSETNX": (_plain, 1, None),
    "SET": (_set, 1, None),
    "GETEX": (_getex, 0, None),
    "SETRANGE": (_setrange, 2, 2),
    **{name: (_incr, n, n) for n, names in ((0, "INCR DECR"), (1, "INCRBY DECRBY")) for name in names.split()},
    "INCRBYFLOAT": (_incrbyfloat, 1, 1),
    **{name: (_expire, 1, None) for name in EXPIRY},
}


def apply(state: State, now: int, command: str, args: list[str], extensions: dict[str, Callable] | None = None) -> tuple[State, str | None]:
    """The state of a key (its value and deadline in ms, or None) and the reply after a command at a time. An error is a reply that begins with ERR, and changes nothing. extensions: more commands, each a function of state, time, name and arguments; a name of TABLE stays what it is."""
    if state and state[1] is not None and now >= state[1]:
        state = None
    run, least, most = TABLE.get(command) or ((extensions or {}).get(command), 0, None)
    if run is None:
        return state, f"ERR unknown command '{command}'"
    if len(args) < least or (most is not None and len(args) > most):
        return state, f"ERR wrong number of arguments for '{command.lower()}' command"
    if command == "MSETNX" and len(args) > 1:
        return state, MANY_KEYS
    try:
        return run(state, now, command, args)
    except Refused as refused:
        return state, str(refused)


def rename(states: dict[str, State], now: int, command: str, source: str, target: str) -> str:
    """RENAME and RENAMENX over the states of some keys: value and deadline move."""
    live = lambda key: (s := states.get(key)) and (s[1] is None or now < s[1])
    if not live(source):
        return NO_KEY
    if source == target or (command == "RENAMENX" and live(target)):
        return "0" if command == "RENAMENX" else "OK"
    states[target] = states.pop(source)
    return "1" if command == "RENAMENX" else "OK"


class Overlay:
    """One key's store for a script: reads and writes go to a copy of its state, which is kept only if the script ends well."""

    def __init__(self, key: str, state: State, now: int):
        self.key, self.state, self.now = key, state, now

    def call(self, command: str, *args: str) -> str | None:
        """The reply of a command on the script's key; an error ends the script."""
        reply = self.pcall(command, *args)
        if reply is not None and reply.startswith("ERR"):
            raise Refused(reply)
        return reply

    def pcall(self, command: str, *args: str) -> str | None:
        """The same, with an error as the reply."""
        if not args or args[0] != self.key:
            return "ERR a script may only use the key it names"
        self.state, reply = apply(self.state, self.now, command.upper(), list(args[1:]))
        return reply


def script_hash(text: str) -> str:
    """By what name EVALSHA calls a script."""
    return hashlib.sha1(text.encode()).hexdigest()


def script_reply(value) -> str | None:
    """A script's result as a reply: integral numbers below 2^53 as integers, other numbers cut to integers, true as 1, false and None as nil."""
    if value is None or value is False:
        return None
    if value is True:
        return "1"
    if isinstance(value, float):
        return str(int(value)) if abs(value) < float("inf") else "ERR not a finite number"
    return str(value)


def evalsha(scripts: dict[str, Callable]) -> dict[str, Callable]:
    """The command EVALSHA for scripts by hash. A log's line is EVALSHA key hash argument...; a script is a function of an Overlay and the arguments, run on a copy of its key's state; an error keeps the state as it was."""

    def run(state: State, now: int, command: str, args: list[str]) -> tuple[State, str | None]:
        key, name, *rest = args
        if name.lower() not in scripts:
            raise Refused("NOSCRIPT No matching script")
        store = Overlay(key, state, now)
        reply = script_reply(scripts[name.lower()](store, *rest))
        return store.state, reply

    return {"EVALSHA": run}


def parts(log: DataFrame) -> DataFrame:
    """(seq, pos, now_ms, command, key, args): the commands of a log (seq, now_ms, args), those of many keys taken apart, a part for each key."""
    name, rest = F.upper(F.get("args", F.lit(0))), F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0)))
    each = log.select("seq", "now_ms", name.alias("command"), rest.alias("rest"))
    one = F.array(F.struct(F.get("rest", F.lit(0)).alias("key"), F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))).alias("args")))
    none = F.array().cast("array<string>")
    by_key = F.transform("rest", lambda k: F.struct(k.alias("key"), none.alias("args")))
    by_pair = F.transform(F.sequence(F.lit(0), F.floor((F.size("rest") - 1) / 2)), lambda i: F.struct(F.get("rest", (2 * i).cast("int")).alias("key"), F.array(F.get("rest", (2 * i + 1).cast("int"))).alias("args")))
    split = F.when(F.col("command").isin(*SUMMED, *LISTED), by_key).when(F.col("command").isin(*SET) & (F.size("rest") > 0) & (F.size("rest") % 2 == 0), by_pair).otherwise(one)
    return each.select("seq", "now_ms", "command", F.posexplode(split).alias("pos", "p")).select("seq", "pos", "now_ms", "command", "p.key", "p.args")


def execute(log: DataFrame, extensions: dict[str, Callable] | None = None) -> DataFrame:
    """(seq, reply) of every command of a log (seq, now_ms, args), in the order of seq from an empty store: reply is an array, of one reply or (MGET) of one for each key; null stands for nil.

    Each key's commands are dealt to one task and sorted there; the task holds the state of one key, or of the keys that renames tie to it, and one batch of rows, so a hot key takes time but no memory. Parts of a command on several keys run each in its key's order.
    """
    each = parts(log)
    ties = each.filter(F.col("command").isin("RENAME", "RENAMENX") & (F.size("args") > 0)).select(F.col("key").alias("u"), F.get("args", F.lit(0)).alias("v")).filter("u <> v")
    if ties.isEmpty():
        grouped = each.withColumn("grp", F.col("key"))
    else:
        tied = components(ties).select(F.col("node").alias("key"), "root")
        grouped = each.join(tied, "key", "left").withColumn("grp", F.coalesce("root", "key")).drop("root")

    def run(batches):
        current, states = object(), {}
        for batch in batches:
            out = []
            for grp, key, now, command, args in zip(*(batch.column(c).to_pylist() for c in ("grp", "key", "now_ms", "command", "args")), strict=True):
                if grp != current:
                    current, states = grp, {}
                if command in ("RENAME", "RENAMENX"):
                    out.append(rename(states, now, command, key, args[0]) if len(args) == 1 else f"ERR wrong number of arguments for '{command.lower()}' command")
                    continue
                if key is None:
                    out.append(f"ERR wrong number of arguments for '{(command or '').lower()}' command")
                    continue
                state, reply = apply(states.get(key), now, command, [key, *args] if command == "EVALSHA" else args, extensions)
                if state is None:
                    states.pop(key, None)
                else:
                    states[key] = state
                out.append(reply)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("pos"), batch.column("command"), pa.array(out, pa.string())], names=["seq", "pos", "command", "reply"])

    rows = grouped.select("grp", "key", "seq", "pos", "now_ms", "command", "args").repartition("grp").sortWithinPartitions("grp", "seq", "pos")
    kind = log.schema["seq"].dataType.simpleString()
    replies = rows.mapInArrow(run, f"seq {kind}, pos int, command string, reply string")
    many = F.col("command").isin(*SUMMED, *LISTED, *SET)
    single = replies.filter(~F.coalesce(many, F.lit(False))).select("seq", F.array("reply").alias("reply"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "reply"))), lambda r: r["reply"])
    error = F.max(F.when(F.startswith("reply", F.lit("ERR")), F.col("reply")))
    joined = replies.filter(many).groupBy("seq").agg(F.first("command").alias("command"), listed.alias("listed"), F.sum(F.col("reply").try_cast("long")).alias("total"), error.alias("error"))
    whole = F.when(F.col("error").isNotNull(), F.array("error")).when(F.col("command").isin(*SUMMED), F.array(F.col("total").cast("string"))).when(F.col("command").isin(*LISTED), F.col("listed")).otherwise(F.array(F.lit("OK")))
    return single.unionByName(joined.select("seq", whole.alias("reply")))
