"""What a routine's statement tree says: order, frames, control context, record states, endings.

``trees(routine_id, tree)``: the tree is JSON, a list of nodes ``{"kind", "op", "effect",
"var", "record_op", "then", "else", "branches", "body"}``. Kinds: op, if (then, else), case
(branches, else), loop (body), exit, error, break. A tree is walked by one task in one pass;
its depth is bounded by DEPTH, below which everything is unknown.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

DEPTH, ROUNDS = 32, 3
ORDERED = "routine_id string, op_id string, effect string, order_id int, frames array<struct<id:int,kind:string,falls_through:boolean>>, context string, loop_depth int, on_success_path boolean, dominates_return boolean"
#: Control contexts, from what runs always to what never does.
CONTEXTS = ("always", "case", "branch", "loop", "loop-branch", "unreachable")
_FRAMES = pa.list_(pa.struct([("id", pa.int32()), ("kind", pa.string()), ("falls_through", pa.bool_())]))


def ends(nodes: list) -> str:
    """How a list of statements ends: falls (it may be left at its end), exits, errs or breaks; of branches the mildest."""
    order = ("falls", "breaks", "exits", "errs")
    for n in nodes:
        kind = n["kind"]
        if kind in ("exit", "error", "break"):
            return {"exit": "exits", "error": "errs", "break": "breaks"}[kind]
        if kind == "if":
            got = [ends(n.get("then") or []), ends(n.get("else") or [])]
        elif kind == "case":
            got = [ends(b) for b in n.get("branches") or []] + [ends(n.get("else") or [])]
        else:
            continue
        worst = min(got, key=order.index)
        if worst != "falls":
            return worst
    return "falls"


class _Orders:
    """Operations of one tree in preorder."""

    def __init__(self):
        self.rows, self.order, self.frame = [], 0, 0

    def walk(self, nodes: list, frames: list, context: int, loops: int, sure: bool, depth: int) -> bool:
        """Whether what follows is still reached on every run."""
        dead = depth > DEPTH
        for n in nodes:
            kind = n["kind"]
            if n.get("op") is not None:
                level = len(CONTEXTS) - 1 if dead else context
                self.rows.append([n["op"], n.get("effect"), self.order, list(frames), CONTEXTS[level], loops, not dead and n.get("effect") != "ERROR_THROW", sure and not dead])
                self.order += 1
            if kind in ("exit", "error", "break"):
                dead, sure = True, False
            elif kind in ("if", "case"):
                parts = [("if-then", n.get("then") or []), ("if-else", n.get("else") or [])] if kind == "if" else [*(("case-branch", b) for b in n.get("branches") or []), ("case-branch", n.get("else") or [])]
                inner = max(context, {"if": 2, "case": 1}[kind]) if not loops else 4
                through = []
                for name, body in parts:
                    if not body:
                        through.append(True)
                        continue
                    self.frame += 1
                    falls = ends(body) == "falls"
                    self.walk(body, [*frames, (self.frame, name, falls)], len(CONTEXTS) - 1 if dead else inner, loops, False, depth + 1)
                    through.append(falls)
                if not any(through):
                    dead = True
                if not all(through):
                    sure = False
            elif kind == "loop":
                self.frame += 1
                self.walk(n.get("body") or [], [*frames, (self.frame, "loop", None)], len(CONTEXTS) - 1 if dead else max(context, 3), loops + 1, False, depth + 1)
        return sure


def ordered_operations(trees: DataFrame) -> DataFrame:
    """Order, frames, control context and loop depth of every operation; whether it lies on a path to success, and on all of them.

    An operation dominates the return if it stands outside all branches and loops and nothing
    before it can leave the routine; the success path excludes errors and what is never reached.
    """

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                o = _Orders()
                o.walk(json.loads(text) if text else [], [], 0, 0, True, 0)
                for row in o.rows:
                    for c, v in zip(cols, (rid, *row)):
                        c.append(v)
            frames = [[{"id": i, "kind": k, "falls_through": t} for i, k, t in f] for f in cols[4]]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), _FRAMES, pa.string(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([*cols[:4], frames, *cols[5:]], kinds)], [x.split()[0] for x in ORDERED.replace("array<struct<id:int,kind:string,falls_through:boolean>>", "a").split(", ")])

    return trees.select("routine_id", "tree").mapInArrow(run, ORDERED)


#: What each record operation makes of a variable's state.
_NO, _MAYBE, _YES = 0, 1, 2
_LOADS = ("Get", "FindFirst", "FindLast", "FindSet", "Find", "Next", "Init", "Insert", "Copy")
_DIRTIES, _STORES = ("Validate", "Assign"), ("Modify", "Insert", "Delete")
NAMES = ("no", "unknown", "yes")


class _State(dict):
    """Variable -> (loaded, dirty); what is not named is neither."""

    def of(self, var: str) -> tuple[int, int]:
        return self.get(var, (_NO, _NO))

    def joined(self, other: _State) -> _State:
        both = lambda a, b: a if a == b else _MAYBE
        return _State({v: tuple(map(both, self.of(v), other.of(v))) for v in self.keys() | other.keys()})


def _states(nodes: list, state: _State, needs: dict[str, int], depth: int) -> _State | None:
    """The state after the statements, None if none of them falls through; notes in ``needs`` which variables must come loaded."""
    if depth > DEPTH:
        return _State({v: (_MAYBE, _MAYBE) for v in state})
    for n in nodes:
        kind = n["kind"]
        if kind == "op" and n.get("var"):
            var, op = n["var"].lower(), n.get("record_op")
            loaded, dirty = state.of(var)
            if op in ("Modify", "Validate", "TestField", "Delete") and loaded != _YES:
                needs[var] = max(needs.get(var, _NO), _YES if loaded == _NO else _MAYBE)
            if op in _LOADS:
                loaded = _YES
            if op in _DIRTIES:
                dirty = _YES
            if op in _STORES or op in ("Init", "Reset", "Get", "FindSet", "FindFirst", "FindLast"):
                dirty = _NO
            state = _State(state)
            state[var] = (loaded, dirty)
        elif kind in ("exit", "error", "break"):
            return None
        elif kind in ("if", "case"):
            bodies = [n.get("then") or [], n.get("else") or []] if kind == "if" else [*(n.get("branches") or []), n.get("else") or []]
            outs = [x for x in (_states(body, state, needs, depth + 1) for body in bodies) if x is not None]
            if not outs:
                return None
            state = outs[0]
            for x in outs[1:]:
                state = state.joined(x)
        elif kind == "loop":
            before = state
            for k in range(ROUNDS + 1):
                after = _states(n.get("body") or [], state, needs, depth + 1)
                new = state if after is None else state.joined(after)
                if new == state:
                    break
                if k == ROUNDS:
                    new = _State({v: (_MAYBE, _MAYBE) for v in new})
                state = new
            state = before.joined(state) if state is not before else state
    return state


def record_states(trees: DataFrame) -> DataFrame:
    """(routine_id, var, loaded_at_exit, dirty_at_exit, requires_loaded): each record variable's state over all branches, no, unknown or yes.

    Branches join to what they agree on, else unknown; a loop is run until nothing
    changes, ROUNDS times at most, then it is unknown. Paths that leave early don't join.
    """

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                needs: dict[str, int] = {}
                state = _states(json.loads(text) if text else [], _State(), needs, 0) or _State()
                for var in sorted(state.keys() | needs.keys()):
                    loaded, dirty = state.of(var)
                    for c, v in zip(cols, (rid, var, NAMES[loaded], NAMES[dirty], NAMES[needs.get(var, _NO)])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["routine_id", "var", "loaded_at_exit", "dirty_at_exit", "requires_loaded"])

    return trees.select("routine_id", "tree").mapInArrow(run, "routine_id string, var string, loaded_at_exit string, dirty_at_exit string, requires_loaded string")


def behaviours(trees: DataFrame) -> DataFrame:
    """(routine_id, may_return, always_errs, commits, commits_always): how a routine's body ends, and whether a commit is on some and on all of its ways that do not err."""

    def commits(nodes: list) -> tuple[bool, bool, bool]:
        """(some way has a commit, every way through has, some way leaves the routine without); errors leave no success behind."""
        some = every = leaves = False
        for n in nodes:
            if n.get("effect") == "COMMIT":
                some = every = True
            if n["kind"] in ("if", "case"):
                bodies = [n.get("then") or [], n.get("else") or []] if n["kind"] == "if" else [*(n.get("branches") or []), n.get("else") or []]
                got = [(*commits(x), ends(x)) for x in bodies]
                some |= any(g[0] for g in got)
                leaves |= not every and any(g[2] for g in got)
                through = [g[1] for g in got if g[3] in ("falls", "breaks")]
                every |= bool(through) and all(through)
            elif n["kind"] == "loop":
                got = commits(n.get("body") or [])
                some |= got[0]
                leaves |= not every and got[2]
            if n["kind"] in ("exit", "error", "break"):
                leaves |= n["kind"] == "exit" and not every
                break
        return some, every, leaves

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nodes = json.loads(text) if text else []
                how = ends(nodes)
                some, every, leaves = commits(nodes)
                for c, v in zip(cols, (rid, how != "errs", how == "errs", some, every and not leaves)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *(pa.bool_(),) * 4))], ["routine_id", "may_return", "always_errs", "commits", "commits_always"])

    return trees.select("routine_id", "tree").mapInArrow(run, "routine_id string, may_return boolean, always_errs boolean, commits boolean, commits_always boolean")
