"""One deterministic automaton for many search rules, and its vectorised run over bytes.

A rule is a regular expression for what begins a match and a class of bytes
that ends it (one or more, as many as there are).  Matches of a rule are
leftmost and do not overlap.  ``compile_rules`` turns each rule into a
position automaton, runs the subset construction over all rules at once (a
state holds, for each rule, its live positions in the order of their starts),
minimises the result by partition refinement and returns transition arrays.

``Automaton.ends`` runs it over a buffer.  The buffer is cut into lanes that
step together; a lane's true entry state is the state its left neighbour
ends in, so lanes are run again from there until they meet the states they
already had, which takes a few bytes.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

import numpy as np

#: Never part of a UTF-8 text: stands between texts and ends every match.
END = 0xFF
_LANES = 2048


@dataclass(frozen=True)
class Rule:
    """``prefix`` then one or more bytes of ``tail``; matches with a tail shorter than ``least`` are consumed, not reported.
    ``ignore_case`` folds A-Z in the prefix."""

    kind: str
    prefix: str
    tail: str
    least: int
    ignore_case: bool = False


class _Positions:
    """Position automaton: a class of bytes for each position, and ordered lists of what may come first and next."""

    def __init__(self, rule: Rule):
        self.classes: list[frozenset[int]] = []
        self.follow: list[list[int]] = []
        self.fold = rule.ignore_case
        empty, self.first, last = self._sequence(sre_parser.parse(rule.prefix)) if rule.prefix else (True, [], [])
        self.fold = False
        [(op, value)] = sre_parser.parse(rule.tail)
        chain = [self._position(self._bytes(op, value)) for _ in range(rule.least)]
        for one, two in zip(chain, chain[1:], strict=False):
            self.follow[one].append(two)
        self.follow[chain[-1]].append(chain[-1])
        for p in last:
            self.follow[p].append(chain[0])
        if empty:
            self.first = self.first + [chain[0]]
        self.weak, self.strong = frozenset(chain), chain[-1]

    def _position(self, members: frozenset[int]) -> int:
        self.classes.append(members)
        self.follow.append([])
        return len(self.classes) - 1

    def _bytes(self, op, value) -> frozenset[int]:
        if op is sre.LITERAL:
            members = {value}
        elif op is sre.IN:
            members = set()
            for o, v in value:
                if o is sre.LITERAL:
                    members.add(v)
                elif o is sre.RANGE:
                    members.update(range(v[0], v[1] + 1))
                else:
                    raise ValueError(f"not supported in a class: {o}")
        else:
            raise ValueError(f"not supported: {op}")
        if self.fold:
            members |= {ord(c) for m in members for c in (chr(m).lower(), chr(m).upper()) if chr(m).isascii() and c.isascii()}
        if not members or max(members) > 0x7F:
            raise ValueError("classes hold ASCII bytes")
        return frozenset(members)

    def _sequence(self, parsed) -> tuple[bool, list[int], list[int]]:
        """(may be empty, first positions, last positions) of a parsed sequence."""
        empty, first, last = True, [], []
        for op, value in parsed:
            e, f, la = self._item(op, value)
            for p in last:
                self.follow[p] += [q for q in f if q not in self.follow[p]]
            first = first + f if empty else first
            last = last + la if e else la
            empty = empty and e
        return empty, first, last

    def _item(self, op, value):
        if op is sre.SUBPATTERN:
            return self._sequence(value[-1])
        if op is sre.BRANCH:
            parts = [self._sequence(x) for x in value[1]]
            return any(p[0] for p in parts), [q for p in parts for q in p[1]], [q for p in parts for q in p[2]]
        if op is sre.MAX_REPEAT:
            low, high, sub = value
            if (low, high) == (0, 1):
                e, f, la = self._sequence(sub)
                return True, f, la
            if high is sre.MAXREPEAT and low in (0, 1):
                e, f, la = self._sequence(sub)
                for p in la:
                    self.follow[p] += [q for q in f if q not in self.follow[p]]
                return e or low == 0, f, la
            raise ValueError("repeats other than ?, * and + are not supported")
        p = self._position(self._bytes(op, value))
        return False, [p], [p]

    def step(self, live: tuple[int, ...], matched: bool, byte: int) -> tuple[tuple[int, ...], bool, bool]:
        """(live positions, whether the first of them ends a match, whether a long enough match ended before this byte)."""
        new = list(dict.fromkeys(q for p in live for q in self.follow[p] if byte in self.classes[q]))
        ended = False
        if matched and not new:
            ended, matched = self.strong in live, False
        if not matched:
            new += [q for q in self.first if byte in self.classes[q] and q not in new]
        hits = [i for i, q in enumerate(new) if q in self.weak]
        if hits and hits[0] != 0:
            raise ValueError("a rule must not have two matches open at once")
        return (tuple(new[:1]), True, ended) if hits else (tuple(new), matched, ended)

    def start_of(self, window: bytes) -> int:
        """Where the match begins that ends with the window; the rule is idle before the window."""
        live: list[tuple[int, int]] = []
        matched = False
        for at, byte in enumerate(window):
            new: dict[int, int] = {}
            for p, start in live:
                for q in self.follow[p]:
                    if byte in self.classes[q]:
                        new.setdefault(q, start)
            if matched and not new:
                matched = False
            if not matched:
                for q in self.first:
                    if byte in self.classes[q]:
                        new.setdefault(q, at)
            live = list(new.items())
            if live and live[0][0] in self.weak:
                live, matched = live[:1], True
        return live[0][1]


@dataclass(frozen=True)
class Automaton:
    """Transition arrays of the minimal automaton, and the position automata to find the starts of matches."""

    rules: tuple[Rule, ...]
    positions: tuple[_Positions, ...]
    byte_class: np.ndarray  # of each byte
    table: np.ndarray  # flat; states stand as multiples of the number of classes
    ended: np.ndarray  # by state: bits of the rules a match of which ended before the byte that led here
    idle: np.ndarray  # by state: bits of the rules with nothing open
    reports: int  # states from here on have a bit in ``ended``

    @property
    def classes(self) -> int:
        return int(self.byte_class.max()) + 1

    def states(self, data: np.ndarray) -> np.ndarray:
        """The state after each byte, as a multiple of the number of classes."""
        lanes = max(1, min(_LANES, len(data) // 64))
        steps = -(-len(data) // lanes)
        padded = np.full(lanes * steps, self.byte_class[END], dtype=np.int32)
        padded[: len(data)] = self.byte_class[data]
        inputs = np.ascontiguousarray(padded.reshape(lanes, steps).T)
        path = np.empty((steps, lanes), dtype=np.int32)
        state = np.zeros(lanes, dtype=np.int32)
        for i in range(steps):
            np.take(self.table, state + inputs[i], out=path[i], mode="clip")
            state = path[i]
        entered = np.zeros(lanes, dtype=np.int32)
        while True:
            entry = np.concatenate([[0], path[-1, :-1]]).astype(np.int32)
            lane = np.flatnonzero(entry != entered)
            if not len(lane):
                return path.T.reshape(-1)[: len(data)]
            entered = entry
            state = entry[lane]
            for i in range(steps):
                state = self.table[state + inputs[i, lane]]
                other = state != path[i, lane]
                if not other.any():
                    break
                lane, state = lane[other], state[other]
                path[i, lane] = state

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(rule, start, end) of the long enough matches in each text, in bytes."""
        buffer = bytes([END]).join([b"", *texts, b""])
        path = self.states(np.frombuffer(buffer, dtype=np.uint8))
        origin = np.cumsum([1] + [len(t) + 1 for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        found = np.flatnonzero(path >= self.reports * self.classes)
        owner = np.searchsorted(origin, found, side="right") - 1
        for end, text in zip(found.tolist(), owner.tolist(), strict=True):
            bits = int(self.ended[path[end] // self.classes])
            for r in range(len(self.rules)):
                if bits >> r & 1:
                    at = end - 1
                    while not self.idle[path[at] // self.classes] >> r & 1:
                        at -= 1
                    start = at + 1 + self.positions[r].start_of(buffer[at + 1 : end])
                    out[text].append((r, start - int(origin[text]), end - int(origin[text])))
        return out


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """Subset construction over all rules, then minimisation."""
    machines = [_Positions(r) for r in rules]
    kinds: dict[tuple, int] = {}
    byte_class = np.zeros(256, dtype=np.int32)
    sample = []
    for byte in [END, *range(256)]:
        key = tuple(byte in c for m in machines for c in m.classes)
        if key not in kinds:
            kinds[key] = len(kinds)
            sample.append(byte)
        byte_class[byte] = kinds[key]
    # steps of the single rules, by rule state and class
    known: list[dict] = [{((), False): 0} for _ in rules]
    named: list[list] = [[((), False)] for _ in rules]
    memo: list[dict] = [{} for _ in rules]

    def step(r: int, state: int, kind: int) -> tuple[int, bool]:
        if (state, kind) not in memo[r]:
            live, matched, ended = machines[r].step(*named[r][state], sample[kind])
            key = (live, matched)
            if key not in known[r]:
                known[r][key] = len(named[r])
                named[r].append(key)
            memo[r][state, kind] = known[r][key], ended
        return memo[r][state, kind]

    start = ((0,) * len(rules), 0)
    index, queue, rows = {start: 0}, [start], []
    for single, _ in queue:
        row = []
        for kind in range(len(sample)):
            to = [step(r, s, kind) for r, s in enumerate(single)]
            key = (tuple(t for t, _ in to), sum(1 << r for r, (_, e) in enumerate(to) if e))
            if key not in index:
                index[key] = len(queue)
                queue.append(key)
            row.append(index[key])
        rows.append(row)
    following = np.array(rows, dtype=np.int64)
    ended = np.array([bits for _, bits in queue], dtype=np.int64)
    idle = np.array([sum(1 << r for r, s in enumerate(single) if s == 0) for single, _ in queue], dtype=np.int64)

    block = np.unique(np.stack([ended, idle]), axis=1, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[following]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # the start comes first, reporting states last
    _, member = np.unique(block, return_index=True)
    order = sorted(range(len(member)), key=lambda b: (b != block[0], ended[member[b]] != 0, b))
    number = np.argsort(order)
    member = member[order]
    table = number[block[following[member]]] * len(sample)
    reports = int(np.flatnonzero(ended[member])[0]) if ended.any() else len(member)
    return Automaton(tuple(rules), tuple(machines), byte_class, table.astype(np.int32).reshape(-1), ended[member], idle[member], reports)


def plain_pattern(rule: Rule) -> re.Pattern:
    """The rule for the standard library, for tests."""
    prefix = f"(?i:{rule.prefix})" if rule.ignore_case else rule.prefix
    return re.compile(f"(?a:{prefix})({rule.tail}+)")
