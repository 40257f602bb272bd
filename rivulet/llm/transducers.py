"""Small weighted finite-state transducers: composition, and the clause grammar of toxicity.

A transducer maps a stream of symbols to a stream of the same length.  The
symbol of a token is ``(kind, marks)``: its kind comes from the lexicons, the
marks are added by the stages of the cascade.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

Symbol = tuple[str, frozenset]

#: Kinds of tokens.
KINDS = ("other", "insult", "threat", "target", "negation", "report", "quote", "object")


@dataclass(frozen=True)
class Transducer:
    """Deterministic; ``step(state, symbol)`` gives the next state and the output symbol."""

    start: object
    step: Callable[[object, Symbol], tuple[object, Symbol]]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that hands the output of ``first`` to ``second``."""

    def step(state, symbol):
        a, between = first.step(state[0], symbol)
        b, out = second.step(state[1], between)
        return (a, b), out

    return Transducer((first.start, second.start), step)


def compiled(machine: Transducer) -> tuple[list[list[int]], list[list[Symbol]]]:
    """Tables [state][kind] of next states and outputs over all reachable states; state 0 starts."""
    number, queue = {machine.start: 0}, [machine.start]
    following, output = [], []
    for state in queue:
        moves = [machine.step(state, (kind, frozenset())) for kind in KINDS]
        for to, _ in moves:
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
        following.append([number[to] for to, _ in moves])
        output.append([out for _, out in moves])
    return following, output


def _marking(opens: tuple[str, ...], mark: str, kinds: tuple[str, ...], reach: int) -> Transducer:
    """Marks tokens of ``kinds`` that stand at most ``reach`` tokens behind one of the kinds ``opens``."""

    def step(left, symbol):
        kind, marks = symbol
        out = (kind, marks | {mark}) if left and kind in kinds else symbol
        return (reach if kind in opens else max(0, left - 1)), out

    return Transducer(0, step)


def _reported(mark: str, kinds: tuple[str, ...]) -> Transducer:
    """Marks tokens of ``kinds`` behind a verb of reporting, or inside quotation marks, up to the clause's end."""

    def step(state, symbol):
        said, quoted = state
        kind, marks = symbol
        if kind == "quote":
            return (said, not quoted), symbol
        out = (kind, marks | {mark}) if (said or quoted) and kind in kinds else symbol
        return (said or kind == "report", quoted), out

    return Transducer((False, False), step)


def _threat(reach: int, back: int) -> Transducer:
    """Marks what aims an unmarked threat: a target that follows closely, or the threat itself behind its object."""

    def step(state, symbol):
        left, object_left = state
        kind, marks = symbol
        if kind == "threat":
            out = (kind, marks | {"aimed"}) if object_left and not marks else symbol
            return (0 if out[1] else reach, 0), out
        out = (kind, marks | {"aimed"}) if left and kind in TARGETED else symbol
        return (max(0, left - 1), back if kind == "object" else max(0, object_left - 1)), out

    return Transducer((0, 0), step)


#: Kinds of tokens that insults and threats are directed at.
TARGETED = ("target", "object")


def clause_grammar() -> Transducer:
    """Negation, reported speech, target and threat, composed in this order."""
    marked = ("insult", "threat")
    cascade = _marking(("negation",), "negated", marked, 3)
    for stage in (_reported("reported", marked), _marking(TARGETED, "addressed", ("insult",), 4), _threat(4, 3)):
        cascade = compose(cascade, stage)
    return cascade
