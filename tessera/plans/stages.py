"""Staged decisions behind a gate: what passes alone, in unions, or by bisection.

The driver walks candidates, which are few and small (names and interval changes);
a gate is any callable over them, typically a Spark job or an external check.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

Gate = Callable[[Sequence["Candidate"]], bool]


@dataclass(frozen=True)
class Candidate:
    """Alternatives in falling preference; the first is tried with others, the rest alone."""

    name: str
    alternatives: tuple = ()
    choice: int = 0


@dataclass
class Outcome:
    accepted: list[Candidate] = field(default_factory=list)
    refused: list[str] = field(default_factory=list)
    trials: int = 0


def integrate(candidates: Sequence[Candidate], gate: Gate, done: Outcome | None = None) -> Outcome:
    """Accept a union if the gate passes it on top of what is accepted; else halve it, left first.

    A single candidate that fails goes on to its next alternative."""
    done = Outcome() if done is None else done
    if not candidates:
        return done
    done.trials += 1
    if gate([*done.accepted, *candidates]):
        done.accepted += candidates
        return done
    if len(candidates) == 1:
        one = candidates[0]
        if one.choice + 1 < len(one.alternatives):
            return integrate([Candidate(one.name, one.alternatives, one.choice + 1)], gate, done)
        done.refused.append(one.name)
        return done
    half = len(candidates) // 2
    integrate(candidates[:half], gate, done)
    return integrate(candidates[half:], gate, done)


def run_stage(discover: Callable[[list[Candidate]], Sequence[Candidate]], gate: Gate, rounds: int = 3) -> Outcome:
    """Discover candidates, integrate them, and discover again given what was accepted.

    Ends when a round accepts nothing or after the rounds; tried alternatives are not tried again."""
    out, tried = Outcome(), set()
    for _ in range(1 + rounds):
        fresh = [c for c in discover(out.accepted) if (c.name, c.alternatives) not in tried]
        tried |= {(c.name, c.alternatives) for c in fresh}
        before = len(out.accepted)
        integrate(fresh, gate, out)
        if len(out.accepted) == before:
            break
    return out


def batches(sizes: Sequence[int], most: int) -> list[list[int]]:
    """Indices in order, packed into batches of at most ``most``; larger items stand alone."""
    out: list[list[int]] = []
    room = 0
    for i, size in enumerate(sizes):
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append(i)
        room -= size
    return out
