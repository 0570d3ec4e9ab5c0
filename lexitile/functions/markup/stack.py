"""Nested scanning without the interpreter's stack: a scanner step is a generator that yields the steps inside it."""

from __future__ import annotations

from collections.abc import Generator


def run(step: Generator):
    """Runs a step and, in its place, every step it yields; a yield gives the inner step's result back. Nesting is bounded by memory only."""
    stack, value = [step], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as e:
            stack.pop()
            value = e.value
        else:
            stack.append(inner)
            value = None
    return value
