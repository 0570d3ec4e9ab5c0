"""Packing of ordered pieces."""

from __future__ import annotations


def pack_starts(sizes: list[int], limit: int) -> list[int]:
    """Numbers of the pieces that begin a pack: a new pack begins where the limit would be passed; a longer piece stands alone."""
    out, held = [], 0
    for k, n in enumerate(sizes):
        if not out or (held and held + n > limit):
            out.append(k)
            held = 0
        held += n
    return out


def packed(sizes: list[int], limit: int) -> list[slice]:
    """The packs as slices of the pieces."""
    starts = pack_starts(sizes, limit)
    return [slice(a, z) for a, z in zip(starts, [*starts[1:], len(sizes)])]
