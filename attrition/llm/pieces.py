"""Splitting texts at boundaries no byte-level BPE token can cross, and a bounded memo of encodings.

The pre-split pattern of the public byte-level vocabularies starts a new match
at every single space that stands between two non-space characters.  Texts
are cut there with ``str.split``; a unit's encoding does not depend on its
neighbours, so it may be remembered.  The memo is only a shortcut: its size is
bounded by a parameter and results do not depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import regex

_RUN_OF_SPACES = re.compile(r"\s\s")
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
_MARKS = frozenset(".,;:!?")


def units(text: str) -> list[str]:
    """Pieces of ``text`` between safe boundaries.

    The first is marked by two leading spaces; each other one leaves out the
    single space it begins with, and so never begins with a space itself.
    """
    if _RUN_OF_SPACES.search(text) or text[0].isspace() or text[-1].isspace():
        found = _BOUNDARY.split(text)
        return ["  " + found[0], *[u[1:] for u in found[1:]]]
    found = text.split(" ")
    found[0] = "  " + found[0]
    return found


def matcher(pattern: str) -> Callable[[str], list[str]]:
    """Function that cuts a unit into the matches of ``pattern``, in order."""
    find = regex.compile(pattern).findall

    def matches(unit: str) -> list[str]:
        if unit.isalpha():
            return [" " + unit]
        if unit[-1:] in _MARKS and unit[:-1].isalpha():
            return [" " + unit[:-1], unit[-1]]
        return find(unit[2:] if unit[:2] == "  " else " " + unit)

    return matches


class Memo:
    """key -> bytes with at most two generations of ``capacity`` entries; old entries in use survive."""

    def __init__(self, make: Callable[[str], bytes], capacity: int):
        self.make, self.capacity = make, capacity
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, key: str) -> bytes:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
            if len(self.young) >= self.capacity:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value

    def join(self, keys: list[str]) -> bytes:
        found = list(map(self.young.get, keys))
        if None in found:
            found = [self(k) if v is None else v for k, v in zip(keys, found)]
        return b"".join(found)


class PieceEncoder:
    """Token ids (little-endian, unsigned 32 bits) of whole texts.

    ``encode_piece`` gives the ids' bytes of one match of the pre-split
    pattern.  A unit of more than ``long_unit`` characters is not remembered.
    """

    def __init__(self, encode_piece: Callable[[str], bytes], pattern: str,
                 capacity: int = 300_000, long_unit: int = 64):
        self.matches, self.long_unit = matcher(pattern), long_unit
        self.piece = Memo(encode_piece, capacity)
        self.unit = Memo(self._unit, capacity)
        self.encode_piece = encode_piece

    def _unit(self, unit: str) -> bytes:
        return b"".join([self.piece(p) if len(p) <= self.long_unit else self.encode_piece(p)
                         for p in self.matches(unit)])

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        found = units(text)
        if len(text) > self.long_unit * len(found) or max(map(len, found)) > self.long_unit:
            return b"".join(chain.from_iterable(
                (self.unit(u),) if len(u) <= self.long_unit else (self._unit(u),) for u in found))
        return self.unit.join(found)


class UnitEncoder:
    """Token ids as bytes of whole texts; like ``PieceEncoder``, for a cheap ``encode_piece``.

    Only units are remembered. A unit of letters and one mark is put together
    from the unit without the mark, which is often known, and the mark.
    """

    def __init__(self, encode_piece: Callable[[str], bytes], pattern: str, capacity: int = 500_000, long_unit: int = 64):
        self.encode_piece, self.matches, self.capacity, self.long_unit = encode_piece, matcher(pattern), capacity, long_unit
        self.marks = {m: encode_piece(m) for m in _MARKS}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        known = self.young.get(unit)
        if known is None:
            known = self.old.get(unit)
            if known is None:
                mark = self.marks.get(unit[-1:])
                if unit.isalpha():
                    known = self.encode_piece(" " + unit)
                elif mark is not None and unit[:-1].isalpha():
                    known = self._unit(unit[:-1]) + mark
                else:
                    known = b"".join(map(self.encode_piece, self.matches(unit)))
            if len(unit) <= self.long_unit:
                if len(self.young) >= self.capacity:
                    self.old, self.young = self.young, {}
                self.young[unit] = known
        return known

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        found = units(text)
        parts = list(map(self.young.get, found))
        if None in parts:
            parts = [self._unit(u) if ids is None else ids for u, ids in zip(found, parts)]
        return b"".join(parts)
