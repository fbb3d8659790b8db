"""Structure of one text: blocks of descriptions and claims, references between claims, their tree.

One place for the rules that the operators run over tables and SQL calls per text. Offsets are UTF-16 units. Time and
output grow with the text, whatever numbers it holds: claim numbers beyond 32 bits are none, and a range or "any preceding
claim" stands for the claims that the text has, next to those it names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

MAX_HEADING = 120
MAX_CLAIM = 2**32 - 1
EARLIER = ("preceding", "foregoing", "previous", "above")

_LABEL = re.compile(r"\s*\[([0-9]+)\]")
_OPENS = re.compile(r"\s*([0-9]+)[.)]")
_CLAIM = re.compile(r"(?<![a-z])claims?(?![a-z])", re.IGNORECASE | re.ASCII)
_NUMBER = re.compile(r"[ \t\n\f\r]*([0-9]+)")
_JOINT = re.compile(r"[ \t\n\f\r]*(to|-|–|,|or|and)", re.IGNORECASE | re.ASCII)


def units(text: str) -> int:
    """UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def places(line: str) -> Callable[[int], int]:
    """UTF-16 units before a character of the line."""
    if line.isascii():
        return lambda i: i
    wide = [i for i, c in enumerate(line) if c > "￿"]
    return lambda i: i + bisect_left(wide, i)


def lines(text: str | None) -> Iterator[tuple[int, str, int, int]]:
    """Number, line, start and stop of the lines that aren't blank."""
    at = 0
    for n, line in enumerate((text or "").split("\n")):
        stop = at + units(line)
        if line.strip():
            yield n, line, at, stop
        at = stop + 1


def number(digits: str) -> int | None:
    """A claim number, if it is one."""
    digits = digits.lstrip("0") or "0"
    return int(digits) if len(digits) <= 10 and int(digits) <= MAX_CLAIM else None


def description_rows(text: str | None) -> Iterator[tuple[int, str, str | None, int, int]]:
    """n (line), kind, label, start, stop: numbered paragraphs, headings, paragraphs."""
    for n, line, start, stop in lines(text):
        m = _LABEL.match(line)
        body = line.strip()
        letter = next((c for c in body if c.isalpha()), "") if not m and len(body) <= MAX_HEADING else ""
        heading = letter.isupper() and not body.endswith((".", ",", ";"))
        yield n, "heading" if heading else "paragraph", m.group(1) if m else None, start, stop


@dataclass
class Claim:
    """A claim: a numbered line and those after it; block 0 is what comes before the first."""

    block: int
    label: str | None
    own: int | None
    start: int
    stop: int
    links: list[tuple[int, int, int]] = field(default_factory=list)
    named: set[int] = field(default_factory=set)
    spans: list[tuple[int, int]] = field(default_factory=list)

    def needs(self, there: list[int]) -> set[int]:
        """Earlier claims that it depends on: those named, and of its ranges those that are ``there`` (sorted)."""
        out = set(self.named)
        end = 0
        for a, b in sorted(self.spans):
            a = max(a, end)
            out.update(there[bisect_left(there, a) : bisect_left(there, b + 1)])
            end = max(end, b + 1)
        return {n for n in out if self.own is not None and n < self.own}


def _after_earlier(line: str, at: int) -> bool:
    while at and line[at - 1].isspace():
        at -= 1
    return line[max(0, at - 9) : at].lower().endswith(EARLIER)


def _read_line(claim: Claim, line: str, start: int) -> None:
    where = None
    for m in _CLAIM.finditer(line):
        if _after_earlier(line, m.start()):
            if claim.own is not None:
                claim.spans.append((1, claim.own - 1))
            continue
        where = where or places(line)
        at, begin, low = m.end(), m.start(), None
        while (found := _NUMBER.match(line, at)) is not None and (value := number(found.group(1))) is not None:
            claim.links.append((start + where(begin), start + where(found.end()), value))
            claim.named.add(value)
            if low is not None and low < value:
                claim.spans.append((low, value))
            joint = _JOINT.match(line, found.end())
            if joint is None:
                break
            low = value if joint.group(1).lower() in ("to", "-", "–") else None
            at = joint.end()
            ahead = _NUMBER.match(line, at)
            begin = ahead.start(1) if ahead else at


def claims(text: str | None) -> list[Claim]:
    """The claims of a text with their links."""
    out: list[Claim] = []
    for _, line, start, stop in lines(text):
        m = _OPENS.match(line)
        own = number(m.group(1)) if m else None
        if own is not None:
            out.append(Claim(1 + (out[-1].block if out else 0), m.group(1), own, start, stop))
        elif not out:
            out.append(Claim(0, None, None, start, stop))
        out[-1].stop = stop
        _read_line(out[-1], line, start)
    return out


def claim_numbers(found: list[Claim]) -> list[int]:
    return sorted({c.own for c in found if c.own is not None})


def reference_rows(text: str | None) -> Iterator[tuple[int | None, int | None, int | None, int, bool]]:
    """claim, start, stop, ref, depends: links, and dependencies without a link (null span), claim by claim."""
    found = claims(text)
    there = claim_numbers(found)
    for c in found:
        needs = c.needs(there)
        for a, b, n in c.links:
            yield c.own, a, b, n, n in needs
        for n in sorted(needs.difference(x for _, _, x in c.links)):
            yield c.own, None, None, n, True


def tree_rows(text: str | None) -> Iterator[tuple[int, bool, int, int]]:
    """claim, is_independent, depth, base: the longest way down to an independent claim, and that claim."""
    found = claims(text)
    there = claim_numbers(found)
    needs: dict[int, set[int]] = {n: set() for n in there}
    for c in found:
        if c.own is not None:
            needs[c.own] |= c.needs(there)
    place: dict[int, tuple[int, int]] = {}
    for n in there:
        # the base is that of the deepest claim it depends on, of equal ones the first
        depth, _, base = max(((place[on][0], -on, place[on][1]) for on in needs[n] if on in place), default=(-1, 0, n))
        place[n] = (depth + 1, base)
        yield n, depth < 0, depth + 1, base
