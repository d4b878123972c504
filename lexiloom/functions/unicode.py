"""Canonical composition and decomposition (NFC, NFD) as Column expressions, so that they stay deterministic and inside
the plan: Spark has no function for either.

A text without characters that may change, by a class of ranges, is left as it is. In others only the segments around such
characters, a starter and what may combine with it, are taken apart, put in canonical order and composed; lookups go to
tables of small maps by a hash of the characters. Hangul is computed. Null stays null. The tables are those of the
driver's `unicodedata`; code points that it doesn't know stay.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maps in a table of lookups.
BUCKETS = 512
#: Ranges of a class that are no further apart are merged: more characters than needed are looked at, none is changed.
GAP = 16
SYLLABLES, LEADS, VOWELS, TAILS = (0xAC00, 0xD7A3), (0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2)


@cache
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str], str, str, str]:
    """Decompositions, combining classes, compositions of pairs; classes of what may combine with what stands before, of
    other characters that NFC changes, and of all that NFD changes or moves."""
    apart, order, pairs, back, single, moved = {}, {}, {}, set(), set(), set()
    for n in (*range(0x80, 0x1F000), *range(0x2F800, 0x2FA20)):
        c = chr(n)
        if 0xD800 <= n <= 0xDFFF or SYLLABLES[0] <= n <= SYLLABLES[1] or unicodedata.category(c) == "Cn":
            continue
        nfd = unicodedata.normalize("NFD", c)
        if unicodedata.combining(c):
            order[c] = str(unicodedata.combining(c))
            back.add(n)
            moved.add(n)
        if nfd != c:
            apart[c] = nfd
            moved.add(n)
            if unicodedata.normalize("NFC", c) != c:
                single.add(n)
            parts = [chr(int(x, 16)) for x in unicodedata.decomposition(c).split()]
            if len(parts) == 2 and unicodedata.normalize("NFC", "".join(parts)) == c:
                pairs["".join(parts)] = c
                back.add(ord(parts[1]))
    for a, b in (VOWELS, TAILS):
        back.update(range(a, b + 1))
    back |= {ord(c) for c, nfd in apart.items() if ord(nfd[0]) in back}
    moved.update(SYLLABLES)
    return apart, order, pairs, _class(back), _class(single - back), _class(moved, 0) + rf"\x{{{SYLLABLES[0]:X}}}-\x{{{SYLLABLES[1]:X}}}"


def _class(points: set[int], gap: int = GAP) -> str:
    """Ranges of a regular expression's class."""
    out: list[list[int]] = []
    for n in sorted(points):
        if out and n - out[-1][1] <= gap + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


@cache
def _literal(kind: int) -> str:
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for k, v in _tables()[kind].items():
        buckets[(31 * ord(k[0]) + ord(k[-1])) % BUCKETS][k] = v
    return json.dumps(buckets)


def _looked_up(kind: int, key: Column) -> Column:
    """The entry of a table for one or two characters, or null."""
    table = F.from_json(F.lit(_literal(kind)), "array<map<string,string>>")  # folded once, when the query is planned
    return F.try_element_at(F.get(table, F.pmod(31 * F.ascii(key) + F.ascii(F.right(key, F.lit(1))), F.lit(BUCKETS))), key)


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), of), 1)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _character(point: Column) -> Column:
    return F.decode(F.unhex(F.hex(point)), "UTF-16BE")


def _within(point: Column, bounds: tuple[int, int]) -> Column:
    return point.between(*bounds)


def _apart(c: Column) -> Column:
    """A character's canonical decomposition."""
    s = F.ascii(c) - SYLLABLES[0]
    lead, vowel, tail = LEADS[0] + F.floor(s / 588), VOWELS[0] + F.floor(s % 588 / 28), TAILS[0] - 1 + s % 28
    hangul = F.concat(_character(lead), _character(vowel), F.when(s % 28 == 0, "").otherwise(_character(tail)))
    return F.when(_within(F.ascii(c), SYLLABLES), hangul).otherwise(F.coalesce(_looked_up(0, c), c))


def _composed(a: Column, b: Column) -> Column:
    """What two characters make, or null."""
    x, y = F.ascii(a), F.ascii(b)
    syllable = F.when(_within(x, LEADS) & _within(y, VOWELS), _character(SYLLABLES[0] + ((x - LEADS[0]) * 21 + y - VOWELS[0]) * 28))
    syllable = syllable.when(_within(x, SYLLABLES) & ((x - SYLLABLES[0]) % 28 == 0) & _within(y, TAILS), _character(x + y - (TAILS[0] - 1)))
    return F.when((y >= VOWELS[0]) & (y <= TAILS[1]), syllable).otherwise(_looked_up(2, F.concat(a, b)))


def _ordered(segment: Column) -> Column:
    """The characters of the decomposed segment as structs (g, k, i, c): marks after each starter by class, stably."""
    plain = _characters(F.array_join(F.transform(_characters(segment), _apart), ""))
    classed = F.transform(plain, lambda c: F.struct(F.coalesce(_looked_up(1, c).cast("int"), F.lit(0)).alias("k"), c.alias("c")))

    def placed(all_of: Column) -> Column:
        group = lambda i: F.size(F.filter(F.slice(all_of, F.lit(1), i + 1), lambda x: x["k"] == 0))
        return F.array_sort(F.transform(all_of, lambda x, i: F.struct(group(i).alias("g"), x["k"].alias("k"), i.alias("i"), x["c"].alias("c"))))

    return _let(classed, placed)


def _put_together(segment: Column) -> Column:
    """A segment in NFC: from left to right each character joins the last starter if it may and nothing bars it."""

    def state(out, starter, tail, last) -> Column:
        return F.struct(out.alias("out"), starter.alias("starter"), tail.alias("tail"), last.alias("last"))

    def step(s: Column, x: Column) -> Column:
        free = (s["starter"] != "") & ((s["tail"] == "") | (s["last"] < x["k"]))
        begun = state(F.concat(s["out"], s["starter"], s["tail"]), x["c"], F.lit(""), F.lit(0))
        added = state(s["out"], s["starter"], F.concat(s["tail"], x["c"]), x["k"])
        other = F.when(x["k"] == 0, begun).otherwise(added)
        return _let(F.when(free, _composed(s["starter"], x["c"])), lambda p: F.when(p.isNotNull(), state(s["out"], p, s["tail"], s["last"])).otherwise(other))

    return F.aggregate(_ordered(segment), state(F.lit(""), F.lit(""), F.lit(""), F.lit(0)), step, lambda s: F.concat(s["out"], s["starter"], s["tail"]))


@cache
def _marked() -> dict[str, list[tuple[str, str]]]:
    """Of each mark the characters below U+0180 that are a letter with it, and these letters."""
    out: dict[str, list[tuple[str, str]]] = {}
    for c, (base, mark) in ((c, nfd) for c, nfd in _tables()[0].items() if ord(c) < 0x180):
        out.setdefault(mark, []).append((c, base))
    return out


def _joined(text: Column) -> Column:
    """Letters and marks as the characters of _marked(); other marks stay."""

    def step(mark: str, pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
        def of(t: Column) -> Column:
            done = reduce(lambda u, x: F.replace(u, F.lit(x[1] + mark), F.lit(x[0])), pairs, t)
            return F.when(F.contains(t, F.lit(mark)), done).otherwise(t)

        return of

    return reduce(lambda out, x: _let(out, step(*x)), _marked().items(), text)


def nfc(text: Column) -> Column:
    """Canonical composition. Where single marks after plain letters are all that there is to compose, it is replacing."""
    back, single = _tables()[3:5]
    far = r"[\x{300}-\x{10FFFF}]"
    pieces = F.regexp_extract_all(text, F.lit(f"[^{back}{single}]+(?![{back}])|[^{back}]?[{back}]+|[{single}]"), F.lit(0))
    changed = F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(f"[{back}{single}]")), _put_together(p)).otherwise(p))
    whole = _let(F.when(~text.rlike(far + far), _joined(text)), lambda t: F.when(~t.rlike(far), t).otherwise(F.array_join(changed, "")))
    suspect = text.rlike(far) & text.rlike(f"[{back}{single}]")  # the first class is the faster one
    return F.when(suspect, whole).otherwise(text)


def nfd(text: Column) -> Column:
    """Canonical decomposition. Texts below U+0180 have letters with one mark alone, which are written behind them first."""
    moved = _tables()[5]
    pieces = F.regexp_extract_all(text, F.lit(f"[^{moved}]+|[{moved}]+"), F.lit(0))
    taken = lambda p: F.array_join(F.transform(_ordered(p), lambda x: x["c"]), "")
    changed = F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(f"^[{moved}]")), taken(p)).otherwise(p))
    near = text
    for mark, pairs in _marked().items():
        near = F.regexp_replace(near, f"([{''.join(c for c, _ in pairs)}])", f"$1{mark}")
    near = F.translate(near, "".join(c for x in _marked().values() for c, _ in x), "".join(b for x in _marked().values() for _, b in x))
    return F.when(text.rlike(r"[\x{180}-\x{10FFFF}]"), F.array_join(changed, "")).when(text.rlike(r"[\x{C0}-\x{17F}]"), near).otherwise(text)
