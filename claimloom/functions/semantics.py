"""Column helpers whose semantics are decided once: boundaries, rounding, bounds, bins.

Text patterns are written with `\\b` as an ASCII word boundary, the way DuckDB's RE2 reads it; Java
counts CJK characters as word characters, so pattern() spells the boundary out."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def pattern(p: str, ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + p.replace(r"\b", BOUNDARY)


def matches(text: Column, p: str, ignore_case: bool = True) -> Column:
    return text.rlike(pattern(p, ignore_case))


def needed(p: str) -> list[str]:
    """Lower-cased literals of which any match of p has at least one, if its case is ignored: the longest
    plain run of each alternative outside of groups, classes and optional characters. Empty if one has none."""
    depth, parts = 0, [""]
    for token in re.findall(r"\\.|\[[^\]]*\]|.", p, re.S):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += token
    out = []
    for part in parts:
        rest, gap = part, "\0"
        for hole in (r"\\.[?*+]?|\[[^\]]*\][?*+]?", r"\([^()]*\)[?*+]?", r"[^\0][?*]|[+^$.]"):
            while (shorter := re.sub(hole, gap, rest, flags=re.S)) != rest:
                rest = shorter
        runs = [x for x in rest.split(gap) if x]
        if not runs or any(c in rest for c in "(){}"):
            return []
        out.append(max(runs, key=len).lower())
    return out


def matches_rare(text: Column, low: Column, p: str) -> Column:
    """matches(text, p) for patterns that few texts match: the pattern is tried only where lower-cased
    text low has one of the literals that it needs."""
    if not (literals := needed(p)):
        return matches(text, p)
    return reduce(or_, [F.contains(low, F.lit(x)) for x in literals]) & matches(text, p)


@lru_cache(maxsize=16)
def _automaton(terms: tuple[str, ...]):
    """Built once in a worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t, i)
    out.make_automaton()
    return out


def terms_in(low: Column, terms: list[str]) -> Column:
    """All of terms that the lower-cased text low contains, each once, in no order; none of a null text. One
    pass of an automaton over batches of texts in Python: its time doesn't grow with the number of terms."""
    names = tuple(sorted(set(terms) - {""}))
    if not names:
        return F.when(low.isNotNull() & F.lit("" in terms), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))

    def search(texts):
        import pyarrow as pa

        find, ends, own = _automaton(names).iter, [0], []
        for t in texts.to_pylist():
            if t:
                own += {i for _, i in find(t)}
            ends.append(len(own))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()).take(pa.array(own, pa.int32())))

    there = F.arrow_udf(search, "array<string>")(low)
    return there if "" not in terms else F.when(low.isNotNull(), F.array_append(there, F.lit(""))).otherwise(there)


def list_name(terms: list[str]) -> str:
    """The field of lists_in for terms."""
    return "l" + hashlib.md5(repr(list(terms)).encode()).hexdigest()[:12]


@lru_cache(maxsize=16)
def _places(terms: tuple[str, ...]):
    """An automaton that tells the places of terms in the tuple. Built once in a worker."""
    import ahocorasick

    out, places = ahocorasick.Automaton(), {}
    for i, t in enumerate(terms):
        places.setdefault(t, []).append(i)
    always = places.pop("", [])
    for t, own in places.items():
        out.add_word(t, tuple(own))
    out.make_automaton()
    return out, always


def lists_in(low: Column, lists: list[list[str]]) -> Column:
    """For each of lists, in the field list_name(terms), its terms that the lower-cased text low contains, in declared
    order; none of a null text. One pass of an automaton tells all lists, and they leave Python in order, so that
    Spark has no list left to compare with another."""
    lists = list({list_name(terms): tuple(terms) for terms in lists}.values())
    names, flat = [list_name(terms) for terms in lists], tuple(t for terms in lists for t in terms)
    bounds = [0]
    for terms in lists:
        bounds.append(bounds[-1] + len(terms))

    def search(texts):
        import numpy as np
        import pyarrow as pa

        (automaton, always), ends, own = _places(flat), [0], []
        find = automaton.iter if len(automaton) else lambda t: ()
        for t in texts.to_pylist():
            if t is not None:
                own += sorted({i for _, places in find(t) for i in places}.union(always))
            ends.append(len(own))
        ends, own, words = np.array(ends), np.array(own, np.int32), pa.array(flat, pa.string())
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            mine = (own >= a) & (own < b)
            offsets = np.concatenate([[0], np.cumsum(mine)])[ends].astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(own[mine]))))
        return pa.StructArray.from_arrays(out, names=names)

    return F.arrow_udf(search, "struct<" + ", ".join(f"{n}: array<string>" for n in names) + ">")(low)


def spans_in(low: Column, terms: list[tuple[str, str]]) -> Column:
    """category, term, start and end of every occurrence of terms (category, term; each told once) in the lower-cased
    text low. Occurrences of one term don't overlap: the first counts, then the first after its end."""
    own = sorted({(c, t) for c, t in terms if t})
    categories, names = [c for c, _ in own], tuple(t for _, t in own)

    def search(texts):
        import numpy as np
        import pyarrow as pa

        (automaton, _), ends, which, starts = _places(names), [0], [], []
        sizes = [len(t) for t in names]
        find = automaton.iter if len(automaton) else lambda t: ()
        for text in texts.to_pylist():
            free = {}
            for end, places in find(text or ""):
                start = end + 1 - sizes[places[0]]
                if start >= free.get(places[0], 0):
                    free[places[0]] = end + 1
                    which += places
                    starts += [start] * len(places)
            ends.append(len(which))
        at, start = pa.array(which, pa.int32()), np.array(starts, np.int32)
        stop = start + np.array(sizes, np.int32)[np.array(which, np.int32)] if which else start
        fields = [pa.array(categories, pa.string()).take(at), pa.array(names, pa.string()).take(at), pa.array(start), pa.array(stop)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["category", "term", "start", "end"]))

    return F.arrow_udf(search, "array<struct<category: string, term: string, start: int, end: int>>")(low)


def of_terms(terms: list[str], there: Column) -> Column:
    """Those of terms that are in the array there, in declared order."""
    if len(set(terms)) < len(terms):  # an intersection would have a repeated term once
        return F.array_compact(F.array(*[F.when(F.array_contains(there, t), t) for t in terms]))
    return F.array_intersect(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), there)


def found(text: Column, terms: list[str]) -> Column:
    """The terms that text contains, in declared order, without regard to case. No join, no shuffle."""
    return of_terms(terms, terms_in(F.lower(text), terms))


def each(rows: DataFrame, columns: list[str], items: Column | str, name: str, place: str | None = None) -> DataFrame:
    """columns of rows and a row for each element of items, an array without nulls; place numbers them from 0.
    A plain explode has its array tested for elements before anything below it is made, so Spark would write the
    texts out once more at each place where the array names them, and match them twice."""
    if place:
        return rows.select(*columns, F.posexplode_outer(items).alias(place, name)).filter(F.col(place).isNotNull())
    return rows.select(*columns, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, as a double."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def binned(x: Column, bounds: list[float], names: list[str]) -> Column:
    """names[i] for x <= bounds[i], the last name above all."""
    out = F.lit(names[-1])
    for b, n in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(x <= b, n).otherwise(out)
    return out


def level(x: Column) -> Column:
    from .fixed import LEVELS

    return binned(x, [25, 50, 75], LEVELS)


def or_null(x: Column) -> Column:
    """Null for the empty string, which regexp_extract returns where nothing matches."""
    return F.when(x != "", x)


def sql_list(terms: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
