"""Filters as values: one tree of conditions that renders to a Column, to Spark SQL text, to a normal form by which two
filters are compared, and to the plain part that a scan can test.

A test of a null does not hold, and `~` of it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def quoted(value) -> str:
    """A text, number or truth value as an SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return All((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Any((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def __call__(self) -> Column:
        return self.column()

    def column(self, hit: Callable[[HasToken], Column] | None = None) -> Column:
        """The condition; `hit` may supply tests of tokens that were found before."""
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def normal(self) -> Predicate:
        """Equal for filters that differ in the order, nesting or repetition of terms."""
        return self

    def plain(self) -> Predicate | None:
        """What must hold of plain columns (comparisons, lists, null tests) wherever this holds; None: nothing."""
        return self

    def leaves(self) -> Iterable[Predicate]:
        yield self


@dataclass(frozen=True)
class OneOf(Predicate):
    col: str
    values: tuple

    def column(self, hit=None):
        return F.col(self.col) == self.values[0] if len(self.values) == 1 else F.col(self.col).isin(*self.values)

    def sql(self):
        if len(self.values) == 1:
            return f"{self.col} = {quoted(self.values[0])}"
        return f"{self.col} IN ({', '.join(map(quoted, self.values))})" if self.values else "false"

    def normal(self):
        return OneOf(self.col, tuple(sorted(set(self.values), key=lambda v: (str(type(v)), v))))


@dataclass(frozen=True)
class IsNull(Predicate):
    col: str

    def column(self, hit=None):
        return F.col(self.col).isNull()

    def sql(self):
        return f"{self.col} IS NULL"


@dataclass(frozen=True)
class From(Predicate):
    """At or after a value, in the order of the column."""
    col: str
    value: str

    def column(self, hit=None):
        return F.col(self.col) >= F.lit(self.value)

    def sql(self):
        return f"{self.col} >= {quoted(self.value)}"


@dataclass(frozen=True)
class FoldedOneOf(Predicate):
    """The lower-cased text is one of the values."""
    col: str
    values: tuple[str, ...]

    def column(self, hit=None):
        return F.lower(F.col(self.col)).isin(*self.values)

    def sql(self):
        return f"lower({self.col}) IN ({', '.join(map(quoted, self.values))})"

    def normal(self):
        return FoldedOneOf(self.col, tuple(sorted(set(self.values))))

    def plain(self):
        return None


@dataclass(frozen=True)
class HasToken(Predicate):
    """Some token occurs in the folded text of one column."""
    col: str
    tokens: tuple[str, ...]
    fold: str = "upper"

    def folded(self) -> Column:
        return (F.upper if self.fold == "upper" else F.lower)(F.col(self.col))

    def column(self, hit=None):
        if hit:
            return hit(self)
        found = F.lit(False)
        for token in self.tokens:
            found = found | F.contains(self.folded(), F.lit(token))
        return found

    def sql(self):
        return " OR ".join(f"contains({self.fold}({self.col}), {quoted(t)})" for t in self.tokens) or "false"

    def normal(self):
        """A token that holds another one adds nothing."""
        kept = {t for t in self.tokens if not any(s != t and s in t for s in self.tokens)}
        return HasToken(self.col, tuple(sorted(kept)), self.fold)

    def plain(self):
        return None


@dataclass(frozen=True, eq=False)
class Opaque(Predicate):
    """A condition that is known as a Column only; it equals no other one."""
    condition: Column

    def column(self, hit=None):
        return self.condition

    def sql(self):
        raise ValueError("a condition given as a Column has no SQL text")


@dataclass(frozen=True)
class Not(Predicate):
    term: Predicate

    def __post_init__(self):
        object.__setattr__(self, "term", as_predicate(self.term))

    def column(self, hit=None):
        return ~F.coalesce(self.term.column(hit), F.lit(False))

    def sql(self):
        return f"NOT coalesce({self.term.sql()}, false)"

    def normal(self):
        term = self.term.normal()
        if isinstance(term, Not):
            return term.term
        if isinstance(term, (All, Any)):
            other = Any if isinstance(term, All) else All
            return other(tuple(Not(t) for t in term.terms)).normal()
        return Not(term)

    def plain(self):
        return None

    def leaves(self):
        yield from self.term.leaves()


@dataclass(frozen=True)
class All(Predicate):
    terms: tuple[Predicate, ...]

    def __post_init__(self):
        object.__setattr__(self, "terms", tuple(map(as_predicate, self.terms)))

    def column(self, hit=None):
        out = F.lit(True)
        for t in self.terms:
            out = out & t.column(hit)
        return out

    def sql(self):
        return " AND ".join(_inner(t) for t in self.terms) or "true"

    def normal(self):
        terms = _flat(All, self.terms)
        lists: dict[str, tuple] = {}
        for t in terms:
            if isinstance(t, OneOf):
                lists[t.col] = tuple(v for v in lists[t.col] if v in t.values) if t.col in lists else t.values
        return _sorted(All, [t for t in terms if not isinstance(t, OneOf)] + [OneOf(c, v) for c, v in lists.items()])

    def plain(self):
        known = [p for t in self.terms if (p := t.plain())]
        return All(tuple(known)) if known else None

    def leaves(self):
        for t in self.terms:
            yield from t.leaves()


@dataclass(frozen=True)
class Any(Predicate):
    terms: tuple[Predicate, ...]

    def __post_init__(self):
        object.__setattr__(self, "terms", tuple(map(as_predicate, self.terms)))

    def column(self, hit=None):
        out = F.lit(False)
        for t in self.terms:
            out = out | t.column(hit)
        return out

    def sql(self):
        return " OR ".join(_inner(t) for t in self.terms) or "false"

    def normal(self):
        """Terms that differ in the list of one column only are one term with both lists."""
        merged: dict[tuple, Predicate] = {}
        rest = []
        for t in _flat(Any, self.terms):
            if isinstance(t, OneOf):
                old = merged.get(("list", t.col))
                merged["list", t.col] = OneOf(t.col, (old.values if old else ()) + t.values).normal()
            elif isinstance(t, HasToken):
                old = merged.get((t.fold, t.col))
                merged[t.fold, t.col] = HasToken(t.col, (old.tokens if old else ()) + t.tokens, t.fold).normal()
            else:
                rest.append(t)
        rest = _merged(rest)
        return _sorted(Any, [*rest, *merged.values()])

    def plain(self):
        known = [t.plain() for t in self.terms]
        return Any(tuple(known)) if known and all(known) else None

    def leaves(self):
        for t in self.terms:
            yield from t.leaves()


def _inner(term: Predicate) -> str:
    several = isinstance(term, (All, Any)) and len(term.terms) > 1 or isinstance(term, HasToken) and len(term.tokens) > 1
    return f"({term.sql()})" if several else term.sql()


def _flat(kind: type, terms: Iterable[Predicate]) -> list[Predicate]:
    out = []
    for t in terms:
        t = t.normal()
        out += t.terms if isinstance(t, kind) else [t]
    return out


def _merged(terms: list[Predicate]) -> list[Predicate]:
    """Terms of an Any, with those All joined that differ in the list of one column only."""
    found: dict[tuple, tuple[Predicate, OneOf]] = {}
    for term in terms:
        for own in term.terms if isinstance(term, All) else ():
            if not isinstance(own, OneOf):
                continue
            key = (own.col, frozenset(t for t in term.terms if t != own))
            if key in found and found[key][0] != term:
                other, values = found[key]
                joined = All((*key[1], OneOf(own.col, values.values + own.values))).normal()
                return _merged([t for t in terms if t not in (term, other)] + [joined])
            found[key] = (term, own)
    return terms


def _sorted(kind: type, terms: Iterable[Predicate]) -> Predicate:
    distinct = tuple(sorted(set(terms), key=repr))
    return distinct[0] if len(distinct) == 1 else kind(distinct)


def one_of(col: str, *values) -> OneOf:
    return OneOf(col, values)


def any_token(cols: Iterable[str], tokens: Iterable[str], fold: str = "upper") -> Predicate:
    """Some token occurs in some column."""
    terms = tuple(HasToken(c, tuple(tokens), fold) for c in cols)
    return terms[0] if len(terms) == 1 else Any(terms)


def as_predicate(condition: Predicate | Column | Callable[[], Column]) -> Predicate:
    if isinstance(condition, Predicate):
        return condition
    return Opaque(condition if isinstance(condition, Column) else condition())


def same(a: Predicate, b: Predicate) -> bool:
    """Whether two filters are one up to the order, nesting and repetition of their terms."""
    return a.normal() == b.normal()


def matching(df: DataFrame, conditions: Mapping[str, Predicate], out: str) -> DataFrame:
    """A row per (row, condition that holds), its name in `out`; each text is folded and searched once.

    All tokens that any condition looks for in a column become bits of one number a row; conditions test bits.
    What the scan can test of all conditions together is filtered first; the other tests stand in the plan once:
    the outer explode keeps the optimizer from repeating them in a filter below.
    """
    searched: dict[tuple[str, str], dict[str, int]] = {}
    for p in conditions.values():
        for leaf in p.leaves():
            if isinstance(leaf, HasToken):
                bits = searched.setdefault((leaf.fold, leaf.col), {})
                for token in leaf.tokens:
                    bits.setdefault(token, len(bits))
    for key, bits in searched.items():
        if len(bits) > 63:
            raise ValueError(f"more than 63 tokens in {key[1]}")
    plain = Any(tuple(conditions.values())).plain()
    rows = df.where(plain.column()) if plain else df
    names = {key: f"_text{k}" for k, key in enumerate(searched)}
    rows = rows.withColumns({names[key]: HasToken(key[1], (), key[0]).folded() for key in searched})
    found = {}
    for key, bits in searched.items():
        number = F.lit(0).cast("long")
        for token, bit in bits.items():
            number = number.bitwiseOR(F.when(F.contains(names[key], F.lit(token)), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
        found[f"{names[key]}_bits"] = number
    rows = rows.withColumns(found)

    def hit(leaf: HasToken) -> Column:
        key = (leaf.fold, leaf.col)
        mask = sum(1 << searched[key][t] for t in set(leaf.tokens))
        return F.col(f"{names[key]}_bits").bitwiseAND(F.lit(mask).cast("long")) != 0

    marks = F.array(*[F.when(p.column(hit), F.lit(name)) for name, p in conditions.items()])
    tagged = rows.withColumn(out, F.explode_outer(F.array_compact(marks))).drop(*names.values(), *found)
    return tagged.where(F.col(out).isNotNull())
