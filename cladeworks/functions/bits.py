"""Sets of taxa as columns: a BIGINT for up to 63 taxa, beyond that an ARRAY<BIGINT> of words of 63 bits.

Taxon t is bit t - 1. Both forms have the same operators and give the same results; :func:`bits` picks the form by the
number of taxa, :func:`bits_in` by a column's type. Arrays are compared, grouped and joined by Spark as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

WORD = 63
_ONES = (1 << WORD) - 1


def _shift(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


class Narrow:
    """At most 63 taxa in one BIGINT. A taxon beyond is an error, never another one's bit."""

    ddl = "bigint"

    def __init__(self, ntax: int = WORD):
        self.ntax = ntax

    def bit(self, taxon: Column) -> Column:
        return F.when(taxon.between(1, WORD), _shift(taxon - 1)).otherwise(F.raise_error(F.lit("a BIGINT holds taxa 1 to 63")).cast("bigint"))

    def union(self, taxon: Column, where: Column | None = None) -> Column:
        """Aggregate: the set of the taxa (of rows where the condition holds)."""
        b = self.bit(taxon)
        return F.bit_or(b) if where is None else F.coalesce(F.bit_or(F.when(where, b)), F.lit(0).cast("bigint"))

    def union_of(self, mask: Column) -> Column:
        """Aggregate: the union of sets."""
        return F.bit_or(mask)

    def of(self, taxa: Iterable[int]) -> Column:
        return F.lit(self.to_value(sum(1 << (t - 1) for t in set(taxa)))).cast("bigint")

    def full(self) -> Column:
        return self.of(range(1, self.ntax + 1))

    def both(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(b)

    def either(self, a: Column, b: Column) -> Column:
        return a.bitwiseOR(b)

    def differ(self, a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b)

    def minus(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(F.bitwise_not(b))

    def empty(self, a: Column) -> Column:
        return a == 0

    def size(self, a: Column) -> Column:
        return F.bit_count(a)

    def has(self, mask: Column, taxon: Column) -> Column:
        return F.call_function("shiftright", mask, (taxon - 1).cast("int")).bitwiseAND(F.lit(1)) != 0

    def gather(self, taxa: list[int], inside: Callable[[Column], Column]) -> Column:
        """The set of the places (from 1) in the list whose taxon the condition holds for."""
        return self._gather(F.array(*map(F.lit, taxa)), 1, len(taxa), inside)

    def _gather(self, taxa: Column, first: int, last: int, inside: Callable[[Column], Column]) -> Column:
        zero = F.lit(0).cast("bigint")
        if last < first:
            return zero
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), zero, lambda s, i: F.when(inside(F.element_at(taxa, i)), s.bitwiseOR(_shift(i - first))).otherwise(s))

    def to_value(self, m: int) -> int:
        if m >> WORD:
            raise ValueError("a BIGINT holds taxa 1 to 63: give the number of taxa")
        return m

    def to_int(self, value) -> int:
        return int(value)


class Wide(Narrow):
    """Any number of taxa in words of 63 bits."""

    ddl = "array<bigint>"

    @property
    def words(self) -> int:
        if self.ntax is None:
            raise ValueError("the number of taxa is needed")
        return -(-self.ntax // WORD)

    def _word(self, k: int, taxon: Column) -> Column:
        at = taxon - (k * WORD + 1)
        word = F.when(at.between(0, WORD - 1), _shift(at))
        if k:
            return word
        return F.when(~taxon.between(1, self.ntax), F.raise_error(F.lit("taxon beyond the number of taxa")).cast("bigint")).otherwise(word)

    def bit(self, taxon: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.array(*(F.coalesce(self._word(k, taxon), zero) for k in range(self.words)))

    def union(self, taxon: Column, where: Column | None = None) -> Column:
        pick = lambda w: w if where is None else F.when(where, w)
        return F.array(*(F.coalesce(F.bit_or(pick(self._word(k, taxon))), F.lit(0).cast("bigint")) for k in range(self.words)))

    def union_of(self, mask: Column) -> Column:
        return F.array(*(F.bit_or(mask[k]) for k in range(self.words)))

    def of(self, taxa: Iterable[int]) -> Column:
        return F.array(*(F.lit(w).cast("bigint") for w in self.to_value(sum(1 << (t - 1) for t in set(taxa)))))

    def _zip(self, a: Column, b: Column, f) -> Column:
        # a literal may be shorter than the column: missing words are 0
        return F.zip_with(a, b, lambda x, y: f(F.coalesce(x, F.lit(0).cast("bigint")), F.coalesce(y, F.lit(0).cast("bigint"))))

    def both(self, a: Column, b: Column) -> Column:
        return self._zip(a, b, lambda x, y: x.bitwiseAND(y))

    def either(self, a: Column, b: Column) -> Column:
        return self._zip(a, b, lambda x, y: x.bitwiseOR(y))

    def differ(self, a: Column, b: Column) -> Column:
        return self._zip(a, b, lambda x, y: x.bitwiseXOR(y))

    def minus(self, a: Column, b: Column) -> Column:
        return self._zip(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))

    def empty(self, a: Column) -> Column:
        return F.forall(a, lambda w: w == 0)

    def size(self, a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, w: s + F.bit_count(w))

    def has(self, mask: Column, taxon: Column) -> Column:
        word = F.get(mask, F.floor((taxon - 1) / WORD).cast("int"))
        return F.coalesce(F.call_function("shiftright", word, F.pmod(taxon - 1, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1)) != 0, F.lit(False))

    def gather(self, taxa: list[int], inside: Callable[[Column], Column]) -> Column:
        places = F.array(*map(F.lit, taxa))
        return F.array(*(self._gather(places, k * WORD + 1, min((k + 1) * WORD, len(taxa)), inside) for k in range(self.words)))

    def to_value(self, m: int) -> list[int]:
        n = self.words if self.ntax is not None else max(1, -(-m.bit_length() // WORD))
        if m >> (n * WORD):
            raise ValueError("taxon beyond the number of taxa")
        return [(m >> (k * WORD)) & _ONES for k in range(n)]

    def to_int(self, value) -> int:
        return sum(int(w) << (k * WORD) for k, w in enumerate(value))


def bits(ntax: int) -> Narrow:
    return Narrow(ntax) if ntax <= WORD else Wide(ntax)


def bits_in(df: DataFrame, column: str = "mask", ntax: int | None = None) -> Narrow:
    if isinstance(df.schema[column].dataType, ArrayType):
        return Wide(ntax)
    return Narrow(ntax if ntax is not None else WORD)


def subset(b: Narrow, x: Column, y: Column) -> Column:
    return b.empty(b.minus(x, y))


def meet(b: Narrow, x: Column, y: Column) -> Column:
    return ~b.empty(b.both(x, y))


def overlap(b: Narrow, x: Column, y: Column) -> Column:
    """Whether the sets meet and neither holds the other."""
    return meet(b, x, y) & ~subset(b, x, y) & ~subset(b, y, x)


def taxa_of(b: Narrow, mask: Column, ntax: int) -> Column:
    """The taxa of a set, ascending."""
    return F.filter(F.sequence(F.lit(1), F.lit(ntax)), lambda t: b.has(mask, t))
